"""Near-duplicates: what is compared grows with a group, not with its square."""

import random

from tallyspark.llm import minhash


def test_unlike_texts_of_one_group_are_not_listed_in_pairs(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    # short texts that meet all others and are the centres; long ones like each other, too long to be like a centre
    texts = [" ".join([*base, f"y{i}"]) for i in range(5)]
    texts += [" ".join([*base, *(f"x{draw.random()}" for _ in range(25))]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed, compare = [], minhash.compared

    def counted(pairs, *rest):
        listed.append(pairs.count())
        return compare(pairs, *rest)
    monkeypatch.setattr(minhash, "compared", counted)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, shingle=2).collect()}

    sets = [{tuple(t.split()[i:i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if c == high else c for c in want]
    assert found == dict(enumerate(want))
    assert len(set(want)) == 121
    assert sum(listed) < 20 * len(texts)
