"""Operators 11 to 13 and connected components, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyspark.llm import components, crosstoken, divergence, subspace
from tallyspark.llm.queries import tokenizer_path
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


# --- 11: token alignment -------------------------------------------------------------


def plain_alignment(docs):
    """(id, text) -> {id: row}, each text encoded whole, all end offsets compared."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in plain}
    back.update({chr(256 + k): c for k, c in enumerate([c for c in range(256) if c not in plain])})
    found = {}
    for i, t in docs:
        if not t:
            found[i] = None
            continue
        data = (" " + t).encode()
        one, two = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(back[c] for c in a.id_to_token(x)) for x in one]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()
                   for x in two]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            found[i] = None
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        both = sorted(set(ends_a) & set(ends_b))
        groups, links, p, q = [], [], 0, 0
        for e in both:
            m, n = int(np.searchsorted(ends_a, e)) + 1, int(np.searchsorted(ends_b, e)) + 1
            groups.append(",".join(map(str, one[p:m])) + "|" + ",".join(map(str, two[q:n])))
            links.append((one[m - 1], two[n - 1]))
            p, q = m, n
        found[i] = len(one), len(two), groups, links
    count = Counter(x for v in found.values() if v for x in v[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = {}
    for i, v in found.items():
        if v is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = v
        out[i] = (n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                  hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out, count


def rows11(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
            for r in df.collect()}


def test_op11_query(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows11(E.queries()["op11_token_alignment"](spark, SF)) == plain_alignment(texts)[0]


ODD = [None, "", " ", "  ", "a", " a ", "a  b", "two\n\nlines \n x", "tab\tx \t y", "see <|endoftext|> and <s> </s> <0x41>",
       "it's 100% o'clock, don't!", "ﬁ Ⅷ é é \xa0nb\xa0 sp", "▁ mark", "x▁ y ▁z", "▁", "日本語 テスト \U0001F600 ok",
       "x\x00y \x1f z", "a b   c", "word " * 3000, "\r\n", "z" * 5000, "same text here", "same text here", "\x85 a \x85"]


def test_op11_odd_texts(spark, monkeypatch):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, code string, chunk int").repartition(3)
    df = df.unionByName(df.filter("doc_id < 6")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    expected, count = plain_alignment(docs)
    out, pairs = crosstoken.align_tokens(df, A, B, keep_groups=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(expected)
    for i, e in expected.items():
        r = got[i]
        sha = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], sha) == e, ODD[i]
    assert {(r["a"], r["b"]): r["links"] for r in pairs.collect()} == dict(count)


def test_op11_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    out, pairs = crosstoken.align_tokens(none, A, B)
    assert out.count() == 0 and pairs.count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["n_links"] for r in crosstoken.align_tokens(blank, A, B)[0].collect()] == [0, 0]


def test_op11_containers_round_trip():
    rng = np.random.default_rng(1)
    docs = [np.repeat(rng.integers(0, 40, 30), rng.integers(1, 60, 30)) for _ in range(crosstoken.CHUNK)]
    bits = crosstoken.or_merge([crosstoken.plane_entries(i, d) for i, d in enumerate(docs)])
    held = crosstoken.containers(bits)
    links, sets = Counter(), defaultdict(set)
    for i, d in enumerate(docs):
        links.update(d.tolist())
        for c in d.tolist():
            sets[c].add(i)
    assert dict(zip(held["code"], held["links"], strict=True)) == dict(links)
    assert dict(zip(held["code"], held["docs"], strict=True)) == {c: len(s) for c, s in sets.items()}
    assert held["dense"].map(len).max() > 0 and held["sparse"].map(len).max() > 0
    row, plane, pos = crosstoken.set_bits(held["sparse"].tolist(), held["dense"].tolist())
    again = held["code"].to_numpy()[row] << 16 | plane << crosstoken.CHUNK_BITS | pos
    assert np.array_equal(np.sort(again), bits)


# --- 12: divergence ----------------------------------------------------------------


def plain_divergence(docs, least, top):
    terms = [(a or "", s or "", [w.decode() for w in divergence.terms(t or "")]) for a, s, t in docs]
    out = []
    for lang in {d[0] for d in terms}:
        df = Counter(w for a, _, ws in terms if a == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        share = {}
        for s in {s for a, s, _ in terms if a == lang} | {None}:
            n = Counter(w for a, z, ws in terms if a == lang and s in (z, None) for w in ws)
            total = sum(n[w] for w in kept)
            share[s] = {w: (1 + 10 ** 9 * (n[w] + 5) // (total + 5 * len(kept)), n[w]) for w in kept}
        for s in share:
            if s is None:
                continue
            pairs = [(-sum(abs(share[s][w][0] - share[z][w][0]) for w in kept), z) for z in share if z not in (s, None)]
            own = [(-(share[s][w][0] - share[None][w][0]), w) for w in kept
                   if share[s][w][1] > 0 and share[s][w][0] > share[None][w][0]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(own, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("top", [3, 50])
def test_op12_small(spark, top):
    rng = np.random.default_rng(2)
    words = ["aa", "Bb", "é", "ÉZ", "ß-x", "日本", "c1d", "zz"] * 3 + ["rare"]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "S2", "é", None]),
             None if i % 17 == 0 else " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(120)]
    docs += [("fr", "only", "aa bb"), ("it", "x", None), ("it", "y", ""), ("en", "empty", "12 34")]
    docs = [tuple(None if v is None else str(v) for v in d) for d in docs]
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("rank", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted(tuple(r) for r in divergence.divergence(df, min_docs=4, top=top).collect())
    assert got == plain_divergence(docs, 4, top)


def test_op12_ties_and_empty(spark):
    docs = [("en", "a" if i % 2 else "b", " ".join(f"w{chr(97 + k)}" for k in range(26))) for i in range(8)]
    docs += [("en", "a", "extra " + " ".join(f"t{chr(97 + k)}" for k in range(26))) for _ in range(8)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.divergence(df, min_docs=4, top=5).collect())
    assert got == plain_divergence(docs, 4, 5)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_op12_hot_term_counts_are_exact(spark):
    df = spark.createDataFrame([(9_300_000_000_000, 10 ** 13, 7)], "n long, total long, v long")
    assert df.select(divergence._p("n", "total")).first()[0] == 1 + 10 ** 9 * (9_300_000_000_000 + 5) // (10 ** 13 + 35)


# --- 13: vectors -----------------------------------------------------------------------


def plain_vectors(rows, cosine):
    good = [(i, lab, np.array(v, float)) for i, v, lab in rows
            if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near, head = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for k, (i, la, x) in enumerate(good):
        for j, lb, y in good[:k]:
            if la == lb and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    near[i] += 1
                    near[j] += 1
                    p, q = find(i), find(j)
                    head[max(p, q)] = min(p, q)
    return {i: (near[i], find(i), find(i) == i) for i, _, _ in rows}


def vectors(seed, n, dim, copies, spread, labels=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    x = np.concatenate([base, *[base[: n // 4] + rng.normal(size=(n // 4, dim)) * spread for _ in range(copies)], base[:5], base[:5]])
    return [(i, [float(c) for c in np.float32(v)], int(i * 7 % 3 % labels)) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim,cell_rows,spread", [(64, 2048, 0.14), (64, 20, 0.14), (16, 10, 0.12), (5, 7, 0.1), (1, 50, 0.1), (100, 30, 0.13)])
def test_op13_against_all_pairs(spark, dim, cell_rows, spread):
    rows = vectors(dim, 120, dim, 4, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in subspace.near_vectors(df, cell_rows=cell_rows).collect()}
    assert got == plain_vectors(rows, subspace.COSINE)
    assert dim == 1 or any(v[0] for v in got.values())


def test_op13_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [1.0, inf], 1),
            (7, [1.0, 1.0], None), (8, [1.0, 1.0], None), (9, [1.0, 1.0], 1), (10, [2.0, 2.0], 1), (11, [1e200, 1e200], 1),
            (12, [1e-200, 1e-200], 1), (13, [1.0, 1.0, 0.0], 1), (14, [1.0, 1.0], 2), (15, [-1.0, -1.0], 1), (16, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, id int, block int")
    df = df.unionByName(df.filter("vec_id in (9, 3)")).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in subspace.near_vectors(df).collect()}
    group = {9, 10, 11, 12, 16}
    assert got == {i: (4, 9) if i in group else (0, i) for i, _, _ in rows}
    assert subspace.near_vectors(df.limit(0)).count() == 0


def test_op13_crowded_cell_is_dealt_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    rows = [(i, [float(c) for c in base + rng.normal(size=64) * 0.1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in subspace.near_vectors(df, cell_rows=40).collect()}
    assert got == plain_vectors(rows, subspace.COSINE)


# --- components ------------------------------------------------------------------------


def test_components_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    names = []
    real = components.table
    monkeypatch.setattr(components, "table", lambda df, name: (names.append(name), real(df, name))[1])
    chain = spark.range(1, 1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    ring = spark.range(2000, 2050).select(F.col("id").alias("a"), (2000 + (F.col("id") - 1999) % 50).alias("b"))
    loop = spark.createDataFrame([(7000, 7000), (8000, 8001), (8001, 8000)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.components(chain.union(ring).union(loop)).collect()}
    assert got == {i: 1 for i in range(1, 1001)} | {i: 2000 for i in range(2000, 2050)} | {8000: 8000, 8001: 8000}
    assert names.count("step") <= 20
    assert components.components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["op12_source_divergence", "op13_near_vectors"])
def test_sql(spark, key):
    r = compare(spark, key, E.queries()[key], E.oracle_sql()[key], SF, duck(SF))
    assert r["ok"], r
