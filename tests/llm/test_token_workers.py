"""Tasks of one Python worker share what the tokenizer has met."""

from tallyspark.llm import tokens
from tallyspark.llm.queries import tokenizer_path


def test_tasks_of_a_worker_share_learned_pieces(monkeypatch):
    path = tokenizer_path()
    text = "alpha unheardofword gamma, delta."
    first = tokens.encoder(path).encode([text])[0]
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda *a: (_ for _ in ()).throw(AssertionError("learned again")))
    again = tokens.encoder(path).encode([text])[0]
    assert first.tolist() == again.tolist()
    plain = tokens._tokenizer(path).encode(text, add_special_tokens=False).ids
    assert first.tolist() == plain


def test_batches_are_aligned_as_single_texts_are(monkeypatch):
    import numpy as np
    import public_tokenizers

    from tallyspark.llm import crosstoken
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    t = crosstoken._tokens(*paths)
    texts = ["alpha unheardofword", "</s>", "a▁b", "ﬁne", "café 中\U0001f600", "a\tb\n c", " ", "x"]
    a, b = t.ids(texts)
    data = [b" " + x.encode() for x in texts]
    expected = [crosstoken.aligned(x, y, t.bytes_a, t.bytes_b, d) for x, y, d in zip(a, b, data, strict=True)]
    assert crosstoken.aligned_all(a, b, t, data) == [
        e and (e[0], np.array(e[1], np.int64).tobytes()) for e in expected]
    assert None in expected and expected[0]
    first = crosstoken.aligner(*paths).align(["tasks of oneworker share"])
    monkeypatch.setattr(crosstoken.Tokens, "ids", lambda *_: (_ for _ in ()).throw(AssertionError("learned again"))
                        if _[1] else ([], []))
    assert crosstoken.aligner(*paths).align(["tasks of oneworker share"]) == first


def test_features_of_few_texts_are_held_at_once(monkeypatch):
    import pandas as pd

    from tallyspark.llm import toxicity

    class Rows:  # takes the function that Spark would run
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            return run

    batch = pd.DataFrame({"doc_id": range(1000), "text": ["one two words"] * 999 + [None]})
    parts = list(toxicity._counted(Rows(), None, "doc_id long")(iter([batch])))
    assert max(map(len, parts)) <= toxicity.SLICE
    out = pd.concat(parts)
    assert out["doc_id"].tolist() == list(range(1000)) and out["features"].iloc[-1] == []
    assert out["counts"].iloc[0] == [1] * len(out["features"].iloc[0])
