"""An anchor with very many runs may end where its runs have just been given."""

from test_llm_operators import ODD, brute_repeats, frame

from veriframe.llm import repeats


def test_anchor_that_ends_at_a_flush(spark, monkeypatch):
    monkeypatch.setattr(repeats, "IN_TASK", 2)
    monkeypatch.setattr(repeats, "FLUSH", 0)
    texts = ODD + [f"{k}" + "ab" * 20 + f"{k}" for k in range(8)] + [f"{k}" + "xyz" * 12 + f"{k}" for k in range(8)] + [f"{k}" + "qrstuvw" * 6 + f"{k}" for k in range(8)]
    df = frame(spark, texts).repartition(3).cache()
    df.count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, 12, 4).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 12)))
