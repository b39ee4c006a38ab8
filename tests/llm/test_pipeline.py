"""The corpus pipeline against a brute-force run over small documents."""

import hashlib
import random

import corpus_pipeline
from test_llm_operators import brute_repeats, exact_classes, frame


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        texts.append(" ".join(base) + ("\n" + passage if k % 4 == 0 else ""))
        if k % 5 == 0:
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base) + ("\n" + passage if k % 4 == 0 else ""))
    texts += ["12345 ###", None, ""]
    frame(spark, texts, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    docs, states = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        states.append(docs)
        if name != "pack":
            assert docs.columns == columns
    lang, near, cut, mixed, packed = states
    assert sorted(r.doc_id for r in lang.collect()) == list(range(len(texts) - 3))
    left = [t for t in texts[:-3]]
    keep = sorted(set(exact_classes(left)))
    assert sorted(r.doc_id for r in near.collect()) == keep
    removed = brute_repeats([left[i] for i in keep], 200)
    got = {r.doc_id: r.text for r in cut.collect()}
    for i, (_, _, _, digest) in zip(keep, removed, strict=True):
        assert hashlib.sha256(got[i].encode()).hexdigest() == digest
    sizes = {r.doc_id: r.text for r in cut.collect()}
    assert all(sizes[r.doc_id] == r.text for r in mixed.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
