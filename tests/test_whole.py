"""Queries over every row, where their first forms take part of a table."""

from collections import Counter

from pyspark.sql import functions as F

from veriframe.operators import prepare
from veriframe.plans import catalogue


def test_every_full_tuple_is_batched(spark):
    speakers = "a" * 13 + "b" * 7 + "c" * 2 + "d" * 6
    df = spark.createDataFrame(list(zip(speakers, range(28), strict=True)), "speaker string, vec_id long")
    rows = prepare.tuple_batches(prepare.tuples(df, "speaker", "vec_id", 3), "speaker", 7, 2).collect()
    assert Counter(r.speaker for r in rows) == {"a": 12, "b": 6, "d": 6}
    assert {r.vec_id for r in rows}.isdisjoint({12, 19, 20, 21})
    assert all((r.vec_id - {"a": 0, "b": 13, "d": 22}[r.speaker]) == 3 * r.round + r.slot for r in rows)
    assert set(Counter((r.batch_id, r.speaker) for r in rows).values()) == {3}
    assert all(r.batch_id.startswith(f"{r.round}-") for r in rows)


def test_whole_losses_score_every_tuple(spark, sf_dir):
    e = catalogue.embeddings(spark, sf_dir)
    tuples = e.groupBy("label").count().agg(F.sum(F.floor(F.col("count") / 3)).alias("n")).first().n
    assert catalogue.QUERIES["proto_loss"](spark, sf_dir).first().n_rows == tuples
    assert catalogue.QUERIES["ge2e_loss"](spark, sf_dir).first().n_rows == 3 * tuples


def test_every_trial_is_normalised(spark, sf_dir):
    assert catalogue.QUERIES["snorm_scores"](spark, sf_dir).count() == catalogue.trials(spark, sf_dir).count()


def test_leakage_of_all_keys(spark, sf_dir):
    keys = [{r[0] for r in catalogue.table(spark, sf_dir, t).select(c).collect()} for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"))]
    assert catalogue.QUERIES["leakage_check"](spark, sf_dir).first().n_shared == len(keys[0] & keys[1])
