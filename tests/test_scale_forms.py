"""Ties that the queries settle, and steps that were reworked for larger tables, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.functions import scalars
from veriframe.operators import audio, cohort, detection, prepare, scoring
from veriframe.plans import io_queries, prefix_sum
from veriframe.sources import line_files
from veriframe.streaming import monitor


@pytest.mark.parametrize("turn", [1, -1])
def test_merged_results_settle_ties_of_rank(spark, turn):
    rows = [(1, 5, 9), (1, 5, 3), (1, 4, 1), (2, 7, None), (2, 7, 8), (3, None, 1), (3, 1, 2)][::turn]
    merged = scoring.merge_results(spark.createDataFrame(rows, "key long, rank int, part long").coalesce(1), "key", "rank")
    assert sorted(map(tuple, merged.collect())) == [(1, 5, 3), (2, 7, 8), (3, 1, 2)]


def vectors_of(spark, ids, dim=3, seed=4):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(dim)], k % 3) for k in ids]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")


@pytest.mark.parametrize("reach", [1, 2, 7, 40])
def test_neighbour_trials_of_gaps_and_negative_ids(spark, reach):
    rows, e = vectors_of(spark, [*range(-25, 10), *range(13, 31, 2), 100, 107, 10**12])
    at = {k: (v, y) for k, v, y in rows}
    want = {(a, b): (int(at[a][1] == at[b][1]), -math.dist(at[a][0], at[b][0])) for a in at for b in at if a < b <= a + reach}
    got = scoring.neighbour_trials(e.repartition(3), reach).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.label, pytest.approx(r.score)) == want[r.ref, r.com]


def test_neighbour_trials_exchange_a_vector_three_times_at_most(spark):
    _, e = vectors_of(spark, range(400))
    made = scoring.neighbour_trials(e, 50)
    assert made.count() == sum(min(50, 399 - k) for k in range(400))
    assert "explode(sequence" not in made._jdf.queryExecution().toString().lower()  # no copy of a vector for each trial


def test_carried_columns_and_fused_scores(spark):
    rows, e = vectors_of(spark, range(30))
    dist, cosine = scoring.scorer("euclidean"), scoring.scorer("cosine")
    both = scoring.neighbour_trials(e.withColumn("half", F.col("vec_id") / 2), 5, scoring.fused_scorer(dist, cosine), ["half"]).collect()
    joined = scoring.fused(scoring.neighbour_trials(e, 5, dist), scoring.neighbour_trials(e, 5, cosine), ["ref", "com"])
    want = {(r.ref, r.com): r.score for r in joined.collect()}
    assert {(r.ref, r.com): pytest.approx(r.score) for r in both} == want
    assert all((r.ref_half, r.com_half) == (r.ref / 2, r.com / 2) for r in both)


def test_carried_statistics_normalise_as_joined_ones(spark):
    _, e = vectors_of(spark, range(24))
    scores = scoring.neighbour_trials(e, 4)
    cohort_rows = spark.createDataFrame([(k, c, float((k * 7 + c * 5) % 11)) for k in range(1, 24) for c in range(6)], "side long, cohort_id long, cohort_score double")
    want = {(r.ref, r.com): r.norm_score for r in scoring.score_normalized(scores, cohort_rows, 4).collect()}
    own = scoring.neighbour_trials(scoring.with_statistics(e, scoring.side_statistics(cohort_rows, 4)), 4, carry=["mu", "sigma"])
    got = {(r.ref, r.com): pytest.approx(r.n) for r in own.select("ref", "com", scoring.normalized_score(F.col("score")).alias("n")).collect()}
    assert len(got) == sum(min(4, 23 - k) for k in range(1, 24)) and got == want


def test_cohort_meets_every_strip_once(spark, monkeypatch):
    """Strips and blocks of few rows, with more equal vectors than a heap holds and vectors that are not finite."""
    monkeypatch.setattr(cohort, "SIDES", 4)
    monkeypatch.setattr(cohort, "MEMBERS", 8)
    monkeypatch.setattr(cohort, "OPEN", 3)
    rng = np.random.default_rng(8)
    members = rng.standard_normal((90, 5)).astype(np.float32)
    members[30:60] = members[30]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(members)], "id long, v array<float>")
    dealt = cohort.top_statistics(rows.withColumnRenamed("id", "side"), rows.withColumnRenamed("id", "cohort_id"), 10)
    strips = -(-90 // 12)
    assert dealt.rdd.getNumPartitions() == strips
    got = {r.side: (r.mu, r.sigma) for r in dealt.collect()}
    wide = members.astype(float)
    for k in range(90):
        best = np.sort(-np.linalg.norm(wide[k] - wide, axis=1))[-10:]
        assert got[k] == pytest.approx((best.mean(), best.std()), abs=1e-9)
    assert got[40] == (0, 0)
    bad = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0, 2.0])], "cohort_id long, v array<double>")
    assert math.isnan(cohort.top_statistics(spark.createDataFrame([(5, [0.0, 0.0])], "side long, v array<double>"), bad, 1).first().mu)


@pytest.mark.parametrize("key", ["hash", "number", "one"])
@pytest.mark.parametrize("ratio", [0.5, 0.2, 0.0])
def test_balanced_trials_take_the_first_of_each_class(spark, key, ratio):
    rows = [(k, k + 1, int(k % 4 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "ref long, com long, label int").repartition(5)
    order = {"hash": scalars.seeded_key(3, F.col("ref")), "number": -F.col("ref"), "one": F.lit("same")}[key]
    of = {"hash": lambda k: hashlib.md5(f"3|{k}".encode()).hexdigest(), "number": lambda k: -k, "one": lambda k: "same"}[key]
    take = prepare.balance_quotas(100, 300, ratio)
    want = {r for y in (1, 0) for r in sorted((r for r in rows if r[2] == y), key=lambda r: (of(r[0]), r))[: take[1 - y]]}
    made = prepare.balanced_trials(df, order, ["ref", "com"], ratio)
    assert {(r.ref, r.com, r.label) for r in made.collect()} == want and made.count() == len(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_rates_by_row_score_a_trial_once(spark):
    """A test for missing scores must not be pushed below the scoring, which would then run twice."""
    scored = spark.sparkContext.accumulator(0)

    def score(k):
        scored.add(1)
        return k % 7 / 10

    rows = spark.range(50).select(F.col("id").alias("line_no"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.udf(score, "double")("id").alias("score"))
    assert detection.det_rates_by_row(rows).count() == 50 and scored.value == 50


def test_reverb_keeps_no_blocks_of_short_clips():
    made = audio.overlap_add(np.arange(64.0), np.array([1.0, 0.5]))
    assert made.base is None and made.nbytes == 64 * 8
    assert made == pytest.approx(np.convolve(np.arange(64.0), [1, 0.5])[:64])


def test_short_ranges_are_shared_out_to_few_tasks(spark, tmp_path):
    lines = [f"s{k % 7} d/{k}.wav" for k in range(5_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("x y\n")
    rows = line_files.read_list(spark, str(tmp_path), "manifest", 128)
    assert rows.rdd.getNumPartitions() <= line_files.TASKS + 1 < rows.select("file", "split").distinct().count()
    numbered = line_files.line_numbers(rows, str(tmp_path), 128).filter("path <> 'y'").collect()
    assert sorted((r.line_no, f"{r.speaker} {r.path}") for r in numbered) == list(enumerate(lines))


def test_state_of_few_runs_has_a_partition_a_core_at_most(spark, tmp_path):
    """However many partitions the caller's shuffles have; missing values and any order of a batch's records."""
    runs = {1: [5.0, None, 4.0, 4.0, 9.0, 1.0], 2: [2.0, 3.0], 3: [None, None, None, 1.0]}
    rows = [(r, k, v) for r, vs in runs.items() for k, v in enumerate(vs)][::-1]
    spark.createDataFrame(rows, "run long, seq long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        own = monitor.state_session(spark, few_keys=True)
        assert monitor.state_session(spark).conf.get("spark.sql.shuffle.partitions") == "37"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stream = monitor.monitored(own.readStream.schema("run long, seq long, value double").parquet(str(tmp_path / "in")), 3)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.run, r.seq, r.event, r.best) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "improved", 5.0), (1, 2, "improved", 4.0), (1, 5, "improved", 1.0), (2, 0, "improved", 2.0), (3, 2, "stopped", math.inf)]
    stores = [p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]
    assert 0 < len(stores) <= spark.sparkContext.defaultParallelism


def test_records_are_packed_before_they_meet_by_run(spark):
    rows = [(k % 3 if k % 50 else None, k, None if k % 11 == 0 else k / 8) for k in range(3000)]
    made = monitor.packed(spark.createDataFrame(rows, "run long, seq long, value double").coalesce(1)).collect()
    assert len(made) == 4  # a row a run, not a record
    got = {(r.run, s, None if math.isnan(v) else v) for r in made for s, v in zip(r.seqs, r.values, strict=True)}
    assert got == set(rows) and sum(len(r.seqs) for r in made) == len(rows)
    assert monitor.packed(spark.createDataFrame([], "run long, seq long, value double")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_rows_of_few_groups_do_not_meet_by_group(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(prefix_sum, "BROADCAST_GROUPS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = prefix_sum.numbered_within(spark.range(600).select((F.col("id") % 2).alias("g"), (-F.col("id")).alias("k")), ["g"], ["k"])
        assert {(r.g, r.k, r.nth, r.n_nth) for r in made.collect()} == {(-k % 2, k, (598 + k % 2 + k) // 2, 300) for k in range(-599, 1)}
        assert ("SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()) == (not few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tail_of_many_short_files_takes_few_tasks(tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03}.txt").write_text(f"a{k}\nb{k}\n")
    reader = line_files.LogTailReader({"path": str(tmp_path)})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= line_files.TASKS + 1
    lines = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert sorted(lines) == sorted(f"{c}{k}" for k in range(300) for c in "ab")


def test_a_tenth_of_the_live_records_is_read_without_the_others(spark, sf_dir):
    rows = io_queries._log_records(spark, sf_dir)
    one = rows.filter("part = 3")
    assert 0 < len(one.select("run").inputFiles()) and rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "(part#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
