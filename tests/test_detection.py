"""Detection metrics against independent brute force and hand-computed cases."""

import math
import random

import pytest

from veriframe.operators import detection


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def brute(rows, prune):
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    points = [(s, sum(y for v, y in rows if v >= s), sum(1 - y for v, y in rows if v >= s)) for s in sorted({s for s, _ in rows}, reverse=True)]
    if prune and len(points) > 2:
        full = points
        points = [p for k, p in enumerate(full) if k in (0, len(full) - 1) or not (full[k + 1][1] - 2 * p[1] + full[k - 1][1] == 0 and full[k + 1][2] - 2 * p[2] + full[k - 1][2] == 0)]
    return [(math.inf, 0.0, 1.0)] + [(s, n / neg, 1 - p / pos) for s, p, n in points]


@pytest.mark.parametrize("prune", [True, False])
def test_roc_and_eer(spark, prune):
    rng = random.Random(1)
    for case in range(4):
        rows = [(rng.choice([rng.random(), rng.randint(0, 9) / 10]), int(rng.random() < 0.4)) for _ in range(rng.randint(20, 120))] + [(0.5, 1), (0.5, 0)]
        want = brute(rows, prune)
        curve = detection.roc(scored(spark, rows), prune)
        got = [(r.threshold, r.fpr, r.fnr) for r in curve.orderBy("ordinal").collect()]
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == pytest.approx(b)
        best = min(range(len(want)), key=lambda k: (abs(want[k][2] - want[k][1]), k))
        r = detection.equal_error_rate(curve).first()
        assert r.eer == pytest.approx(100 * max(want[best][1:]))


def test_hand_cases(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.4, 0)]
    r = detection.evaluation_report(scored(spark, rows)).first()
    assert (r.eer, r.eer_threshold, r.min_dcf, r.dcf_threshold) == (pytest.approx(100 / 3), 0.7, pytest.approx(1 / 3), 0.7)
    rows = [(1 - k / 10, y) for k, y in enumerate([1, 0, 0, 0, 0, 1, 0, 0])]
    assert detection.equal_error_rate(detection.roc(scored(spark, rows))).first().eer == pytest.approx(200 / 3)
    assert detection.equal_error_rate(detection.roc(scored(spark, rows), prune=False)).first().eer == pytest.approx(50)


def test_one_class_and_empty(spark):
    for rows in ([(0.1, 1), (0.2, 1)], [(0.1, 0)], []):
        r = detection.evaluation_report(scored(spark, rows)).first()
        assert r.eer is None and r.min_dcf is None and r.n_trials == len(rows)


def test_separated_and_inverted(spark):
    assert detection.equal_error_rate(detection.roc(scored(spark, [(0.9, 1), (0.1, 0)]))).first().eer == 0
    assert detection.equal_error_rate(detection.roc(scored(spark, [(0.1, 1), (0.9, 0)]))).first().eer == 100


def test_det_rates_by_row(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 6) / 10, int(rng.random() < 0.4)) for k in range(60)]
    df = spark.createDataFrame(rows, "line_no long, score double, label int").repartition(4)
    got = [(r.line_no, r.fnr, r.fpr) for r in detection.det_rates_by_row(df).orderBy("ordinal").collect()]
    pos, neg = sum(y for _, _, y in rows), sum(1 - y for _, _, y in rows)
    p = n = 0
    for (line, _, y), (at, fnr, fpr) in zip(sorted(rows, key=lambda r: (r[1], r[0])), got, strict=True):
        p, n = p + y, n + 1 - y
        assert (at, fnr, fpr) == (line, pytest.approx(p / pos), pytest.approx(1 - n / neg))


def test_trials_without_a_score_are_counted_only(spark):
    r = detection.evaluation_report(scored(spark, [(0.9, 1), (0.1, 0), (None, 1)])).first()
    assert (r.n_trials, r.n_pos, r.eer) == (3, 2, 0)


def test_metrics_by_name(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.7), (0, 0.1), (0, 0.2)], "label int, score double")
    report = detection.metrics["report"](scored).first()
    assert detection.metrics["eer"](scored).first().eer == report.eer
    assert detection.metrics["min_dcf"](scored, p_target=0.05).first().min_dcf == report.min_dcf
    detection.metrics.register("trials", lambda scored: scored.groupBy().count())
    assert detection.metrics["trials"](scored).first()["count"] == 5 and detection.metrics.names() == ["eer", "min_dcf", "report", "trials"]
    detection.metrics.known.pop("trials")
