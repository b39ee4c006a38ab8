"""Detection metrics over scored trials (label 0 or 1, score): ROC, EER, tuned thresholds, DET rates, minDCF.

Every metric starts from counts by distinct score, written once, so trials are scored once and the ordered part works
on operating points. One sorted pass gives both curves: the DET sums are the totals less the ROC's.
With a class missing all rates are null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.functions.registry import Registry
from veriframe.functions.scalars import detection_cost
from veriframe.plans.materialize import materialize
from veriframe.plans.prefix_sum import running_sums


def score_counts(scored: DataFrame) -> DataFrame:
    """score, n, pos, neg, written to the checkpoint folder; trials without a score are the row of a null score."""
    sums = [F.sum(c).cast("long").alias(name) for name, c in (("pos", F.col("label")), ("neg", 1 - F.col("label")))]
    return materialize(scored.groupBy("score").agg(F.count("*").alias("n"), *sums))


def operating_points(counts: DataFrame) -> DataFrame:
    """The distinct scores in falling order with ``ordinal`` from 1, counts, sums down to each (``cum_pos``,
    ``cum_neg``), the next point's counts, the totals and the number of points."""
    known = counts.filter("score is not null").select("score", "pos", "neg")
    totals = known.agg(F.sum("pos").alias("total_pos"), F.sum("neg").alias("total_neg"), F.count("*").alias("n_points"))
    points = running_sums(known, "score", ["pos", "neg"], ascending=False, next_of=["pos", "neg"])
    return points.crossJoin(F.broadcast(totals))  # one row


def roc_curve(counts: DataFrame, prune: bool = True, points: DataFrame | None = None) -> DataFrame:
    points = operating_points(counts) if points is None else points
    if prune:
        inside = (F.col("ordinal") > 1) & (F.col("ordinal") < F.col("n_points")) & (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg")) & (F.col("n_points") > 2)
        points = points.filter(~inside)
    out = points.select(
        F.col("ordinal").cast("long"), F.col("score").cast("double").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"), (1 - F.try_divide(F.col("cum_pos"), F.col("total_pos"))).alias("fnr"),
    )
    has = counts.filter("score is not null").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter("p is not null")
    head = has.select(F.lit(0).cast("long").alias("ordinal"), F.lit(float("inf")).alias("threshold"), F.when(F.col("n") > 0, 0.0).alias("fpr"), F.when(F.col("p") > 0, 1.0).alias("fnr"))
    return head.unionByName(out)


def det_curve(counts: DataFrame, points: DataFrame | None = None) -> DataFrame:
    points = operating_points(counts) if points is None else points
    rejected = lambda name: F.col(f"total_{name}") - F.col(f"cum_{name}") + F.col(name)
    return points.select(
        (F.col("n_points") + 1 - F.col("ordinal")).cast("long").alias("ordinal"), F.col("score").cast("double").alias("threshold"),
        F.try_divide(rejected("pos"), F.col("total_pos")).alias("fnr"), (1 - F.try_divide(rejected("neg"), F.col("total_neg"))).alias("fpr"),
    )


def roc(scored: DataFrame, prune: bool = True) -> DataFrame:
    """(ordinal, threshold, fpr, fnr) in falling threshold order, accepting score >= threshold; ordinal 0 is the
    point that accepts nothing, with an infinite threshold. Pruning drops points inside straight runs."""
    return roc_curve(score_counts(scored), prune)


def equal_error_rate(curve: DataFrame) -> DataFrame:
    """(eer in percent, eer_threshold) at the first point where the two rates are nearest."""
    best = F.min(F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), "ordinal", "threshold", F.greatest("fpr", "fnr").alias("rate")))
    return curve.filter("fpr is not null and fnr is not null").agg(best.alias("b")).select((100 * F.col("b.rate")).alias("eer"), F.col("b.threshold").alias("eer_threshold"))


def tuned_thresholds(curve: DataFrame, target_fa: list[float], target_fr: list[float]) -> DataFrame:
    """The point nearest to each target rate (fractions); false-reject targets first."""
    targets = [F.struct(F.lit(k).alias("position"), F.lit(kind).alias("kind"), F.lit(float(v)).alias("target")) for k, (kind, v) in enumerate([("fr", v) for v in target_fr] + [("fa", v) for v in target_fa])]
    rows = curve.filter("fpr is not null and fnr is not null").withColumn("t", F.explode(F.array(*targets)))
    rate = F.when(F.col("t.kind") == "fr", F.col("fnr")).otherwise(F.col("fpr"))
    best = F.min(F.struct(F.abs(rate - F.col("t.target")).alias("gap"), "ordinal", "threshold", "fpr", "fnr"))
    picked = rows.groupBy("t").agg(best.alias("b"))
    return picked.select("t.position", "t.kind", "t.target", "b.threshold", "b.fpr", "b.fnr")


def det_rates(scored: DataFrame) -> DataFrame:
    """(ordinal, threshold, fnr, fpr) by rising distinct score, rejecting score <= threshold."""
    return det_curve(score_counts(scored))


def det_rates_by_row(scored: DataFrame, line: str = "line_no") -> DataFrame:
    """As ``det_rates``, one point for each trial in the order of score and then of ``line`` (unique): equal scores
    give several points, as a stable sort of the trial list does."""
    rows = materialize(scored.select("score", line, F.col("label").cast("long").alias("pos"), (1 - F.col("label")).cast("long").alias("neg")))
    rows = rows.filter(F.col("score").isNotNull()).select(F.struct("score", line).alias("at"), "pos", "neg")  # a filter before would score trials twice
    totals = rows.agg(F.sum("pos").alias("total_pos"), F.sum("neg").alias("total_neg"))
    points = running_sums(rows, "at", ["pos", "neg"]).crossJoin(F.broadcast(totals))  # one row
    return points.select(
        F.col("ordinal").cast("long"), F.col(f"at.{line}").alias(line), F.col("at.score").cast("double").alias("threshold"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("fnr"), (1 - F.try_divide(F.col("cum_neg"), F.col("total_neg"))).alias("fpr"),
    )


def min_dcf(rates: DataFrame, p_target: float = 0.05, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """(min_dcf, dcf_threshold): the normalised least detection cost, at its first point."""
    cost = detection_cost(F.col("fnr"), F.col("fpr"), p_target, c_miss, c_fa)
    best = F.min(F.struct(cost.alias("cost"), "ordinal", "threshold"))
    floor = min(c_miss * p_target, c_fa * (1 - p_target))
    return rates.filter("fpr is not null and fnr is not null").agg(best.alias("b")).select((F.col("b.cost") / floor).alias("min_dcf"), F.col("b.threshold").alias("dcf_threshold"))


def evaluation_report(scored: DataFrame, p_target: float = 0.05, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """One row: n_trials, n_pos, eer, eer_threshold, min_dcf, dcf_threshold."""
    counts = score_counts(scored)
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_trials"), F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("n_pos"))
    points = operating_points(counts)  # sorted once
    return n.crossJoin(equal_error_rate(roc_curve(counts, points=points))).crossJoin(min_dcf(det_curve(counts, points), p_target, c_miss, c_fa))  # three one-row tables


def roc_series(scored: DataFrame) -> DataFrame:
    """The full curve with a marker on its equal-error point; curve and marker come from one sorted pass."""
    counts = score_counts(scored)
    curve = roc_curve(counts, prune=False, points=operating_points(counts))
    gap = F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), "ordinal")
    mark = curve.filter("fpr is not null and fnr is not null").agg(F.min(gap).alias("b")).select(F.col("b.ordinal").alias("mark"))
    return curve.crossJoin(F.broadcast(mark)).select("ordinal", "threshold", "fpr", "fnr", (F.col("ordinal") == F.col("mark")).alias("is_eer"))


#: Metrics over scored trials, by name; every one gives a row.
metrics: Registry[Callable[..., DataFrame]] = Registry("metric")
metrics.register("eer", lambda scored: equal_error_rate(roc(scored)))
metrics.register("min_dcf", lambda scored, **costs: min_dcf(det_rates(scored), **costs))
metrics.register("report", evaluation_report)
