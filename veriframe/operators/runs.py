"""Experiment-log analytics over epoch records: run segments, best-so-far, comparisons, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.scalars import decayed_rate
from veriframe.plans.prefix_sum import running_sums


def segments(records: DataFrame, run: str, order: str, epoch: str = "epoch") -> DataFrame:
    """Adds ``segment``: it rises wherever a run's epoch does not rise, i.e. where the run was restarted."""
    w = Window.partitionBy(run).orderBy(order)
    restart = F.when(F.col(epoch) <= F.lag(epoch).over(w), 1).otherwise(0)
    return records.withColumn("_new", restart).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def best_so_far(records: DataFrame, run: list[str], order: str, value: str, patience: int = 0) -> DataFrame:
    """Adds best (before this record), improved (strictly), since (records since the last improvement) and stop
    (the patience is used up; never with 0)."""
    w = Window.partitionBy(*run).orderBy(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = records.withColumn("best", before).withColumn("improved", F.coalesce(F.col(value) < F.col("best"), F.col(value).isNotNull()))
    out = out.withColumn("_block", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy(*run, "_block").orderBy(order)) - F.when(F.col("_block") > 0, 1).otherwise(0)
    out = out.withColumn("since", since.cast("long"))
    stop = F.lit(False) if not patience else F.col("since") >= patience
    return out.withColumn("stop", stop).drop("_block")


def early_stop(records: DataFrame, run: str, order: str, value: str, patience: int) -> DataFrame:
    """The first record of each run at which it stops."""
    stops = best_so_far(records, [run], order, value, patience).filter("stop")
    return stops.groupBy(run).agg(F.min(order).alias("stop_at"))


def best_epoch(records: DataFrame, run: list[str], epoch: str, value: str) -> DataFrame:
    """Best value with its (first) epoch, and the last epoch's value."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(epoch).alias("e")))
    last = F.max(F.struct(F.col(epoch).alias("e"), F.col(value).alias("v")))
    return records.filter(F.col(value).isNotNull()).groupBy(*run).agg(best.alias("b"), last.alias("l")).select(*run, F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best_value"), F.col("l.v").alias("final_value"))


def top_epochs(records: DataFrame, value: str, tie: list[str], n: int = 5) -> DataFrame:
    return records.orderBy(value, *tie).limit(n)


def time_to_target(records: DataFrame, run: str, epoch: str, value: str, target: float) -> DataFrame:
    """First epoch below the target (null: never)."""
    return records.groupBy(run).agg(F.min(F.when(F.col(value) < target, F.col(epoch))).alias("first_epoch"))


def gap_to_baseline(best: DataFrame, run: str, baseline: str | int, value: str = "best_value") -> DataFrame:
    """Absolute and relative distance of each run's best to one run's."""
    base = best.filter(F.col(run) == baseline).select(F.col(value).alias("base"))
    joined = best.crossJoin(F.broadcast(base))  # one row
    return joined.select(run, value, (F.col(value) - F.col("base")).alias("gap"), F.try_divide(100 * (F.col(value) - F.col("base")), F.col("base")).alias("gap_pct"))


def efficiency(best: DataFrame, size: str, value: str = "best_value", digits: int = 9) -> DataFrame:
    """Adds value per unit of size (``ratio``, rounded) and its ``rank``; equal ratios share one, null ratios have none.
    Ranks are running counts over the distinct ratios."""
    ratio = best.withColumn("ratio", F.round(F.try_divide(F.col(value), F.col(size)), digits))
    known = ratio.filter("ratio is not null").groupBy("ratio").agg(F.count("*").alias("same"))
    ranks = running_sums(known, "ratio", ["same"]).select("ratio", (F.col("cum_same") - F.col("same") + 1).alias("rank"))
    return ratio.join(ranks, "ratio", "left").select(*best.columns, "ratio", "rank")


def loss_shares(records: DataFrame, classification: str, distance: str, alpha: float) -> DataFrame:
    a, b = (1 - alpha) * F.col(classification), alpha * F.col(distance)
    return records.withColumn("class_share_pct", F.try_divide(100 * a, a + b)).withColumn("distill_share_pct", F.try_divide(100 * b, a + b))


def ablation(records: DataFrame, arguments: DataFrame, run: str, argument: str, value: str) -> DataFrame:
    """Best value by one argument of the runs."""
    named = arguments.select(run, F.try_element_at("args", F.lit(argument)).alias("argument"))
    return records.join(named, run).groupBy("argument").agg(F.min(value).alias("best_value"), F.countDistinct(run).alias("n_runs"))


def wide_epochs(train: DataFrame, validation: DataFrame, keys: list[str]) -> DataFrame:
    return train.join(validation, keys, "full_outer")


def rate_audit(records: DataFrame, rate: float, gamma: float, step: int, epoch: str = "epoch", lr: str = "lr", tolerance: float = 1e-6) -> DataFrame:
    """Records whose logged learning rate is not what step decay gives."""
    return records.withColumn("expected_lr", decayed_rate(rate, gamma, step, F.col(epoch))).filter(F.abs(F.col(lr) - F.col("expected_lr")) > tolerance)


def divergence(records: DataFrame, run: str, epoch: str, loss: str, value: str) -> DataFrame:
    """First epoch with a loss that is not finite, and the last value's regression from the best."""
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    last = F.max_by(value, epoch)
    return records.groupBy(run).agg(F.min(F.when(bad, F.col(epoch))).alias("first_bad_epoch"), (last - F.min(value)).alias("regression"))


def rolling_mean(rows: DataFrame, group: str, order: str, value: str, width: int = 20) -> DataFrame:
    """Mean of the last ``width`` values at every ``width``-th record."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows.withColumn("seq", F.row_number().over(w)).withColumn("mean_last", F.avg(value).over(w.rowsBetween(1 - width, 0)))
    return out.filter(F.col("seq") % width == 0)


def warm_up_skipped(rows: DataFrame, group: str, order: str, skip: int, limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_n", nth).filter((F.col("_n") > skip) & (F.col("_n") <= skip + limit)).drop("_n")


def metric_summary(rows: DataFrame, metric: str, value: str) -> DataFrame:
    return rows.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def epoch_means(rows: DataFrame, keys: list[str], loss: str, accuracy: str, accumulation: int = 1) -> DataFrame:
    """Epoch means; a loss that was divided by the accumulation steps is multiplied back."""
    return rows.groupBy(*keys).agg((F.avg(loss) * accumulation).alias("mean_loss"), F.avg(accuracy).alias("mean_accuracy"), F.count("*").alias("n_batches"))


def throughput(timings: DataFrame, group: str, seconds: str, batch_size: int) -> DataFrame:
    """Samples a second over all batches, and the batch times' average, minimum and maximum."""
    return timings.groupBy(group).agg(F.try_divide(F.lit(batch_size) * F.count(seconds), F.sum(seconds)).alias("samples_per_s"), F.avg(seconds).alias("mean_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"))


def speed_up(rates: DataFrame, variant: str, value: str, baseline: str, other: str, utilisation: str | None = None) -> DataFrame:
    """One row: both variants' values, their ratio, the increase in percent and, if asked for, the difference of a third
    metric (``utilisation_delta``, in its own unit)."""
    pick = lambda v, c=value: F.max(F.when(F.col(variant) == v, F.col(c)))
    delta = [(pick(other, utilisation) - pick(baseline, utilisation)).alias("utilisation_delta")] if utilisation else []
    both = rates.agg(pick(baseline).alias("base"), pick(other).alias("new"), *delta)
    return both.withColumn("ratio", F.try_divide("new", "base")).withColumn("increase_pct", F.try_divide(100 * (F.col("new") - F.col("base")), F.col("base")))
