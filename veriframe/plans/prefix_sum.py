"""Running sums over a globally ordered table without a single-partition window.

The table is range-partitioned by the key, each partition is summed, and the partitions' offsets (one small row
each) are added to running sums inside partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.plans.materialize import materialize

#: Groups up to which their sizes are sent to all rows; the rows of few groups must not meet by group, in as few tasks.
BROADCAST_GROUPS = 400_000


def running_sums(df: DataFrame, key: str, values: list[str], ascending: bool = True, next_of: list[str] = ()) -> DataFrame:
    """Adds ``cum_<value>`` (inclusive), ``ordinal`` from 1, and ``next_<column>`` of the following row. ``key`` must
    be unique, so that the order is total."""
    order: Column = F.asc(key) if ascending else F.desc(key)
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    firsts = [F.min_by(c, key) if ascending else F.max_by(c, key) for c in next_of]
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_t_{v}") for v in values], *[f.alias(f"_f_{c}") for f, c in zip(firsts, next_of, strict=True)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    after = Window.orderBy("_part")
    parts = parts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b_n"),
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values],
        *[F.lead(f"_f_{c}").over(after).alias(f"_l_{c}") for c in next_of],
    )
    within = Window.partitionBy("_part").orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(parts), "_part")
    return joined.select(
        *df.columns, *[(F.sum(v).over(upto) + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values],
        (F.row_number().over(within) + F.col("_b_n")).alias("ordinal"),
        *[F.coalesce(F.lead(c).over(within), F.col(f"_l_{c}")).alias(f"next_{c}") for c in next_of],
    )


def numbered_within(df: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Adds ``name``, a row's place from 0 among its group's rows by ``order`` (group and order together are unique), and
    ``n_<name>``, the group's rows. Numbered by running counts over all groups, so that no task holds a group."""
    ordinals = running_sums(df.withColumn("_key", F.struct(*group, *order)), "_key", [])
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    spans = materialize(ordinals.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.min("ordinal").alias("_first"), F.count("*").alias(f"n_{name}")))
    joined = ordinals.join(F.broadcast(spans) if spans.count() <= BROADCAST_GROUPS else spans, same)
    return joined.select(*df.columns, (F.col("ordinal") - F.col("_first")).alias(name), f"n_{name}")
