"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a minimum by node and a join, so nothing is gathered at one node: a hub's neighbours are aggregated
before the exchange and the join may be split where it is skewed. The number of steps grows with the logarithm of
the number of nodes. Links with a null end are ignored; loops and repeated links do no harm; an empty table gives
an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut


def _star(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; the root is the component's smallest node."""
    a, b = links.columns[:2]
    own = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    own = cut(own.distinct())
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    before = mark(own)
    while before.n:
        own = cut(_star(own))
        after = mark(own)
        if after == before:
            break
        before = after
    roots = own.select("v").distinct()
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
