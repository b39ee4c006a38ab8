"""Mixing sources to target weights by entropy balancing.

Targets are water-filled from cyclic weights with a ceiling of ``cap`` times a source's size. The documents' rates
have the least relative entropy to their prior rates among all that meet one token constraint a source,
``sum(size * rate) = target``; so a rate is an exponential tilt by the document's tokens, ``prior * exp(lambda *
size)``, held at ``cap`` at most. The convex dual has one multiplier a source and starts at 0; documents of equal
source, size and prior are counted once, and a Newton step is one aggregation of these counts (gradient and curvature
for each source). Sums are exact decimals, so reruns take the same steps.
Rates are rounded to whole copies: systematic rounding along a running sum of rates inside strata (source, size
class, hash part), then a repair over all documents: from the counts of documents by size and copies it decides how
many copies each size gains or loses, until a source's words are as near its target as that gets them, and hash
ranks say which documents move. What is left is less than the smallest size that can still move.

Defined cases: null or empty texts have size 0, rate ``prior`` and taken 0; a null source is a source of its own, last
in order; an empty table gives an empty table; repeated rows are separate documents; other columns are ignored,
whatever their names; texts are read whole, equal sizes share a stratum. Newton steps that do not converge raise an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import WORD_PATTERN, cut, few_entries, free_name, quoted

#: Documents of a source and size class that are rounded in one part; more make more parts.
PART_DOCS = 20_000
#: Newton steps after which the dual counts as not converged, and the relative error of a target that ends them.
NEWTON_STEPS = 100
TOLERANCE = 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, target. The level t of ``min(cap * size, t * weight)`` rises until
    all words are dealt out; each pass is one small aggregation."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source; UTF-8 binary order is code point order
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    per = per.withColumn("_k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % n + 1).cast("int"))
    per = cut(per.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")))
    level = -1.0
    while True:
        full = F.col("_w") * level > F.col("_cap")
        got = per.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("open"),
        ).first()
        new = (got.total - got.capped) / got.open if got.open else level
        if new <= level:
            break
        level = new
    return per.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.coalesce(F.sum(x.cast("decimal(30,6)")).cast("double"), F.lit(0.0))


def _tilted(cap: float) -> Column:
    """``prior * exp(lam * size / mean)``, at most ``cap``; ``lam`` counts in documents of the source's mean size."""
    room = F.log(F.lit(float(cap)) / F.col("prior"))
    return F.when(F.col("size") == 0, F.least(F.col("prior"), F.lit(float(cap)))).otherwise(F.col("prior") * F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), room)))


def solve_dual(docs: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target, mean, lam and steps (Newton steps taken) of every source. ``docs`` has source,
    size and prior (> 0), ``targets`` the first three columns."""
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    counted = cut(docs.filter("size > 0").groupBy("source", "size", "prior").agg(F.count("*").alias("n")))
    means = counted.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    state = targets.alias("t").join(F.broadcast(means.alias("d")), same, "left")
    state = cut(state.select("t.source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high"), F.lit(0).alias("steps"), F.lit(True).alias("open")))
    for _ in range(NEWTON_STEPS):
        tilted = counted.alias("d").join(F.broadcast(state.filter("open").alias("t")), same)
        tilted = tilted.select("t.source", "size", "n", "mean", _tilted(cap).alias("rate"))
        words = F.col("n") * F.col("size") * F.col("rate")
        sums = tilted.groupBy("source").agg(_exact(words).alias("got"), _exact(F.when(F.col("rate") < cap * (1 - 1e-12), words * F.col("size") / F.col("mean"))).alias("slope"))
        off = F.col("target") - F.col("got")
        # decimals of six places: each count may be off by half of the last one
        open_ = F.col("open") & (F.abs(off) > TOLERANCE * F.col("target")) & ((F.col("slope") > 0) | (off < 0))
        low = F.when(off > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off < 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") + F.when(F.col("slope") > 0, off / F.col("slope")).otherwise(F.lit(-1.0))
        moved = state.alias("t").join(F.broadcast(sums.alias("d")), same, "left")
        moved = moved.select("t.source", "source_size", "target", "mean", "lam", "steps", low.alias("low"), high.alias("high"), step.alias("step"), F.coalesce(open_, F.lit(False)).alias("open"))
        # a step that leaves the bracket (the clipped dual has kinks) is replaced by the bracket's middle
        inside = (F.col("low").isNull() | (F.col("step") > F.col("low"))) & (F.col("high").isNull() | (F.col("step") < F.col("high")))
        new = F.when(~F.col("open"), F.col("lam")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut(moved.select("source", "source_size", "target", "mean", new.alias("lam"), "low", "high", (F.col("steps") + F.col("open").cast("int")).alias("steps"), "open"))
        if not state.filter("open").limit(1).count():
            return state.select("source", "source_size", "target", "mean", "lam", "steps")
    raise RuntimeError(f"the mixture's dual did not converge in {NEWTON_STEPS} Newton steps")


def balance(docs: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """``docs`` (source, size, prior and others) with source_size, target and the tilted ``rate``."""
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    # one row a source
    joined = docs.alias("d").join(F.broadcast(solve_dual(docs, targets, cap).alias("t")), same)
    return joined.select("d.*", "source_size", "target", "mean", "lam").withColumn("rate", _tilted(cap)).drop("mean", "lam")


def moved_units(gap: float, sizes: list[int], up: list[int], down: list[int], docs: list[int]) -> list[int]:
    """How many copies each size (ascending) gains or loses so that the words come as near ``gap`` as they get:
    from the largest size down as many as fit, one a document before any gets two; then, while that brings them
    nearer, one copy beyond the gap and the way back. ``up`` and ``down`` are the copies a size can gain and lose."""
    moved = [0] * len(sizes)

    def room(k: int, sign: int) -> int:
        return up[k] - moved[k] if sign > 0 else down[k] + moved[k]

    def fill(gap: float, but: int = -1) -> float:
        sign = 1 if gap > 0 else -1
        while True:
            before = gap
            for k in range(len(sizes) - 1, -1, -1):
                n = min(room(k, sign), docs[k], int(abs(gap) // sizes[k])) if k != but else 0
                moved[k] += sign * n
                gap -= sign * n * sizes[k]
            if gap == before:
                return gap

    gap = fill(gap)
    while gap:
        sign = 1 if gap > 0 else -1
        over = next((k for k in range(len(sizes)) if sizes[k] > abs(gap) and room(k, sign) > 0), None)
        if over is None:
            break
        kept = list(moved)
        moved[over] += sign
        after = fill(gap - sign * sizes[over], over)
        if abs(after) >= abs(gap):
            moved[:] = kept
            break
        gap = after
    return moved


def _levels(counts: list[int], moved: int) -> tuple[int, int]:
    """(level, rest): documents of one size rise (fall) to the level at least (at most), and ``rest`` of those
    then at it go one further."""
    order = range(len(counts) - 1) if moved > 0 else range(len(counts) - 1, 0, -1)
    left, here = abs(moved), 0
    for level in order:
        here += counts[level]
        if left < here:
            return level, left
        left -= here
    return (len(counts) - 1 if moved > 0 else 0), 0


def _repair(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The moves of one source, from its sizes and the number of documents with 0, 1, ... copies of each."""
    group = group.sort_values("size")
    sizes, counts = group["size"].tolist(), [list(map(int, c)) for c in group["counts"]]
    cap = len(counts[0]) - 1
    down = [sum(c * n for c, n in enumerate(x)) for x in counts]
    docs = [sum(x) for x in counts]
    moved = moved_units(float(group["gap"].iloc[0]), sizes, [cap * n - d for n, d in zip(docs, down, strict=True)], down, docs)
    rows = [(key[0], size, m > 0, *_levels(x, m)) for size, x, m in zip(sizes, counts, moved, strict=True) if m]
    return pd.DataFrame(rows, columns=["source", "size", "up", "level", "rest"])


def round_to_copies(rated: DataFrame, cap: int = 3) -> DataFrame:
    """Whole copies for each document (uid, source, size, rate, target); reruns give the same copies."""
    h = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), F.lit("round"))
    size_class = F.length(F.conv(F.col("size").cast("string"), 10, 2))
    strata = rated.withColumn("_h", h).withColumn("_class", size_class)
    # one row for each source and size class
    parts = strata.groupBy("source", "_class").agg(F.ceil(F.count("*") / PART_DOCS).alias("_parts"))
    in_class = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._class") == F.col("p._class"))
    strata = strata.alias("d").join(F.broadcast(parts.alias("p")), in_class).select("d.*", F.pmod("_h", "_parts").alias("_part"))
    within = Window.partitionBy("source", "_class", "_part").orderBy(F.xxhash64("_h"), "doc_id", "uid")
    start = F.pmod(F.xxhash64(F.coalesce(F.col("source"), F.lit("\0")), "_class", "_part"), F.lit(1 << 20)) / float(1 << 20)
    upto = F.sum("rate").over(within.rowsBetween(Window.unboundedPreceding, 0)) + start
    copies = F.floor(F.col("_upto") + 1e-7) - F.coalesce(F.floor(F.lag("_upto").over(within) + 1e-7), F.lit(0))
    first = cut(strata.withColumn("_upto", upto).withColumn("copies", F.least(F.lit(cap), F.greatest(F.lit(0), copies)).cast("long")).drop("_upto"))
    gaps = first.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    gaps = gaps.filter("gap <> 0")
    # a source of n words has sqrt(2 n) different sizes at most, so one task can choose among them
    sizes = first.filter("size > 0").groupBy("source", "size").agg(F.array(*[F.count_if(F.col("copies") == k) for k in range(cap + 1)]).alias("counts"))
    sizes = sizes.alias("d").join(gaps.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "gap")
    moves = cut(sizes.groupBy("source").applyInPandas(_repair, "source string, size long, up boolean, level long, rest long"))
    same = F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size"))
    placed = first.alias("d").join(F.broadcast(moves.alias("m")), same, "left").select("d.*", "up", "level", "rest")
    stays = F.when(F.col("up"), F.greatest("copies", "level")).when(~F.col("up"), F.least("copies", "level")).otherwise(F.col("copies"))
    placed = placed.withColumn("copies", stays)
    # the rest: by hash rank among the documents of the size at its level, counted in parts
    at_level = placed.filter("rest > 0 and copies = level").select("uid", "doc_id", "source", "size", "up", "rest", "_h", "_part")
    parts = at_level.groupBy("source", "size", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    in_part = Window.partitionBy("source", "size", "_part").orderBy(F.xxhash64("_h"), "doc_id", "uid")
    ranked = at_level.withColumn("_r", F.row_number().over(in_part))
    place = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d._part") == F.col("p._part"))
    chosen = ranked.alias("d").join(F.broadcast(parts.alias("p")), place).filter(F.col("_r") + F.col("_before") <= F.col("rest"))
    chosen = chosen.select("d.uid", F.when(F.col("d.up"), 1).otherwise(-1).alias("move"))
    return placed.join(chosen, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move", "up", "level", "rest", "_h", "_class", "_part")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, prior: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken and uid (the row's place) for every document."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        (prior if prior is not None else F.lit(1.0)).alias("prior"), F.monotonically_increasing_id().alias("uid"),
    )
    base = cut(base)
    rated = balance(base, source_targets(base, weights, cap), cap)
    mixed = round_to_copies(rated, cap)
    return mixed.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "uid")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the columns it came with. The input must
    read the same rows in the same order each time (a table or a written intermediate result)."""
    own, copies, copy = (free_name(docs, name) for name in ("uid", "copies", "copy"))
    taken = cut(mix(docs, weights, cap).filter("copies > 0").select(F.col("uid").alias(own), F.col("copies").cast("int").alias(copies)))
    placed = docs.withColumn(own, F.monotonically_increasing_id()).join(F.broadcast(taken) if few_entries(taken) else taken, own)
    return placed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*quoted(docs))
