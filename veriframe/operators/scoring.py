"""Trial scoring, prototypes and score normalisation over embedding tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import vectors
from veriframe.functions.registry import Registry
from veriframe.functions.scalars import round_down
from veriframe.plans.materialize import materialize

Scorer = Callable[[Column, Column], Column]
scorers: Registry[Scorer] = Registry("scorer")


def register_scorer(name: str, scorer: Scorer) -> None:
    """Make a pairwise score available by name."""
    scorers.register(name, scorer)


def scorer(name: str) -> Scorer:
    return scorers[name]


register_scorer("euclidean", lambda a, b: -vectors.distance(a, b))
register_scorer("cosine", lambda a, b: vectors.cosine(a, b))
register_scorer("squared", lambda a, b: -vectors.squared_distance(a, b))


def fused_scorer(*own: Scorer) -> Scorer:
    """The mean of several scores of a pair, so that systems over the same vectors are fused without a join of trials."""
    return lambda a, b: reduce(lambda x, y: x + y, [f(a, b) for f in own]) / len(own)


def neighbour_trials(embeddings: DataFrame, reach: int, score: str | Scorer = "euclidean", carry: Sequence[str] = ()) -> DataFrame:
    """Every vector against the next ``reach`` ids: ref, com, label (1 = same speaker), score. ``carry`` names columns
    that follow from both sides, as ``ref_<column>`` and ``com_<column>``; a score may use them.

    Ids are cut into blocks of ``reach``. A vector goes to its own block and to the one or two that it is a neighbour of,
    so three rows a vector are exchanged and pairs are made inside tasks. The exchange is asked for at every size: without
    it a small table's pairs would all be made in the one task that reads its file."""
    own = scorer(score) if isinstance(score, str) else score
    block = lambda c: round_down(c, reach).alias("_block")
    side = lambda name, v, y: [F.col("vec_id").alias(name), F.col("embedding").alias(v), F.col("label").alias(y), *[F.col(c).alias(f"{name}_{c}") for c in carry]]
    left = embeddings.select(block(F.col("vec_id")), *side("ref", "a", "la"))
    blocks = F.array_distinct(F.array(block(F.col("vec_id") - reach), block(F.col("vec_id") - 1)))
    right = embeddings.select(F.explode(blocks).alias("_block"), *side("com", "b", "lb"))
    near = (left["_block"] == right["_block"]) & (F.col("com") > F.col("ref")) & (F.col("com") <= F.col("ref") + reach)
    made = left.hint("merge").join(right, near)
    label = F.when(F.col("la") == F.col("lb"), 1).otherwise(0).alias("label")
    return made.select("ref", "com", label, own(F.col("a"), F.col("b")).alias("score"), *[f"{x}_{c}" for c in carry for x in ("ref", "com")])


def missing_keys(trials: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Referenced utterances without an embedding (empty when a strict join may go ahead)."""
    wanted = trials.select(F.explode(F.array("ref", "com")).alias("utt")).distinct()
    return wanted.join(embeddings.select("utt").distinct(), "utt", "left_anti")


def score_trials(trials: DataFrame, embeddings: DataFrame, normalize: bool = True, strict: bool = False) -> DataFrame:
    """Minus the mean Euclidean distance over all crop pairs of each trial (ref, com, label); crops are matched by
    utterance, so any number of crops a side will do. Unmatched trials are left out, or raise with ``strict``."""
    if strict and not missing_keys(trials, embeddings).isEmpty():
        raise ValueError("a trial refers to an utterance that has no embedding")
    v = vectors.normalized(F.col("embedding")) if normalize else F.col("embedding")
    crops = embeddings.select("utt", v.alias("v"))
    keyed = trials.withColumn("trial_id", F.xxhash64("ref", "com", "line_no") if "line_no" in trials.columns else F.xxhash64("ref", "com"))
    pairs = keyed.join(crops.select(F.col("utt").alias("ref"), F.col("v").alias("a")), "ref").join(crops.select(F.col("utt").alias("com"), F.col("v").alias("b")), "com")
    group = [c for c in ("trial_id", "line_no", "ref", "com", "label") if c in keyed.columns]
    return pairs.groupBy(*group).agg((-F.avg(vectors.distance(F.col("a"), F.col("b")))).alias("score"))


def merge_results(parts: DataFrame, key: str, rank: str) -> DataFrame:
    """Results of several workers; for a key that several have, the highest rank's row stays, and of equal ranks the one
    whose other columns, in the table's order, are smallest (nulls are last)."""
    ties = [F.asc_nulls_last(c) for c in parts.columns if c not in (key, rank)]
    best = Window.partitionBy(key).orderBy(F.desc_nulls_last(rank), *ties)
    return parts.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def prototypes(embeddings: DataFrame, group: str | list[str]) -> DataFrame:
    """Element-wise mean vector of each group. Sums are taken by position, so no group's vectors are collected."""
    keys = [group] if isinstance(group, str) else list(group)
    by = embeddings.select(*keys, F.posexplode("embedding").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return by.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))  # D entries a group


def group_sums(embeddings: DataFrame, group: str) -> DataFrame:
    by = embeddings.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return by.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda s: s["s"]).alias("total"))


def leave_one_out(embeddings: DataFrame, group: str) -> DataFrame:
    """Each row with the centroid of its group's other members (null when it has none)."""
    joined = embeddings.join(group_sums(embeddings, group), group)
    rest = F.when(F.col("n") > 1, F.zip_with("total", "embedding", lambda t, x: (t - x.cast("double")) / (F.col("n") - 1)))
    return joined.select(*embeddings.columns, rest.alias("loo_centroid"))


def against_classes(rows: DataFrame, classes: DataFrame, max_bytes: int = 256 << 20) -> DataFrame:
    """Every row with every class: the class table (cls, w) is broadcast, behind a check of its bytes."""
    size = classes.agg(F.coalesce(F.sum(8 * F.size("w") + 16), F.lit(0)).alias("bytes")).first().bytes
    if size > max_bytes:
        raise ValueError(f"the classes have {size} bytes, more than {max_bytes}: score in blocks (cohort.top_statistics)")
    return rows.crossJoin(F.broadcast(classes))


def side_statistics(cohort: DataFrame, top_n: int = 200) -> DataFrame:
    """(side, mu, sigma): mean and population deviation of each side's best ``top_n`` rows of ``cohort`` (side,
    cohort_id, cohort_score)."""
    best = Window.partitionBy("side").orderBy(F.desc("cohort_score"), F.asc("cohort_id"))
    return cohort.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top_n).groupBy("side").agg(F.avg("cohort_score").alias("mu"), F.stddev_pop("cohort_score").alias("sigma"))


def with_statistics(embeddings: DataFrame, statistics: DataFrame) -> DataFrame:
    """The vectors that have statistics, with ``mu`` and ``sigma``: trials made of them carry both, so that no table of
    trials is joined to its sides."""
    return embeddings.join(statistics.select(F.col("side").alias("vec_id"), "mu", "sigma"), "vec_id")


def standardised(score: Column, mu: str, sigma: str) -> Column:
    return (score - F.col(mu)) / (F.col(sigma) + 1e-6)


def normalized_score(score: Column) -> Column:
    """Adaptive normalisation of trials that carry mu and sigma: the mean of both sides' standardised scores."""
    return (standardised(score, "ref_mu", "ref_sigma") + standardised(score, "com_mu", "com_sigma")) / 2


def normalized_by(scores: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds ``norm_score`` to any list of trials (ref, com, score): as above, with the statistics joined to both sides."""
    known = materialize(statistics)
    sides = [known.select(F.col("side").alias(x), F.col("mu").alias(f"{x}_mu"), F.col("sigma").alias(f"{x}_sigma")) for x in ("ref", "com")]
    return scores.join(sides[0], "ref").join(sides[1], "com").withColumn("norm_score", normalized_score(F.col("score"))).drop("ref_mu", "ref_sigma", "com_mu", "com_sigma")


def score_normalized(scores: DataFrame, cohort: DataFrame, top_n: int = 200) -> DataFrame:
    """Adaptive score normalisation of any list of trials by the best ``top_n`` scores of each side."""
    return normalized_by(scores, side_statistics(cohort, top_n))


def fused(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Mean of two systems' scores of the same trials."""
    other = b.select(*key, F.col("score").alias("_other"))
    return a.join(other, key).withColumn("score", (F.col("score") + F.col("_other")) / 2).drop("_other")
