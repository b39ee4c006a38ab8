"""Metric-learning losses and accuracies as jobs over embedding tables (values only, no gradients)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import vectors
from veriframe.functions.registry import Registry
from veriframe.functions.scalars import seeded_int, seeded_uniform
from veriframe.operators.scoring import against_classes, group_sums


def cross_entropy(scores: DataFrame, row: list[str], is_target: str = "is_target", score: str = "score") -> DataFrame:
    """Mean negative log-likelihood and top-1 accuracy (percent) of a long score matrix: one aggregation a row with
    a max-shifted log-sum-exp, then the mean. Ties count for the target."""
    own = F.max(F.when(F.col(is_target), F.col(score)))
    per = scores.withColumn("_top", F.max(score).over(Window.partitionBy(*row)))
    per = per.groupBy(*row).agg(F.max("_top").alias("top"), F.sum(F.exp(F.col(score) - F.col("_top"))).alias("z"), own.alias("own"))
    return per.agg(F.avg(F.col("top") + F.log("z") - F.col("own")).alias("loss"), (100 * F.avg((F.col("own") >= F.col("top")).cast("double"))).alias("accuracy"), F.count("*").alias("n_rows"))


def top_k_accuracy(scores: DataFrame, row: list[str], k: int, is_target: str = "is_target", score: str = "score", tie: str = "cls") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(F.desc(score), F.asc(tie)))
    hit = scores.withColumn("_r", rank).filter(F.col(is_target))
    return hit.agg((100 * F.avg((F.col("_r") <= k).cast("double"))).alias("topk_pct"), F.count("*").alias("n_rows"))


def _queries_and_centroids(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slot 0 is a speaker's query; the mean of its other slots is its centroid. Keys: batch_id, speaker."""
    queries = batch.filter("slot = 0").select("batch_id", "speaker", F.col("embedding").alias("q"))
    by = batch.filter("slot > 0").select("batch_id", "speaker", F.posexplode("embedding").alias("pos", "x")).groupBy("batch_id", "speaker", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cents = by.groupBy("batch_id", F.col("speaker").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    return queries, cents


def prototypical_scores(batch: DataFrame, kind: str = "proto", w: float = 10.0, b: float = -5.0) -> DataFrame:
    """(batch_id, speaker, cls, score, is_target) of every query against its batch's centroids, an equi-join on the
    batch: minus squared distance (``proto``) or scaled cosine (``angular``)."""
    queries, cents = _queries_and_centroids(batch)
    q, c = F.col("q"), F.col("c")
    score = -vectors.squared_distance(q, c, eps=1e-6) if kind == "proto" else vectors.cosine(q, c) * w + b
    return queries.join(cents, "batch_id").select("batch_id", "speaker", "cls", score.alias("score"), (F.col("speaker") == F.col("cls")).alias("is_target"))


def prototypical_loss(batch: DataFrame, kind: str = "proto") -> DataFrame:
    return cross_entropy(prototypical_scores(batch, kind), ["batch_id", "speaker"])


def ge2e_scores(batch: DataFrame, w: float = 10.0, b: float = -5.0) -> DataFrame:
    """Every slot is a query; against its own class the centroid leaves it out; cosines are at least 1e-6."""
    keyed = batch.withColumn("g", F.concat_ws("|", F.col("batch_id").cast("string"), F.col("speaker").cast("string")))
    sums = keyed.select("batch_id", "speaker", "g").distinct().join(group_sums(keyed, "g"), "g")
    right = sums.select("batch_id", F.col("speaker").alias("cls"), "n", "total")
    pairs = batch.join(right, "batch_id")
    own = F.col("speaker") == F.col("cls")
    rest = F.zip_with("total", "embedding", lambda t, x: F.when(own, (t - x.cast("double")) / (F.col("n") - 1)).otherwise(t / F.col("n")))
    pairs = pairs.filter(~own | (F.col("n") > 1)).withColumn("c", rest)
    cos = F.greatest(vectors.cosine(F.col("embedding"), F.col("c")), F.lit(1e-6))
    return pairs.select("batch_id", "speaker", "slot", "cls", (cos * w + b).alias("score"), own.alias("is_target"))


def ge2e_loss(batch: DataFrame) -> DataFrame:
    return cross_entropy(ge2e_scores(batch), ["batch_id", "speaker", "slot"])


def class_scores(rows: DataFrame, classes: DataFrame, kind: str = "softmax", scale: float = 30.0, margin: float = 0.2, dim: int | None = None) -> DataFrame:
    """Rows (row_id, label, embedding) against the class table (cls, w): plain dot products or margin logits."""
    pairs = against_classes(rows, classes)
    own = F.col("label") == F.col("cls")
    if kind == "dot":
        score = vectors.dot(F.col("embedding"), F.col("w"), dim)
    else:
        # the cosine in a projection of its own: the margin uses it several times
        pairs = pairs.withColumn("_cos", vectors.cosine(F.col("embedding"), F.col("w"), dim))
        score = vectors.margin_logit(F.col("_cos"), own, scale, margin, kind)
    return pairs.select("row_id", "label", "cls", score.alias("score"), own.alias("is_target"))


def classification_loss(rows: DataFrame, classes: DataFrame, kind: str, **options) -> DataFrame:
    return cross_entropy(class_scores(rows, classes, kind, **options), ["row_id"])


def combined_loss(rows: DataFrame, classes: DataFrame, batch: DataFrame) -> DataFrame:
    """Sum of the softmax loss over all rows and the angular prototypical loss."""
    a = classification_loss(rows, classes, "dot").select(F.col("loss").alias("a"))
    b = prototypical_loss(batch, "angular").select(F.col("loss").alias("b"))
    return a.crossJoin(b).select((F.col("a") + F.col("b")).alias("loss"))  # one-row tables


def mined_negatives(batch: DataFrame, kind: str = "semi_hard", margin: float = 0.1, hard_rank: int = 0, seed: int = 0, hard_prob: float = 1.0) -> DataFrame:
    """One negative for each anchor (slot 0) among the batch's other speakers (slot 1), by similarity -||a - b||^2:
    the hash-first of those between the positive's similarity minus the margin and it (``semi_hard``, any negative
    where none is), or (``rank``), for a share ``hard_prob`` of the anchors chosen by hash, the hash-first of the
    ``hard_rank + 1`` most similar, and for the other anchors the hash-first of all."""
    anchors = batch.filter("slot = 0").select("batch_id", "speaker", F.col("embedding").alias("a"))
    others = batch.filter("slot = 1").select("batch_id", F.col("speaker").alias("neg"), F.col("embedding").alias("b"))
    pairs = anchors.join(others, "batch_id").withColumn("sim", -vectors.squared_distance(F.col("a"), F.col("b"), eps=1e-6))
    positive = pairs.filter("speaker = neg").select("batch_id", "speaker", F.col("sim").alias("pos_sim"))
    rest = pairs.filter("speaker <> neg").join(positive, ["batch_id", "speaker"]).withColumn("_h", seeded_int(seed, F.col("speaker"), F.col("neg")))
    by = Window.partitionBy("batch_id", "speaker")
    if kind == "semi_hard":
        fits = (F.col("sim") < F.col("pos_sim")) & (F.col("sim") > F.col("pos_sim") - margin)
        rest = rest.withColumn("_out", (~fits).cast("int"))
    else:
        hard = seeded_uniform(seed, F.col("speaker"), F.lit("hard")) < hard_prob
        rest = rest.withColumn("_out", (hard & (F.row_number().over(by.orderBy(F.desc("sim"), "neg")) > hard_rank + 1)).cast("int"))
    first = F.row_number().over(by.orderBy("_out", "_h", "neg"))
    return rest.withColumn("_r", first).filter("_r = 1").select("batch_id", "speaker", "neg", "pos_sim", F.col("sim").alias("neg_sim"))


def triplet_loss(batch: DataFrame, margin: float = 0.1, **options) -> DataFrame:
    mined = mined_negatives(batch, margin=margin, **options)
    hinge = F.greatest(F.lit(0.0), -F.col("pos_sim") + F.col("neg_sim") + margin)
    return mined.agg(F.avg(hinge).alias("loss"), F.count("*").alias("n_rows"))


def triplet_trials(batch: DataFrame, **options) -> DataFrame:
    """The mined pairs as scored trials, for the detection metrics."""
    mined = mined_negatives(batch, **options)
    pair = lambda y, c: F.struct(F.lit(y).alias("label"), F.col(c).alias("score"))
    return mined.select(F.explode(F.array(pair(1, "pos_sim"), pair(0, "neg_sim"))).alias("t")).select("t.label", "t.score")


def distillation(student: DataFrame, teacher: DataFrame, kind: str = "mse", temperature: float = 1.0) -> DataFrame:
    """Mean distance of student and teacher embeddings of the same utterance: mse (of unit-length vectors over the
    temperature), cosine (1 - cos), or kl (batch mean of the softened divergence)."""
    pairs = student.select("utt", F.col("embedding").alias("s")).join(teacher.select("utt", F.col("embedding").alias("t")), "utt")
    s, t = F.col("s"), F.col("t")
    value: Column = {
        "mse": vectors.squared_distance(vectors.normalized(s), vectors.normalized(t)) / (temperature**2) / F.size("s"),
        "cosine": 1 - vectors.cosine(s, t),
        "kl": vectors.kl_divergence(s, t, temperature),
    }[kind]
    return pairs.agg(F.avg(value).alias("distance"), F.count("*").alias("n_rows"))


def blended(classification: Column, distance: Column, alpha: float) -> Column:
    return (1 - alpha) * classification + alpha * distance


#: Losses over (rows, classes) or over a batch, by name; every one gives a row (loss, ...).
class_losses: Registry[Callable[..., DataFrame]] = Registry("class loss")
batch_losses: Registry[Callable[..., DataFrame]] = Registry("batch loss")
class_losses.register("softmax", lambda rows, classes, **o: classification_loss(rows, classes, "dot", **o))
class_losses.register("amsoftmax", lambda rows, classes, **o: classification_loss(rows, classes, "am", **o))
class_losses.register("aamsoftmax", lambda rows, classes, **o: classification_loss(rows, classes, "aam", **o))
batch_losses.register("proto", lambda batch, **o: prototypical_loss(batch, "proto", **o))
batch_losses.register("angleproto", lambda batch, **o: prototypical_loss(batch, "angular", **o))
batch_losses.register("ge2e", ge2e_loss)
batch_losses.register("triplet", triplet_loss)
