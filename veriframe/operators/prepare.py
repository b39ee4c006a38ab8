"""Manifests and trial lists: restriction, checks, sampling, balancing, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.scalars import round_down, seeded_int, seeded_key, speaker_of
from veriframe.plans.materialize import materialize
from veriframe.plans.prefix_sum import numbered_within, running_sums


def restrict_manifest(manifest: DataFrame, speakers: DataFrame) -> DataFrame:
    return manifest.join(speakers.select("speaker"), "speaker", "left_semi")


def restrict_trials(trials: DataFrame, speakers: DataFrame) -> DataFrame:
    """Trials whose two speakers are both in the set."""
    a = speakers.select(F.col("speaker").alias("_a"))
    b = speakers.select(F.col("speaker").alias("_b"))
    return trials.join(a, speaker_of(F.col("ref")) == F.col("_a"), "left_semi").join(b, speaker_of(F.col("com")) == F.col("_b"), "left_semi")


def first_in_order(rows: DataFrame, n: int, line_no: str = "line_no") -> DataFrame:
    """The first n rows in file order; 0 keeps all."""
    return rows.filter(F.col(line_no) < n) if n else rows


def trial_files(trials: DataFrame) -> DataFrame:
    return trials.select(F.explode(F.array("ref", "com")).alias("path")).distinct()


def missing_files(trials: DataFrame, inventory: DataFrame) -> DataFrame:
    """(line_no, side, path) of every reference to a file that is not in the inventory."""
    sides = F.array(F.struct(F.lit("ref").alias("side"), F.col("ref").alias("path")), F.struct(F.lit("com").alias("side"), F.col("com").alias("path")))
    return trials.select("line_no", F.explode(sides).alias("s")).select("line_no", "s.side", "s.path").join(inventory.select("path"), "path", "left_anti")


def report_head(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows with the number of rows that are left out."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("and_more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")  # one row


def existence_summary(trials: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files referenced and found, and the trials that are lost."""
    files = trial_files(trials)
    found = files.join(inventory.select("path"), "path", "left_semi").agg(F.count("*").alias("n_found"))
    n = files.agg(F.count("*").alias("n_files"))
    lost = missing_files(trials, inventory).agg(F.countDistinct("line_no").alias("n_lost"))
    trials_n = trials.agg(F.count("*").alias("n_trials"))
    one = n.crossJoin(found).crossJoin(lost).crossJoin(trials_n)  # one-row tables
    return one.select("n_files", "n_found", F.try_divide(100.0 * F.col("n_found"), F.col("n_files")).alias("found_pct"), "n_lost", (F.col("n_trials") - F.col("n_lost")).alias("n_left"))


def dataset_statistics(files: DataFrame, speaker: str, size: str) -> DataFrame:
    return files.agg(F.countDistinct(speaker).alias("n_speakers"), F.count("*").alias("n_files"), F.sum(size).alias("total_size")).withColumn("files_per_speaker", F.try_divide(F.col("n_files").cast("double"), F.col("n_speakers")))


def trial_balance(trials: DataFrame) -> DataFrame:
    pos = F.coalesce(F.sum("label"), F.lit(0)).cast("long")
    return trials.agg(F.count("*").alias("total"), pos.alias("positive"), (F.count("*") - pos).alias("negative"), F.try_divide(100.0 * pos, F.count("*")).alias("positive_pct"))


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Speakers that training and test data share."""
    return train.select("speaker").intersect(test.select("speaker"))


def sample_keys(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys without replacement, the same for the same seed, sorted; too few raise."""
    picked = keys.select(key).distinct().withColumn("_k", seeded_key(seed, F.col(key))).orderBy("_k", key).limit(n).drop("_k")
    if picked.count() < n:
        raise ValueError(f"fewer than {n} keys")
    return picked.orderBy(key)


def balance_quotas(positive: int, negative: int, ratio: float) -> tuple[int, int]:
    """How many trials of each class a list with this share of positives takes: sized by twice the smaller class, else by
    all positives, else by all negatives, whichever is the first that both classes can fill. Parts are cut down to whole
    trials."""
    both = 2 * min(positive, negative)
    by_total = int(both * ratio), both - int(both * ratio)
    if by_total[0] <= positive and by_total[1] <= negative:
        return by_total
    by_positives = positive, int(positive * (1 - ratio) / ratio) if ratio else negative + 1
    return by_positives if by_positives[1] <= negative else (int(negative * ratio / (1 - ratio)), negative)


#: Leading characters of an order key that rows are counted by; hashes in hex have 4,096 such beginnings.
LEAD = 3


def _cut(counts: DataFrame, label: int, n: int) -> tuple[str, int] | None:
    """The beginning of the key where a class's ``n`` first rows end, and how many rows of that beginning belong to them;
    None if all rows do. ``counts`` (label, lead, rows) counts rows by the beginnings of their keys."""
    upto = running_sums(counts.filter(F.col("label") == label).select("lead", "rows"), "lead", ["rows"])
    edge = upto.filter(F.col("cum_rows") >= n).agg(F.min(F.struct("lead", "cum_rows", "rows")).alias("e")).first().e
    return edge and (edge.lead, n - edge.cum_rows + edge.rows)


def balanced_trials(trials: DataFrame, order: Column, tie: list[str], ratio: float = 0.5) -> DataFrame:
    """A seeded sample with the given share of positives; without one of the classes, all trials. Each class takes
    its first rows by the order key: counts of the keys' beginnings tell where the cut falls, and only rows there are
    numbered (all rows, if the key is no string), so that no task holds a class or its sample. ``order_key`` stays on the
    rows: a list that is written in its order is shuffled."""
    keyed = trials.withColumn("order_key", order)
    text = keyed.schema["order_key"].dataType.simpleString() == "string"
    keyed = keyed.withColumn("_lead", F.coalesce(F.substring("order_key", 1, LEAD), F.lit("")) if text else F.lit(""))  # null keys come first
    counts = materialize(keyed.groupBy("label", F.col("_lead").alias("lead")).agg(F.count("*").alias("rows"), F.sum("label").alias("p")))
    total = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
    pos, neg = total.p, total.n - total.p
    if not pos or not neg:
        return keyed.drop("_lead")
    take = balance_quotas(pos, neg, ratio)
    cuts = {y: _cut(counts, y, n) for y, n in ((1, take[0]), (0, take[1])) if n}
    below, on_edge = F.lit(False), F.lit(False)
    for y, cut in cuts.items():
        below |= (F.col("label") == y) & (F.col("_lead") < cut[0] if cut else F.lit(True))
        on_edge |= (F.col("label") == y) & (F.col("_lead") == cut[0] if cut else F.lit(False))
    edges, out = materialize(keyed.filter(on_edge)), keyed.filter(below)
    for y, cut in cuts.items():
        if cut:
            numbered = running_sums(edges.filter(F.col("label") == y).withColumn("_at", F.struct("order_key", *tie)), "_at", [])
            out = out.unionByName(numbered.filter(F.col("ordinal") <= cut[1]).select(keyed.columns))
    return out.drop("_lead")


def encode_labels(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_idx``: the value's place among the sorted distinct values, by running counts."""
    ranked = running_sums(rows.select(column).filter(F.col(column).isNotNull()).distinct(), column, [])
    return rows.join(ranked.select(column, (F.col("ordinal") - 1).alias(f"{column}_idx")), column)


def capped_groups(rows: DataFrame, speaker: str, key: str, seed: int, max_per_speaker: int, per_group: int) -> DataFrame:
    """Seeded shuffle, cap and floor: each speaker keeps the largest multiple of ``per_group`` utterances up to the
    cap; adds slot, group_no (the speaker's n-th tuple) and speaker-wise rank."""
    order = Window.partitionBy(speaker).orderBy("_k", key)
    n = F.count("*").over(Window.partitionBy(speaker))
    ranked = rows.withColumn("_k", seeded_key(seed, F.col(key))).withColumn("rank", F.row_number().over(order)).withColumn("_n", n)
    keep = F.least(F.col("_n"), F.lit(max_per_speaker))
    kept = ranked.filter(F.col("rank") <= keep - F.pmod(keep, F.lit(per_group)))
    nth = F.col("rank") - 1
    return kept.withColumn("group_no", F.floor(nth / per_group).cast("long")).withColumn("slot", F.pmod(nth, F.lit(per_group)).cast("int")).drop("_k", "_n")


def batch_plan(groups: DataFrame, speaker: str, seed: int, batch_size: int) -> DataFrame:
    """Round batching: the n-th tuples of all speakers form round n, are ordered by hash and cut into batches; a
    round's remainder is dropped. Speakers in a batch are distinct by construction. Expects one row for each tuple
    (speaker, group_no); adds round, batch_in_round and slot_in_batch. Places are running counts, so no task holds a round."""
    kept = _in_rounds(groups, speaker, seed).filter(F.col("_r") < round_down(F.col("n__r"), batch_size))
    kept = kept.withColumn("batch_in_round", F.floor(F.col("_r") / batch_size).cast("long")).withColumn("slot_in_batch", F.pmod(F.col("_r"), F.lit(batch_size)).cast("int"))
    return kept.withColumnRenamed("group_no", "round").drop("_k", "_r", "n__r")


def _in_rounds(groups: DataFrame, speaker: str, seed: int) -> DataFrame:
    return numbered_within(groups.withColumn("_k", seeded_key(seed, F.col(speaker), F.col("group_no"))), ["group_no"], ["_k", speaker], "_r")


def batch_counts(groups: DataFrame, batch_size: int) -> DataFrame:
    """(round, n_tuples, n_batches, n_kept, n_dropped) of ``batch_plan`` over the same tuples."""
    n = groups.groupBy(F.col("group_no").alias("round")).agg(F.count("*").alias("n_tuples"))
    kept = round_down(F.col("n_tuples"), batch_size)
    return n.select("round", "n_tuples", F.floor(F.col("n_tuples") / batch_size).cast("long").alias("n_batches"), kept.alias("n_kept"), (F.col("n_tuples") - kept).alias("n_dropped"))


def tuples(rows: DataFrame, speaker: str, key: str, size: int) -> DataFrame:
    """All of each speaker's rows in the order of ``key`` (unique), ``size`` to a tuple: adds ``round`` (the tuple's
    number) and ``slot``. Only a speaker's incomplete last tuple goes. Numbered by running counts, so that no task
    holds a speaker."""
    numbered = running_sums(rows.withColumn("_key", F.struct(speaker, key)), "_key", [])
    spans = numbered.groupBy(F.col(speaker).alias("_s")).agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n"))
    k = F.col("ordinal") - F.col("_first")
    whole = numbered.join(spans, F.col(speaker).eqNullSafe(F.col("_s"))).filter(k < round_down(F.col("_n"), size))
    return whole.select(*rows.columns, F.floor(k / size).cast("long").alias("round"), F.pmod(k, F.lit(size)).alias("slot"))


def tuple_batches(rows: DataFrame, speaker: str, seed: int, width: int) -> DataFrame:
    """Adds ``batch_id`` to the rows of ``tuples``: a round is a batch, dealt by hash into batches of about ``width``
    speakers where it has more; nothing is dropped."""
    size = rows.filter("slot = 0").groupBy("round").agg(F.count("*").alias("_n"))
    part = F.pmod(seeded_int(seed, F.col(speaker), F.col("round")), F.ceil(F.col("_n") / width))
    return rows.join(size, "round").withColumn("batch_id", F.concat_ws("-", F.col("round").cast("string"), part.cast("string"))).drop("_n")


def world_slice(rows: DataFrame, position: str, rank: int, world: int, batch_size: int) -> DataFrame:
    """One worker's contiguous share of globally numbered rows (from 0), the total floored to whole batches."""
    total = rows.agg(F.count("*").alias("n")).first().n
    total -= total % (batch_size * world)
    return rows.filter((F.col(position) >= rank * total // world) & (F.col(position) < (rank + 1) * total // world))
