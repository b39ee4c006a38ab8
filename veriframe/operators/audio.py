"""Crops, segments, augmentation plans and frame features over audio tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.scalars import frames_to_samples, level_db, mixed, noise_gain, seeded_int, seeded_uniform
from veriframe.plans.prefix_sum import numbered_within

#: Category, lowest and highest signal-to-noise ratio (dB), fewest and most noises.
NOISE_POLICY = (("noise", 0, 15, 1, 1), ("speech", 13, 20, 3, 7), ("music", 5, 15, 1, 1))
#: Augmentation types in order, equally likely.
AUGMENTATIONS = ("clean", "reverb", "music", "speech", "noise")


def sliding_segments(rows: DataFrame, samples: str, size: int = 80_000, hop: int = 48_000, rate: int = 16_000) -> DataFrame:
    """A row for each window start in [0, n - size) by ``hop``; clips that are not longer than a window have none.
    ``name`` is the start second."""
    n = F.col(samples).cast("long")
    starts = F.when(n > size, F.sequence(F.lit(0).cast("long"), n - size - 1, F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = rows.withColumn("start", F.explode(starts))
    return out.withColumn("length", F.lit(size)).withColumn("name", F.format_string("%05d", F.floor(F.col("start") / rate)))


def evaluation_crops(rows: DataFrame, samples: str, frames: int = 300, crops: int = 10) -> DataFrame:
    """Evenly spaced crops; a clip up to the window's length counts as padded to one sample more; frames = 0 takes
    the whole clip once."""
    n = F.col(samples).cast("long")
    if not frames:
        return rows.withColumn("crop_id", F.lit(0)).withColumn("start", F.lit(0).cast("long")).withColumn("length", n)
    size = frames * 160 + 240
    full = F.when(n <= size, F.lit(size + 1).cast("long")).otherwise(n)
    start = lambda i: F.floor(i * (full - size) / max(crops - 1, 1)).cast("long")
    ids = F.sequence(F.lit(0), F.lit(crops - 1))
    out = rows.withColumn("crop_id", F.explode(ids))
    return out.withColumn("start", start(F.col("crop_id").cast("long"))).withColumn("length", F.lit(size).cast("long"))


def training_crop(rows: DataFrame, samples: str, key: str, frames: int = 200, seed: int = 0) -> DataFrame:
    size = frames_to_samples(F.lit(frames))
    n = F.greatest(F.col(samples).cast("long"), size.cast("long") + 1)
    return rows.withColumn("start", F.floor(seeded_uniform(seed, F.col(key)) * (n - size)).cast("long")).withColumn("length", size.cast("long"))


def augmentation_plan(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    kind = F.pmod(seeded_int(seed, F.col(key)), F.lit(len(AUGMENTATIONS)))
    return rows.withColumn("augmentation", F.element_at(F.array(*[F.lit(a) for a in AUGMENTATIONS]), (kind + 1).cast("int")))


def distinct_draws(n: Column, k: Column, seed: int, *key: Column) -> Column:
    """``k`` different numbers of 0 to n - 1 (k <= n), every set of them equally likely: the i-th draw is uniform over
    the first n - k + i + 1 numbers, and one that was drawn before gives way to the newest of these."""
    draw = lambda i: F.pmod(seeded_int(seed, *key, i), n - k + i + 1)
    step = lambda had, i: F.array_append(had, F.when(F.array_contains(had, draw(i)), n - k + i).otherwise(draw(i)))
    none = F.array().cast("array<bigint>")
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), none, step)).otherwise(none)


def noise_plan(rows: DataFrame, key: str, pool: DataFrame, policy: tuple = NOISE_POLICY, seed: int = 0) -> DataFrame:
    """Noises for each row by its ``augmentation`` category: a seeded count, that many different files drawn
    independently of each other, and a uniform ratio each. Pool files (category, path; unique) are numbered in their
    category by running counts, and the drawn numbers are joined to them, so rows are not multiplied by the pool. A
    category without files, or an empty pool, gives no rows."""
    numbered = numbered_within(pool, ["category"], ["path"])
    sizes = pool.groupBy("category").agg(F.count("*").alias("pool_size"))
    rules = rows.sparkSession.createDataFrame(list(policy), "category string, snr_lo int, snr_hi int, n_lo int, n_hi int")
    chosen = rows.withColumnRenamed("augmentation", "category").join(F.broadcast(rules), "category").join(F.broadcast(sizes), "category")  # one row a category
    k = F.least(F.col("n_lo") + F.pmod(seeded_int(seed + 1, F.col(key)), F.col("n_hi") - F.col("n_lo") + 1), F.col("pool_size"))
    drawn = chosen.withColumn("n_noises", k).select("*", F.posexplode(distinct_draws(F.col("pool_size"), F.col("n_noises"), seed + 2, F.col(key))).alias("noise_no", "nth"))
    snr = F.col("snr_lo") + seeded_uniform(seed + 3, F.col(key), F.col("noise_no")) * (F.col("snr_hi") - F.col("snr_lo"))
    return drawn.join(numbered, ["category", "nth"]).select(key, "category", "noise_no", "path", snr.alias("snr_db"))


def apply_noise(rows: DataFrame, clean: str, noise: str, snr: str) -> DataFrame:
    """Adds ``mixed``: the clean samples plus the noise at the wanted ratio."""
    one = F.array(F.struct(F.col(noise).alias("samples"), F.col(snr).alias("snr_db")))
    return apply_noises(rows.withColumn("_noises", one), clean, "_noises").drop("_noises")


def apply_noises(rows: DataFrame, clean: str, noises: str) -> DataFrame:
    """Adds ``mixed``: the clean samples plus all noises (array of samples, snr_db), each scaled to its own ratio to the
    clean level. Shorter noises end early; without noises the clip stays."""
    level = rows.withColumn("_level", level_db(F.col(clean)))
    gain = lambda x: noise_gain(F.col("_level"), level_db(x["samples"]), x["snr_db"])
    total = F.aggregate(noises, F.transform(clean, lambda x: x.cast("double")), lambda a, x: mixed(a, x["samples"], gain(x)))
    return level.withColumn("mixed", F.coalesce(total, F.transform(clean, lambda x: x.cast("double")))).drop("_level")


def mix_noises(clips: DataFrame, plan: DataFrame, noises: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """Adds ``mixed`` to clips (key, samples) by a noise plan and the noises' samples (path, samples). A clip's noises are
    few (the policy's most), so they are gathered; clips without any stay as they are."""
    own = plan.join(noises.select("path", F.col(samples).alias("_samples")), "path")
    gathered = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("noise_no", F.col("_samples").alias("samples"), "snr_db"))).alias("_noises"))
    return apply_noises(clips.join(gathered, key, "left"), samples, "_noises").drop("_noises")


def overlap_add(x: np.ndarray, response: np.ndarray, spectra: dict | None = None) -> np.ndarray:
    """The first ``len(x)`` samples of the convolution with ``response``, in blocks of Fourier transforms: n log m
    steps for n samples and m of the response. ``spectra`` keeps responses' spectra from call to call."""
    m = len(response)
    size = 1 << max(10, (4 * m - 1).bit_length())
    step = size - m + 1
    name = response.tobytes()
    spectra = {} if spectra is None else spectra
    if name not in spectra:
        if len(spectra) >= 16:
            spectra.clear()
        spectra[name] = np.fft.rfft(response, size)
    n_blocks = -(-len(x) // step)
    out = np.zeros((n_blocks + 1) * step)
    for a in range(0, n_blocks, 256):  # so many blocks at once
        part = x[a * step : (a + 256) * step]
        rows = -(-len(part) // step)
        blocks = np.zeros((rows, step))
        blocks.reshape(-1)[: len(part)] = part
        made = np.fft.irfft(np.fft.rfft(blocks, size, axis=1) * spectra[name], size, axis=1)
        own = out[a * step : (a + rows + 1) * step].reshape(-1, step)
        own[:-1] += made[:, :step]
        own[1:, : m - 1] += made[:, step:]
    return out[: len(x)].copy()  # a view would keep whole blocks of a short clip in memory


def apply_reverb(rows: DataFrame, samples: str, response: str) -> DataFrame:
    """Adds ``reverbed``: convolution with the unit-energy response, cut to the clip's length. A clip without response
    (null or empty) stays; a null clip is null."""

    @F.pandas_udf("array<double>")
    def convolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        spectra: dict = {}
        for x, h in parts:
            out = []
            for a, b in zip(x, h, strict=True):
                if a is None or b is None or not len(a) or not len(b):
                    out.append(None if a is None else list(a))
                    continue
                b = np.asarray(b, dtype=float)
                out.append(overlap_add(np.asarray(a, dtype=float), b / np.sqrt(max((b**2).sum(), 1e-12)), spectra))
            yield pd.Series(out)

    return rows.withColumn("reverbed", convolve(samples, response))


def mel_filters(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


#: Frames whose spectra are made at once.
FRAMES = 4_096


def mel_spectra(x: np.ndarray, filters: np.ndarray, n_fft: int, window: int, hop: int, log: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, mel values of up to FRAMES frames): frame k is centred on sample k * hop, the clip is mirrored at
    its ends, and the periodic Hamming window lies in the middle of the transform. 1 + len(x) // hop frames in all."""
    taper = np.zeros(n_fft)
    lead = (n_fft - window) // 2
    taper[lead : lead + window] = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(window) / window)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, n_fft // 2, mode="reflect"), n_fft)[::hop][: 1 + len(x) // hop]
    for a in range(0, len(frames), FRAMES):
        mel = (np.abs(np.fft.rfft(frames[a : a + FRAMES] * taper, axis=1)) ** 2) @ filters.T + 1e-6
        yield a, np.log(mel) if log else mel


def log_mel_frames(rows: DataFrame, key: str, samples: str, n_mels: int = 40, n_fft: int = 512, window: int = 400, hop: int = 160, rate: int = 16_000, log: bool = True, emphasis: float = 0.0) -> DataFrame:
    """(key, frame, mel): Hamming-windowed power spectra through mel filters, plus 1e-6, optionally in logs. Frames are
    centred and clips mirrored at their ends (short ones as often as it takes), so a clip of n samples has 1 + n // hop
    frames. Null and empty clips have none."""
    filters = mel_filters(n_mels, n_fft, rate)
    kind = rows.schema[key].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.column(1)[row].values
                if x is None or not len(x):
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(float)
                if emphasis:
                    x = x - emphasis * np.append(x[min(1, len(x) - 1)], x[:-1])
                for first, mel in mel_spectra(x, filters, n_fft, window, hop, log):
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(mel) + 1) * n_mels, pa.int32()), pa.array(mel.ravel()))
                    own = batch.column(0).take(pa.array(np.full(len(mel), row)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(first, first + len(mel)), pa.int32()), values], ["key", "frame", "mel"])

    made = rows.select(F.col(key).alias("key"), F.col(samples).alias("samples")).mapInArrow(run, f"key {kind.simpleString()}, frame int, mel array<double>")
    return made.withColumnRenamed("key", key)


def instance_normalized(frames: DataFrame, key: str) -> DataFrame:
    """Each mel band of an utterance to zero mean and unit variance (variance + 1e-5)."""
    long = frames.select(key, "frame", F.posexplode("mel").alias("band", "x"))
    by = Window.partitionBy(key, "band")
    scaled = long.withColumn("x", (F.col("x") - F.avg("x").over(by)) / F.sqrt(F.var_pop("x").over(by) + 1e-5))
    return scaled.groupBy(key, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda s: s["x"]).alias("mel"))


def pooled(rows: DataFrame, key: str, value: str, weight: Column | None = None) -> DataFrame:
    """Mean, maximum, and weighted mean and deviation (variance at least 1e-5) of a value over a key's frames."""
    w = weight if weight is not None else F.lit(1.0)
    v = F.col(value).cast("double")
    sums = rows.groupBy(key).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv"))
    mean = F.try_divide("_wv", "_w")
    return sums.select(key, "mean", "max", mean.alias("weighted_mean"), F.sqrt(F.greatest(F.try_divide("_wvv", "_w") - mean * mean, F.lit(1e-5))).alias("weighted_std"))


def extract_embeddings(rows: DataFrame, model, dim: int | None = None) -> DataFrame:
    """Run a user's function over batches of clips: ``model(list of sample arrays) -> list of vectors``. Keys (utt,
    crop_id) travel in the row, so results cannot land on another clip."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.asarray(v, dtype=np.float32) for v in model([np.asarray(x) for x in batch["samples"]])]
            if dim and any(len(v) != dim for v in made):
                raise ValueError(f"the model's vectors do not have {dim} entries")
            yield pd.DataFrame({"utt": batch["utt"], "crop_id": batch["crop_id"], "embedding": [v.tolist() for v in made]})

    return rows.select("utt", "crop_id", "samples").mapInPandas(run, "utt string, crop_id int, embedding array<float>")


def vector_mean(vector: str | Column) -> Column:
    """Element-wise mean of a group's vectors of one length (an Arrow aggregate); nulls are left out. The group is held
    in one task: for hot groups use ``scoring.prototypes``, which sums by position."""
    return _mean_udf()(vector)


def _mean_udf():
    def mean(vectors: pa.Array) -> list:
        known = vectors.drop_null()
        if not len(known):
            return None
        return known.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(known), -1).mean(axis=0).tolist()

    return F.arrow_udf(mean, "array<double>")


class Crops:
    """As ``evaluation_crops``, a table function for lateral joins: a row for each crop of a clip of n samples."""

    def eval(self, n: int, frames: int, crops: int) -> Iterator[tuple[int, int, int]]:
        size = frames * 160 + 240
        full = size + 1 if n <= size else n
        for k in range(crops):
            yield k, k * (full - size) // max(crops - 1, 1), size


def register_functions(spark: SparkSession) -> None:
    """SQL functions: ``vector_mean(vector)``, an aggregate, and the table function ``crops(n, frames, crops)`` with rows
    (crop_id, start, length)."""
    spark.udf.register("vector_mean", _mean_udf())
    spark.udtf.register("crops", F.udtf(Crops, returnType="crop_id int, start long, length long"))
