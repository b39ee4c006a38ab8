"""Text sources and sinks: manifests, trial lists, speaker lists, checksum lists, media inventories, sidecars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.plans.materialize import materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with line numbers from 0 in each file. A file is read in order inside its splits;
    splits are counted apart and their offsets added, so long files stay parallel."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = materialize(lines)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("id") - F.col("first")).alias("line_no"), "value")


def tokens(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda t: t != "")


def parse_manifest(lines: DataFrame, root: str = "") -> DataFrame:
    """(line_no, speaker, path); lines with fewer than two tokens go; absolute paths win over the root."""
    t = lines.withColumn("t", tokens(F.col("value"))).filter(F.size("t") >= 2)
    path = F.get("t", F.lit(1))
    if root:
        path = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))
    return t.select("line_no", F.get("t", F.lit(0)).alias("speaker"), path.alias("path"))


def parse_trials(lines: DataFrame, random_labels: bool = False, seed: int = 0) -> DataFrame:
    """(line_no, label, ref, com): the files are the last two tokens; two-token lines have a null label, or with
    ``random_labels`` one from the line's hash."""
    from veriframe.functions.scalars import seeded_int

    t = lines.withColumn("t", tokens(F.col("value"))).filter(F.size("t") >= 2)
    label = F.when(F.size("t") >= 3, F.expr("try_cast(get(t, 0) AS int)"))
    if random_labels:
        label = F.when(F.size("t") >= 3, label).otherwise(F.pmod(seeded_int(seed, F.col("line_no")), F.lit(2)).cast("int"))
    return t.select("line_no", label.alias("label"), F.element_at("t", -2).alias("ref"), F.element_at("t", -1).alias("com"))


def parse_checksums(lines: DataFrame) -> DataFrame:
    """(source, out, md5) from two- or three-column lists."""
    t = lines.withColumn("t", tokens(F.col("value"))).filter(F.size("t") >= 2)
    return t.select("line_no", F.get("t", F.lit(0)).alias("source"), F.when(F.size("t") >= 3, F.get("t", F.lit(1))).alias("out"), F.element_at("t", -1).alias("md5"))


def read_manifest(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    return parse_manifest(numbered_lines(spark, path), root)


def read_trials(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_trials(numbered_lines(spark, path), **options)


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("speaker")).filter("speaker <> ''")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return parse_checksums(numbered_lines(spark, path))


def media_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wav", "flac", "m4a", "aac")) -> DataFrame:
    """(path, size, modified) of all files below the root with one of the extensions, in any case; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = rf"(?i)\.({'|'.join(extensions)})$"
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(F.col("path").rlike(pattern))


def speaker_directories(spark: SparkSession, root: str, prefix: str = "id") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/", 1)
    return files.select(below.alias("speaker")).filter(F.col("speaker").startswith(prefix)).distinct().orderBy("speaker")


def noise_pool(spark: SparkSession, root: str) -> DataFrame:
    """(category, path) of ``root/category/any/name.wav``; without the folder, or with none, an empty pool."""
    from veriframe.sources.sinks import Store

    if not root or not Store(spark, root).exists():
        return spark.createDataFrame([], "category string, path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root).select("path")
    depth = F.size(F.split(F.regexp_extract("path", rf"{re.escape(root.strip('/').split(':', 1)[-1].strip('/'))}/(.*)$", 1), "/"))
    return files.filter(depth == 3).select(F.try_element_at(F.split("path", "/"), F.lit(-3)).alias("category"), "path")


def checksum_verdicts(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(name, md5, actual, ok) for every expected file; missing files have a null ``actual`` and are not ok."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    actual = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("actual"))
    wanted = expected.select(F.element_at(F.split("source", "/"), -1).alias("name"), "md5")
    return wanted.join(actual, "name", "left").withColumn("ok", F.coalesce(F.col("md5") == F.col("actual"), F.lit(False)))


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(path, epoch) of model files, latest by epoch number; the largest is the one to resume from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    epoch = F.expr(r"try_cast(regexp_extract(path, 'model0*([0-9]+)[.]model$', 1) AS int)")
    return files.select("path", epoch.alias("epoch")).filter("epoch is not null")


def sidecar_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.expr("try_cast(trim(value) AS double)").alias("value")).filter("value is not null")


def write_lines(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """One text line a row: the columns with single spaces between."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode(mode).text(path)
