"""Experiment log and run-argument sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.sources.lists import numbered_lines

_NUMBER = r"([-+0-9.eE]+|nan|inf|-inf)"
#: Fixed formats of the log's three kinds of record.
TRAIN = rf"^Epoch (\d+), TEER/TAcc {_NUMBER}, TLOSS {_NUMBER}(?:, DistillLoss {_NUMBER})?, LR {_NUMBER}\s*$"
VALIDATION = rf"^Epoch (\d+), VEER {_NUMBER}, MinDCF {_NUMBER}, Threshold {_NUMBER}\s*$"
STOP = r"^Early stopping at epoch (\d+)\."


def _number(value: Column, pattern: str, group: int, kind: str = "double") -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit("")).try_cast(kind)


def parse_log(lines: DataFrame, keep: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """Typed records of a ``value`` column: kind (train, validation, stop), epoch and the kind's numbers."""
    v = F.col("value")
    kind = F.when(v.rlike(TRAIN), "train").when(v.rlike(VALIDATION), "validation").when(v.rlike(STOP), "stop")
    typed = lines.withColumn("kind", kind).filter("kind is not null")
    pattern = lambda name, group, k="double": _number(v, {"train": TRAIN, "validation": VALIDATION, "stop": STOP}[name], group, k)
    return typed.select(
        *keep, "kind", F.coalesce(pattern("train", 1, "int"), pattern("validation", 1, "int"), pattern("stop", 1, "int")).alias("epoch"),
        pattern("train", 2).alias("tacc"), pattern("train", 3).alias("tloss"), pattern("train", 4).alias("distill"), pattern("train", 5).alias("lr"),
        pattern("validation", 2).alias("veer"), pattern("validation", 3).alias("min_dcf"), pattern("validation", 4).alias("threshold"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(numbered_lines(spark, path))


def parse_run_arguments(files: DataFrame) -> DataFrame:
    """(file, run_ts, args) from ``file`` and ``value``, a dump like Namespace(key='text', other=1.5). Of a key that
    occurs several times the last value counts."""
    pair = r"(\w+)=('[^']*'|\"[^\"]*\"|\[[^\]]*\]|[^,)]*)"
    keys = F.regexp_extract_all("value", F.lit(pair), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(pair), F.lit(2)), lambda x: F.regexp_replace(x, r"^['\"]|['\"]$", ""))
    stamp = F.nullif(F.regexp_extract("file", r"run(\d{14})\.cmd", 1), F.lit(""))
    named = files.select("file", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).alias("run_ts"), keys.alias("_k"), values.alias("_v"))
    later = lambda i: F.slice("_k", i + 2, F.size("_k"))
    pairs = F.filter(F.arrays_zip(F.col("_k").alias("k"), F.col("_v").alias("v")), lambda p, i: ~F.array_contains(later(i), p["k"]))
    return named.select("file", "run_ts", F.map_from_entries(pairs).alias("args"))


def read_run_arguments(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_arguments(spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value"))
