"""A corpus pipeline of five stages. Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read back as the next stage's documents. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import language, mixing, near_duplicates, packing, repeats
from veriframe.llm.common import shared_dir, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letters at all) go; ``lang`` becomes the predicted language."""
    small_batches(spark)
    found = language.identify(docs, language.train(docs), keep=tuple(docs.columns))
    found = found.filter("lang_pred <> 'und'")
    return found.select(*[F.col("lang_pred" if c == "lang" else f"_keep_{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id, of equal ids the first text."""
    small_batches(spark)
    return near_duplicates.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that occur elsewhere are cut out of the texts; no document goes."""
    small_batches(spark)
    return repeats.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    small_batches(spark)
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The stages learn models and compare texts by shingle; SQL does not express them. Tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
