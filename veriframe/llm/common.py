"""Shared helpers of the text operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
HELD_OUT_REMAINDER = 2
#: Rows of a list table, and entries in all (some 40 bytes each), that are broadcast at most; more are joined by exchange.
BROADCAST_LISTS, BROADCAST_ENTRIES = 400_000, 1_000_000


#: Rows and bytes of a batch that goes to a Python worker, and bytes of text that are worked on at once: texts may be
#: long. A batch lies in an executor's memory outside its heap twice over, as vectors and as the bytes that are sent.
BATCH_ROWS, BATCH_BYTES, PART_BYTES = 2_000, 2 << 20, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers get and give small; a session that asks for smaller ones is left alone."""
    most = {"maxRecordsPerBatch": BATCH_ROWS, "maxBytesPerBatch": BATCH_BYTES, "maxBytesPerOutputBatch": BATCH_BYTES}
    for name, value in most.items():
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= value):
            spark.conf.set(name, str(value))


def parts_of(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts (in that column) have about PART_BYTES bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // PART_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()


def tidy(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a partition's batches, after which the worker gives the memory that it has freed back to the system:
    Spark uses workers again, so what one step leaves in them would count beside the next step's needs."""

    @functools.wraps(work)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is configured, a local master (tests) gets a temporary one; a
    cluster must name a folder that its executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not where and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="veriframe-checkpoint-"))
    return where or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later reads neither recompute it nor
    depend on any executor's local disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model may learn labels from (null ids count as the text '')."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == HELD_OUT_REMAINDER


def hash_below(doc_id: Column, share: float) -> Column:
    """Deterministic sampling predicate that keeps about ``share`` of the ids."""
    steps = 1 << 20
    return F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(steps)) < int(min(1.0, share) * steps)


def cut_table(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed columnar table in the shared folder: for larger intermediate results."""
    where = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def few_entries(lists: DataFrame, column: str | None = None) -> bool:
    """True where a table (and the arrays in ``column``) is small enough to be broadcast."""
    size = F.sum(F.size(column)) if column else F.count("*")
    got = lists.agg(F.count("*").alias("rows"), F.coalesce(size, F.lit(0)).alias("entries")).first()
    return got.rows <= BROADCAST_LISTS and got.entries <= BROADCAST_ENTRIES


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[Column]:
    """All columns by their whole names, dots and backticks included."""
    return [F.col(quote(c)) for c in df.columns]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
