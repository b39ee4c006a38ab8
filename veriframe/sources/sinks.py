"""Sinks: append-only logs that take a batch once, segment tables, best-so-far sidecars.

A log is a folder with one folder of text files a batch. A ledger beside it has an empty file for each batch that is
whole. A batch that comes again, as after a restart, is found there and appends nothing; one that was cut off while
writing is not there, and its folder is replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriframe.operators.audio import sliding_segments


def train_line() -> Column:
    return F.format_string("Epoch %d, TEER/TAcc %2.2f, TLOSS %f, LR %f", "epoch", "tacc", "tloss", "lr")


def validation_line() -> Column:
    return F.format_string("Epoch %d, VEER %2.4f, MinDCF %2.5f, Threshold %f", "epoch", "veer", "min_dcf", "threshold")


class Store:
    """The few file operations that sinks need, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.files = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self._of(self.path + name))

    def touch(self, name: str) -> None:
        self.files.create(self._of(self.path + name), True).close()

    def move(self, source: str, target: str) -> None:
        if not self.files.rename(self._of(self.path + source), self._of(self.path + target)):
            raise OSError(f"{self.path}{source} could not be renamed to {self.path}{target}")

    def delete(self, name: str) -> None:
        self.files.delete(self._of(self.path + name), True)


def append_once(records: DataFrame, batch_id: int | str, path: str, line: Column) -> bool:
    """Add one text line a record to a log, unless the log has this batch; what is there stays. True if it was added.
    Order a batch's lines by sorting ``records``."""
    ledger = Store(records.sparkSession, f"{path.rstrip('/')}.batches")
    if ledger.exists(f"/{batch_id}"):
        return False
    records.select(line.alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch_id}")
    ledger.touch(f"/{batch_id}")
    return True


def append_log(records: DataFrame, path: str, line: Column) -> None:
    """Add one text line a record to a log, as a batch of its own."""
    append_once(records, uuid.uuid4().hex, path, line)


def stream_log(records: DataFrame, path: str, checkpoint: str, line: Column, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Append a stream of records to a log, each batch once, and end when all that is there has been taken."""

    def take(batch: DataFrame, batch_id: int) -> None:
        append_once(batch.sortWithinPartitions(*order) if order else batch, batch_id, path, line)

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_segments(clips: DataFrame, samples: str, path: str, size: int = 80_000, hop: int = 48_000) -> None:
    """Windows of every clip with their samples, named by start second."""
    cut = sliding_segments(clips.withColumn("_n", F.size(samples)), "_n", size, hop)
    cut.withColumn("samples", F.slice(samples, F.col("start").cast("int") + 1, size)).drop("_n").write.mode("overwrite").parquet(path)


def swap_in(rows: DataFrame, path: str, *by: str) -> None:
    """Replace a folder of text files (``value``, in folders by the columns ``by``) by a whole new one: it is written
    beside and renamed, so readers find the old or the new content, never a part."""
    store, mark = Store(rows.sparkSession, path), uuid.uuid4().hex
    rows.write.partitionBy(*by).text(f"{store.path}.new-{mark}")
    if store.exists():
        store.move("", f".old-{mark}")
    store.move(f".new-{mark}", "")
    store.delete(f".old-{mark}")


def write_best(records: DataFrame, run: str, value: str, threshold: str, path: str, order: str = "epoch") -> None:
    """Two sidecars a run with the value and the threshold of its first best record, formatted as in the originals; all
    are replaced at once."""
    first = F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("o"), F.col(threshold).alias("t"))).alias("b")
    best = records.filter(F.col(value).isNotNull()).groupBy(run).agg(first)
    both = F.array(F.struct(F.lit("eer").alias("kind"), F.format_string("%2.4f", "b.v").alias("value")), F.struct(F.lit("threshold").alias("kind"), F.format_string("%f", "b.t").alias("value")))
    swap_in(best.select(run, F.explode(both).alias("s")).select(run, "s.kind", "s.value"), path, run, "kind")
