"""Streams: live log ingest, the best/patience monitor, progress rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriframe.sources.line_files import tail
from veriframe.sources.logs import parse_log


def live_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed records (file, offset, kind, ...) of the log files below a folder, as lines are appended to them."""
    return parse_log(tail(spark, path), keep=("file", "offset"))


#: The state store that arbitrary state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession, few_keys: bool = False) -> SparkSession:
    """A session of its own whose streams keep their state in STATE_STORE; the caller's session stays as it is. Streams
    read the setting some time after they are started, so it cannot be lent for a moment. A partition of the state costs a
    store and a Python worker in every micro-batch, with or without rows: with ``few_keys`` there is at most one a core,
    however many partitions the caller's shuffles have."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    if few_keys:
        own.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return own


class BestMonitor(StatefulProcessor):
    """Keeps best, records since the last improvement, and whether a run has stopped; emits improvements and the
    stop. Records of a micro-batch come as ``packed`` rows and are taken in ``seq`` order."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "best double, since long, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, since, stopped = self.state.get() if self.state.exists() else (float("inf"), 0, False)
        out = []
        for seq, value in self._in_order(rows, stopped):
            if value < best:
                best, since = value, 0
                out.append((key[0], seq, "improved", best))
            else:
                since += 1
                if self.patience and since >= self.patience:
                    stopped = True
                    out.append((key[0], seq, "stopped", best))
                    break
        self.state.update((best, since, stopped))
        yield pd.DataFrame(out, columns=["run", "seq", "event", "best"])

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame], stopped: bool) -> Iterator[tuple[int, float]]:
        held = [(s, v) for some in rows if not stopped for s, v in zip(some["seqs"], some["values"], strict=True)]
        if held:
            seqs, values = (np.concatenate([np.asarray(x) for x in c]) for c in zip(*held, strict=True))
            order = np.argsort(seqs, kind="stable")
            for k in range(0, len(order), STRETCH):
                some = order[k : k + STRETCH]
                yield from zip(seqs[some].tolist(), values[some].tolist(), strict=True)

    def close(self) -> None:
        pass


#: Records that become Python numbers at once.
STRETCH = 10_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = b.take(pc.sort_indices(b, sort_keys=[("run", "ascending")]))
        runs = pc.run_end_encode(own.column("run"))
        starts = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends])
        lists = [pa.ListArray.from_arrays(starts, c) for c in (own.column("seq"), pc.fill_null(own.column("value"), float("nan")))]
        yield pa.RecordBatch.from_arrays([runs.values, *lists], ["run", "seqs", "values"])


def packed(stream: DataFrame) -> DataFrame:
    """(run, seqs, values) of a stream (run, seq, value): a row for each run of an Arrow batch. The stateful step takes its
    rows one by one in Python and all rows of a run in one task, so it gets many records a row; the packing is spread
    over the tasks that read. A missing value becomes NaN, which never improves."""
    typed = stream.select(F.col("run").cast("long"), F.col("seq").cast("long"), F.col("value").cast("double"))
    return typed.mapInArrow(_pack, "run long, seqs array<long>, values array<double>")


def monitored(stream: DataFrame, patience: int) -> DataFrame:
    """Events (run, seq, event, best) of a stream (run, seq, value) that was made in a ``state_session``."""
    return packed(stream).groupBy("run").transformWithStateInPandas(statefulProcessor=BestMonitor(patience), outputStructType="run long, seq long, event string, best double", outputMode="Append", timeMode="None")


def progress_rate(stream: DataFrame, ts: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Items a second in tumbling windows; items later than the delay are not counted."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counted.select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("items_per_s"))
