"""Text files by byte range, as Python data sources.

``list_file`` reads manifests, trial lists, checksum lists and speaker lists. Files are planned as ranges of
``split_bytes``; a range gives the lines that begin in it, so no line is read twice or lost and long files stay parallel.
Comparisons of a field with a constant are pushed into the ranges (where ``spark.sql.python.filterPushdown.enabled`` is
on; Spark filters otherwise). Lines are numbered from 0 in their file by the line counts of the ranges before.

``log_tail`` is a stream over growing files: its offset is the end of the last whole line of every file, so lines that
are appended to a file that was read before are found, half-written lines wait, and a restart goes on at the offset of
its checkpoint. A file that is shorter than its offset was begun anew and is read from its start.

Paths are local or URIs of file systems that Arrow knows. Empty files have no lines; bytes that are not UTF-8 are
replaced; lines with too few fields are left out, but counted in the line numbers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SPLIT_BYTES, CHUNK, LINE, BATCH_LINES = 16 << 20, 1 << 20, 4 << 10, 10_000
#: Tasks that short ranges are shared out to at most, where a task would not have SPLIT_BYTES to read.
TASKS = 64
#: Fields of each kind of list, as the batch source gives them after file, split and line_in_split.
KINDS = {
    "manifest": (("speaker", pa.string()), ("path", pa.string())),
    "trials": (("label", pa.int32()), ("ref", pa.string()), ("com", pa.string())),
    "checksums": (("source", pa.string()), ("out", pa.string()), ("md5", pa.string())),
    "speakers": (("speaker", pa.string()),),
}
_SQL = {pa.string(): "string", pa.int32(): "int"}


def file_system(path: str):
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder that are not hidden, in order; none where nothing is."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return []
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
    hidden = lambda p: any(s[:1] in "._" and "=" not in s for s in p.removeprefix(root).strip("/").split("/"))
    return sorted((path.rstrip("/") + i.path.removeprefix(root), i.size) for i in found if not hidden(i.path))


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of all lines whose first byte lies in [start, end)."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        at = max(0, start - 1)
        f.seek(at)
        rest, skip = b"", start > 0
        while at < end:
            chunk = f.read(min(CHUNK, max(end - f.tell(), LINE)))  # not far beyond a short range
            pieces = (rest + chunk).split(b"\n")
            rest = pieces.pop()
            if not chunk and rest:
                pieces, rest = [rest], b""
            for piece in pieces:
                if at >= end:
                    return
                if not skip:
                    yield at, piece.removesuffix(b"\r")
                skip = False
                at += len(piece) + 1
            if not chunk:
                return


@dataclass
class Range(InputPartition):
    file: str
    split: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, each with its own number in its file."""

    own: list[Range]


def shared_out(own: list[Range]) -> list[Ranges]:
    """The ranges in their order, in parts of about equal bytes: the tasks do not grow with the number of ranges."""
    share = max(1, min(SPLIT_BYTES, -(-sum(r.end - r.start for r in own) // TASKS)))
    out: list[Ranges] = []
    held = share
    for r in own:
        if held >= share:
            out.append(Ranges([]))
            held = 0
        out[-1].own.append(r)
        held += r.end - r.start
    return out


def ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, k, a, min(a + size, end)) for k, a in enumerate(range(start, end, size))]


def fields_of(kind: str, line: str) -> tuple | None:
    """The line's fields, or None where it has too few."""
    t = line.split()
    if kind == "speakers":
        return (line.strip(),) if t else None
    if len(t) < 2:
        return None
    if kind == "manifest":
        return t[0], t[1]
    if kind == "trials":
        label = t[0] if len(t) >= 3 else ""
        return int(label) if re.fullmatch(r"[+-]?\d{1,9}", label) else None, t[-2], t[-1]
    return t[0], t[1] if len(t) >= 3 else None, t[-1]


_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x, IsNotNull: lambda v, x: True,
}


class ListFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.size = options["path"], options.get("kind", "trials"), int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[int, type, object]] = []

    def partitions(self) -> Sequence[InputPartition]:
        return shared_out([r for file, size in files_below(self.path) for r in ranges(file, 0, size, self.size)]) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.own:
            yield from self._read(r)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.kind == "counts":
            n = sum(1 for _ in lines_between(partition.file, partition.start, partition.end))
            yield pa.RecordBatch.from_pydict({"file": [partition.file], "split": pa.array([partition.split], pa.int32()), "n_lines": [n]})
            return
        held: list[tuple] = []
        for k, (_, line) in enumerate(lines_between(partition.file, partition.start, partition.end)):
            got = fields_of(self.kind, line.decode("utf-8", "replace"))
            if got is not None and all(got[i] is not None and _TESTS[t](got[i], x) for i, t, x in self.tests):
                held.append((k, *got))
                if len(held) >= BATCH_LINES:
                    yield self._batch(partition, held)
                    held = []
        if held:
            yield self._batch(partition, held)

    def _batch(self, partition: Range, held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        own = [pa.array([partition.file] * len(held)), pa.array([partition.split] * len(held), pa.int32()), pa.array(columns[0], pa.int64())]
        own += [pa.array(c, t) for c, (_, t) in zip(columns[1:], KINDS[self.kind], strict=True)]
        return pa.RecordBatch.from_arrays(own, ["file", "split", "line_in_split", *[n for n, _ in KINDS[self.kind]]])


class PushingReader(ListFileReader):
    """Spark refuses readers that take filters while its setting for that is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        names = [n for n, _ in KINDS.get(self.kind, ())]
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in names:
                self.tests.append((names.index(f.attribute[0]), type(f), getattr(f, "value", None)))
            else:
                yield f


class ListFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "list_file"

    def schema(self) -> str:
        kind = self.options.get("kind", "trials")
        if kind == "counts":
            return "file string, split int, n_lines long"
        return ", ".join(["file string", "split int", "line_in_split long", *[f"{n} {_SQL[t]}" for n, t in KINDS[kind]]])

    def reader(self, schema) -> ListFileReader:
        return (PushingReader if self.options.get("push") == "true" else ListFileReader)(dict(self.options))


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {file: self._whole_lines(file, size) for file, size in files_below(self.path)}

    @staticmethod
    def _whole_lines(file: str, size: int) -> int:
        """The end of the file's last whole line, read backwards by chunks."""
        system, name = file_system(file)
        with system.open_input_file(name) as f:
            end = size
            while end > 0:
                start = max(0, end - CHUNK)
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, upto in end.items():
            done = start.get(file, 0)
            out += ranges(file, done if done <= upto else 0, upto, self.size)
        return shared_out(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.own:
            yield from self._read(r)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        for at, line in lines_between(partition.file, partition.start, partition.end):
            held.append((at, line.decode("utf-8", "replace")))
            if len(held) >= BATCH_LINES:
                yield self._batch(partition.file, held)
                held = []
        if held:
            yield self._batch(partition.file, held)

    @staticmethod
    def _batch(file: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], ["file", "offset", "value"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(dict(self.options))


def read_list(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a list as ``list_file`` gives them (file, split, line_in_split and the kind's fields)."""
    spark.dataSource.register(ListFile)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("list_file").option("kind", kind).option("split_bytes", str(split_bytes)).option("push", push).load(path)


def line_numbers(rows: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Adds ``line_no`` to rows of ``read_list`` over the same path and split size: the lines of a file's ranges are
    counted, and each range's offset is joined to its rows."""
    counts = read_list(rows.sparkSession, path, "counts", split_bytes)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("file", "split", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, ["file", "split"]).withColumn("line_no", F.col("_before") + F.col("line_in_split")).drop("_before")


def tail(spark: SparkSession, path: str) -> DataFrame:
    """A stream (file, offset, value) of the lines of all files below a folder, those that are appended later too."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").load(path)
