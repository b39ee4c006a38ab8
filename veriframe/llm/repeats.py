"""Removal of long strings that repeat anywhere in the corpus, byte for byte.

Repeated strings are found in Burrows-Wheeler transforms of shards, merged by interleave refinement (``bwt``): places
of the merged order whose common prefix is LENGTH bytes are repeated intervals. Refinement reads every place once
a round, so the transforms are not built over the whole corpus but over the parts that can repeat:

Every LENGTH-byte string has one anchor, its leftmost smallest hash of a GRAM-byte piece. Equal strings have equal
anchors at the same place, so only strings that share an anchor can be equal. Neighbouring strings with one anchor
form a run; equal runs (by anchor and hash, 128 bits in all) that are read together are one small row with their
places. Rows are exchanged by anchor once. A run with an anchor of its own cannot repeat. Runs of the same bytes are
one string of the collection, repeated as a whole. Where runs of one anchor differ, one copy of each distinct run's bytes is fetched and the runs of a task are
indexed as shards and merged. Runs of an anchor that has very many distinct ones are dealt out by string hash
instead. Equal runs are never compared pairwise, so nothing depends on how often a passage occurs.

Defined cases: null texts are empty; texts shorter than LENGTH bytes have no such string and stay whole; repeated
rows are different places, so a text of LENGTH bytes or more that occurs twice is removed from both; an empty table
gives an empty table; other columns are ignored. The input must read the same rows in the same order each time
(a table or a written intermediate result), as rows are told apart by their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriframe.llm import bwt
from veriframe.llm.common import cut, cut_table, few_entries, parts_of, quote, tidy
from veriframe.llm.rolling import Hashes, mixed, text_bytes

LENGTH = 200
GRAM = 80
#: String starts that are hashed at a time.
CHUNK = 1 << 18
#: Distinct runs of one anchor that a task counts by itself.
IN_TASK = 4_000
#: Runs that a task holds before it gives them.
FLUSH = 500

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts that lie side by side in ``data`` (text k is bounds[k]:bounds[k + 1]): text number, first
    string start (from the text's start), number of starts, anchor hash, hash of the run's bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for low in range(0, len(data) - length + 1, CHUNK):
        part = data[low : min(len(data), low + CHUNK + length - 1)]
        hashes = Hashes(part)
        grams = hashes.all(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        best = sliding_min((grams & ~np.uint64((1 << 24) - 1)) | place, width) & np.uint64((1 << 24) - 1)
        starts = np.arange(len(best)) + low
        text = np.searchsorted(bounds, starts, side="right") - 1
        valid = starts + length <= bounds[text + 1]
        starts, text, best = starts[valid], text[valid], best[valid].astype(np.int64)
        if not len(starts):
            continue
        new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)))
        ends = np.append(new[1:], len(starts))
        first, n = starts[new], ends - new
        whole = hashes.of(first - low, first - low + n - 1 + length)
        out.append((text[new], first - bounds[text[new]], n, grams[best[new]], whole))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), "text")


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Rows of the documents with their lists (uid, array); the lists are broadcast while they are few and short."""
    return docs.join(F.broadcast(lists) if few_entries(lists, lists.columns[1]) else lists, "uid", how)


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, first, n): stretches of string starts whose string occurs elsewhere too. Stretches of one document do
    not overlap but may touch."""
    placed = _placed(docs)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("uid", pa.int64()), ("first", pa.int32())])
        for batch in parts_of(batches, 1):
            uid = batch.column(0).to_numpy()
            text, first, n, anchor, whole = runs(*text_bytes(batch.column(1)), length, gram)
            # equal runs are one row: one place, and the further ones as a list
            order = np.lexsort((whole, anchor))
            text, first, n, anchor, whole = (x[order] for x in (text, first, n, anchor, whole))
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))) if len(anchor) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(new, len(anchor)))
            further = np.ones(len(anchor), dtype=bool)
            further[new] = False
            places = pa.StructArray.from_arrays([pa.array(uid[text[further]]), pa.array(first[further].astype(np.int32))], fields=list(place))
            offsets = np.append(0, np.cumsum(times - 1)).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(times == 1, False)), places)
            columns = [uid[text[new]], first[new].astype(np.int32), n[new].astype(np.int32), anchor[new].view(np.int64), whole[new].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), more], names=["uid", "first", "n", "anchor", "whole", "more"])

    found = placed.mapInArrow(tidy(find), "uid long, first int, n int, anchor long, whole long, more array<struct<uid: long, first: int>>")
    by_anchor, by_run = Window.partitionBy("anchor"), Window.partitionBy("anchor", "whole")
    times = 1 + F.coalesce(F.size("more"), F.lit(0))
    # one exchange: equal runs have equal anchors
    found = found.repartition("anchor").withColumns({"same": F.sum(times).over(by_run), "leads": (F.row_number().over(by_run.orderBy("uid", "first")) == 1).cast("int")})
    found = found.withColumn("kinds", F.sum("leads").over(by_anchor))
    differ = (F.col("kinds") > 1) & (F.col("leads") == 1)
    found = found.filter((F.col("same") > 1) | differ)
    kept = cut_table(found.select("uid", "first", "n", F.when(differ, F.col("anchor")).alias("anchor"), (F.col("same") > 1).alias("repeats"), (F.col("kinds") > IN_TASK).alias("huge"), "more"))
    whole = kept.filter("repeats").select("uid", "first", "n")
    further = kept.filter("more is not null").select(F.explode("more").alias("p"), "n").select("p.uid", "p.first", "n")
    whole = whole.unionByName(further)

    fetch = kept.filter("anchor is not null").groupBy("uid").agg(F.collect_list(F.struct("first", "n", "anchor", "repeats", "huge")).alias("runs"))

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                uid, text, rows = (batch.column(k)[at].as_py() for k in range(3))
                raw = text.encode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(rows), pa.int64()), pa.array([r["first"] for r in rows], pa.int32()), pa.array([r["anchor"] for r in rows], pa.int64()), pa.array([r["repeats"] for r in rows], pa.bool_()), pa.array([r["huge"] for r in rows], pa.bool_()), pa.array([raw[r["first"] : r["first"] + r["n"] - 1 + length] for r in rows], pa.binary())],
                    names=["uid", "first", "anchor", "repeats", "huge", "bytes"],
                )

    pieces = _with_lists(placed, cut_table(fetch), "inner").select("uid", "text", "runs").mapInArrow(tidy(cut_out), "uid long, first int, anchor long, repeats boolean, huge boolean, bytes binary")
    # the runs of an anchor with very many kinds are not compared in one place, so they may lie anywhere
    salt = F.when(F.col("huge"), F.pmod(F.xxhash64("uid", "first"), F.lit(1 << 16))).otherwise(0)
    pieces = pieces.withColumn("salt", salt).repartition("anchor", "salt").sortWithinPartitions("huge", "anchor").drop("salt")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of the distinct runs of each anchor that occur in two of them; runs of an anchor that has very
        many are passed on as (string hash, place)."""

        def batch_of(columns: tuple, is_open: bool) -> pa.RecordBatch:
            uid, first, n, key, single = columns
            return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(single), pa.array(np.full(len(uid), is_open))], names=["uid", "first", "n", "key", "single", "open"])

        def columns_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            uid, first = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
            return uid, first, ~np.array([r[3] for r in rows], dtype=bool)

        def indexed(rows: list[tuple]) -> pa.RecordBatch:
            uid, first, single = columns_of(rows)
            owner, offset = bwt.repeated([r[5] for r in rows], length)
            keep = single[owner]
            order = np.lexsort((offset[keep], owner[keep]))
            own, place = owner[keep][order], offset[keep][order]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))) if len(own) else own
            n = np.diff(np.append(new, len(own)))
            return batch_of((uid[own[new]], first[own[new]] + place[new], n, np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=bool)), False)

        def passed_on(rows: list[tuple]) -> pa.RecordBatch:
            uid, first, single = columns_of(rows)
            data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
            bounds = np.cumsum([0] + [len(r[5]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), np.diff(bounds) - length + 1)
            starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            key = Hashes(data).of(starts, starts + length) ^ mixed(np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64))[owner]
            return batch_of((uid[owner], first[owner] + starts - bounds[owner], np.ones(len(owner), dtype=np.int64), key.view(np.int64), single[owner]), True)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # the huge ones come last
                if len(held) > FLUSH and (row[4] or row[2] != held[-1][2]) or held and row[4] != held[-1][4]:
                    yield (passed_on if held[-1][4] else indexed)(held)
                    held = []
                held.append(row)
        if held:
            yield (passed_on if held[-1][4] else indexed)(held)

    counted = cut_table(pieces.mapInArrow(tidy(count), "uid long, first int, n int, key long, single boolean, open boolean"))
    closed = counted.filter("not open").select("uid", "first", "n")
    opened = counted.filter("open")
    twice = cut(opened.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key"))
    opened = opened.filter("single").join(F.broadcast(twice) if few_entries(twice) else twice, "key", "left_semi").select("uid", "first", "n")
    return whole.unionByName(closed).unionByName(opened)


def covered(stretches: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges that the strings starting in the stretches (first, n) cover, as maximal runs."""
    out: list[list[int]] = []
    for first, n in sorted(stretches):
        end = first + n - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold only in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; columns in ``keep`` come along as
    ``_keep_0``, ``_keep_1``, ..., and ``kept_text`` (cut at whole characters) if asked for."""
    stretches = repeated_starts(docs, length, gram)
    lists = stretches.groupBy("uid").agg(F.collect_list(F.struct("first", "n")).alias("stretches"))

    def join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in covered([(s["first"], s["n"]) for s in found], length)] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["uid", "spans"])

    # neighbouring stretches become one span before anything is sent on: a whole copy is a single entry
    lists = cut_table(lists.mapInArrow(tidy(join_up), "uid long, spans array<struct<start: long, end: long>>"))
    kept = [F.col(quote(c)).alias(f"_keep_{k}") for k, c in enumerate(keep)]
    names = [f"_keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", *kept)
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
    for name in names:
        schema.add(name, rows.schema[name].dataType)
    rows = _with_lists(rows, lists, "left").select("doc_id", "text", "spans", *names)
    given = schema.names

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_text)]
            for at in range(batch.num_rows):
                text, found = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                raw = (text or "").encode()
                spans = [(s["start"], s["end"]) for s in found or []]
                left, end = [], 0
                for a, b in spans:
                    left.append(raw[end:a])
                    end = b
                left.append(raw[end:])
                row = [batch.column(0)[at].as_py(), len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest()]
                if with_text:
                    left, end = [], 0
                    for a, b in whole_characters(raw, spans):
                        left.append(raw[end:a])
                        end = b
                    row.append(b"".join([*left, raw[end:]]).decode() if text is not None else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(out, kinds, strict=True)], *[batch.column(3 + k) for k in range(len(keep))]], names=given)

    return rows.mapInArrow(tidy(apply), schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated strings: texts are cut at whole characters, ``n_chars`` (if there is
    such a column) is the new length, everything else stays."""
    names = docs.columns
    others = tuple(c for c in names if c != "text")
    made = remove_repeats(docs, length, gram, keep=others, with_text=True)
    text = F.col("kept_text")
    columns = []
    for c in names:
        own = text if c == "text" else F.col(f"_keep_{others.index(c)}")
        if c == "n_chars":
            own = F.length(F.coalesce(text, F.lit(""))).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return made.select(*columns)
