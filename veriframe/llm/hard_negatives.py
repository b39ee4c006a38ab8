"""Hard negatives of anchor vectors, from exact integer scores.

Rows are dealt into blocks: candidates where they are read, anchors by a hash of their id. Every anchor block meets
every candidate block in one tile, whose int64 scores come from Strassen's recursive multiplication (zero padding to
even sides, integer additions only). A tile feeds mergeable heaps: a first pass keeps each anchor's best rows of its own
label, a second one, which knows those positives' scores, keeps for each positive the best rows of other labels inside
its window. Heaps of several tiles merge in the task, and those of several tasks in Spark.

Defined cases. Rows with a null id, label or vector or with a null or non-finite component take no part. Of the others
every row counts, repeated rows and rows of equal id too, but an id that occurs several times among the anchors is one
anchor (the least row), and a row of the anchor's own id is never its positive. Ties go to the smaller id. Vectors of different
lengths are padded with zeros. Components beyond the range of 64 bits saturate, and products are taken modulo 2**64. An
empty table gives an empty result; further columns are not read."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, cut_table, tidy

#: Rows of a candidate block and of an anchor block; side at which the recursion stops; anchor blocks whose heaps a task
#: keeps at most; bytes of anchor blocks that are broadcast at most.
ROWS, ANCHORS, LEAF, OPEN, BROADCAST_BYTES = 2_048, 4_096, 16, 64, 64 << 20
STRIP = 512
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-size products a level; odd sides get a row or column of zeros."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), dtype=np.int64)
    out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``k`` (score, id) of each of ``n`` owners; falling scores, equal ones by rising id."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.used = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        self.k = k

    def push(self, first: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile of scores (owners from ``first`` on, one column an id) where ``allowed``."""
        n, k = scores.shape[0], self.k
        own = slice(first, first + n)
        offered = np.where(allowed, scores, LEAST)
        floor = np.where(self.used[own] >= k, self.score[own, -1], LEAST)
        if offered.shape[1] > k:  # the tile's own k-th best is a floor, too
            floor = np.maximum(floor, np.partition(offered, offered.shape[1] - k, axis=1)[:, -k])
        row, column = np.nonzero(allowed & (offered >= floor[:, None]))
        if not len(row):
            return
        kept_row, kept = np.nonzero(np.arange(k) < self.used[own][:, None])
        rows = np.concatenate([kept_row, row])
        score = np.concatenate([self.score[own][kept_row, kept], scores[row, column]])
        named = np.concatenate([self.id[own][kept_row, kept], ids[column]])
        order = np.lexsort((named, ~score, rows))  # ~score falls where score rises, without overflow
        rows, score, named = rows[order], score[order], named[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        rows, place = rows[best], place[best]
        self.score[first + rows, place], self.id[first + rows, place] = score[best], named[best]
        self.used[own] = np.maximum(self.used[own], np.bincount(rows, minlength=n))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, score, id) of all that is kept."""
        owner, place = np.nonzero(np.arange(self.k) < self.used[:, None])
        return owner, self.score[owner, place], self.id[owner, place]


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _packed(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
    return {"ids": [ids.tobytes()], "labels": [labels.tobytes()], "matrix": [np.ascontiguousarray(matrix).tobytes()], "width": [matrix.shape[1]]}


@tidy
def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate blocks of at most ROWS rows, made where the rows are read: no exchange, so no key can be hot."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block() -> pa.RecordBatch:
        width = max(m.shape[1] for _, _, m in held)
        matrix = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in held])
        ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held.clear()
        return pa.RecordBatch.from_pydict(_packed(ids, labels, matrix), schema=_BLOCK)

    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            if held and sum(len(h[0]) for h in held) + part.num_rows > ROWS:
                yield block()
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))))
    if held:
        yield block()


_BLOCK = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary()), ("width", pa.int32())])
_BLOCK_SQL = "ids binary, labels binary, matrix binary, width int"


def _anchor_block(rows: pa.Table) -> pa.Table:
    """One anchor block: ids in order, with the windows (positives' ids and scores) where they are known."""
    rows = rows.combine_chunks().sort_by("vec_id")
    one = _packed(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"].combine_chunks()))
    known = rows["positives"].combine_chunks()
    sizes = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = known.flatten()
    one |= {"a_block": [rows["a_block"][0].as_py()], "sizes": [sizes.astype(np.int64).tobytes()], "positive_ids": [flat.field(1).to_numpy(zero_copy_only=False).tobytes()], "positive_scores": [flat.field(0).to_numpy(zero_copy_only=False).tobytes()]}
    return pa.table(one, schema=pa.schema([("a_block", pa.int64()), *_BLOCK, ("sizes", pa.binary()), ("positive_ids", pa.binary()), ("positive_scores", pa.binary())]))


def _anchor_blocks(anchors: DataFrame, n_blocks: int) -> DataFrame:
    dealt = anchors.withColumn("a_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    made = dealt.groupBy("a_block").applyInArrow(_anchor_block, f"a_block long, {_BLOCK_SQL}, sizes binary, positive_ids binary, positive_scores binary")
    return made.select("a_block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "matrix", "width", "sizes", "positive_ids", "positive_scores")])


def _tiles(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_bytes: int) -> DataFrame:
    """A row for every pair of an anchor block and a candidate block: an equi-join on the anchor block's number, whose
    side is broadcast while it is small."""
    wanted = blocks.withColumn("a_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    return wanted.join(F.broadcast(anchors) if n_bytes <= BROADCAST_BYTES else anchors, "a_block")


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    return strassen(np.pad(a, ((0, 0), (0, width - a.shape[1]))), np.pad(b, ((0, 0), (0, width - b.shape[1]))).T)


def _ints(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], dtype=np.int64)


def _swept(batches: Iterable[pa.RecordBatch], start, offer, out) -> Iterator[pa.RecordBatch]:
    """Feed every tile to its anchor block's heaps; the heaps of at most OPEN anchor blocks are open at once, and those
    that are closed early come out in several parts."""
    opened: OrderedDict = OrderedDict()
    for batch in batches:
        for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            key = row["a_block"]
            if key not in opened:
                if len(opened) >= OPEN:
                    yield from out(*opened.popitem(last=False)[1])
                opened[key] = start(row)
            opened.move_to_end(key)
            ids, labels = _ints(row, "ids"), _ints(row, "labels")
            matrix = _ints(row, "matrix").reshape(len(ids), row["width"])
            own, heaps = opened[key]
            for first in range(0, len(own["ids"]), STRIP):
                part = slice(first, first + STRIP)
                offer(own, heaps, first, part, _scores(own["matrix"][part], matrix), ids, labels)
    while opened:
        yield from out(*opened.popitem(last=False)[1])


def _own(row: dict) -> dict:
    ids = _ints(row, "a_ids")
    return {"ids": ids, "labels": _ints(row, "a_labels"), "matrix": _ints(row, "a_matrix").reshape(len(ids), row["a_width"])}


def _positive_pass(n_positive: int):
    def start(row):
        return _own(row), Heaps(len(row["a_ids"]) // 8, n_positive)

    def offer(own, heaps, first, part, scores, ids, labels):
        heaps.push(first, scores, (own["labels"][part, None] == labels) & (own["ids"][part, None] != ids), ids)

    def out(own, heaps):
        owner, score, named = heaps.entries()
        if len(owner):
            yield pa.RecordBatch.from_pydict({"anchor_id": own["ids"][owner], "score": score, "id": named})

    return tidy(lambda batches: _swept(batches, start, offer, out))


def window_of(positive: np.ndarray, least_pct: int, most_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest integer s with ``least_pct * p <= 100 * s <= most_pct * p``, without overflow."""
    whole, rest = positive // 100, positive % 100
    return whole * least_pct - (-(rest * least_pct) // 100), whole * most_pct + rest * most_pct // 100


def _negative_pass(n_negative: int, least_pct: int, most_pct: int):
    def start(row):
        own, sizes = _own(row), _ints(row, "a_sizes")
        place = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else sizes
        most = int(sizes.max(initial=0))
        own |= {"owner": np.repeat(np.arange(len(sizes)), sizes), "place": place.astype(np.int64), "p_ids": _ints(row, "a_positive_ids"), "p_scores": _ints(row, "a_positive_scores")}
        low, high = np.full((most, len(sizes)), 1), np.zeros((most, len(sizes)), dtype=np.int64)  # no window: nothing fits
        low[own["place"], own["owner"]], high[own["place"], own["owner"]] = window_of(own["p_scores"], least_pct, most_pct)
        return own | {"low": low, "high": high}, [Heaps(len(sizes), n_negative) for _ in range(most)]

    def offer(own, heaps, first, part, scores, ids, labels):
        other = own["labels"][part, None] != labels
        for heap, low, high in zip(heaps, own["low"], own["high"], strict=True):
            heap.push(first, scores, other & (scores >= low[part, None]) & (scores <= high[part, None]), ids)

    def out(own, heaps):
        number = {(int(o), int(p)): k for k, (o, p) in enumerate(zip(own["owner"], own["place"], strict=True))}
        for place, heap in enumerate(heaps):
            owner, score, named = heap.entries()
            if len(owner):
                at = np.array([number[int(o), place] for o in owner])
                yield pa.RecordBatch.from_pydict({"anchor_id": own["ids"][owner], "place": np.full(len(owner), place), "positive_id": own["p_ids"][at], "positive_score": own["p_scores"][at], "score": score, "id": named})

    return tidy(lambda batches: _swept(batches, start, offer, out))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def valid_rows(vectors: DataFrame, label=None, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with integer components."""
    label = F.col("label") if label is None else label
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


def mine(rows: DataFrame, is_anchor, n_positive: int = 5, n_negative: int = 3, least_pct: int = 50, most_pct: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, v)."""
    least = F.min(F.struct("label", "v")).alias("r")
    anchors = cut(rows.filter(is_anchor).groupBy("vec_id").agg(least).select("vec_id", "r.label", "r.v"))
    sized = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v") + 120), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-sized.n // ANCHORS))
    blocks = cut_table(rows.select("vec_id", "label", "v").mapInArrow(_blocks, _BLOCK_SQL))
    unknown = F.lit(None).cast("array<struct<score:bigint,id:bigint>>")
    tiles = _tiles(blocks, _anchor_blocks(anchors.withColumn("positives", unknown), n_blocks), n_blocks, sized.bytes)
    found = _first(tiles.mapInArrow(_positive_pass(n_positive), "anchor_id long, score long, id long"), ["anchor_id"], n_positive)
    # at most n_positive entries an anchor
    positives = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    positives = positives.select("vec_id", F.transform("p", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives"))
    known = cut(anchors.join(positives, "vec_id"))
    tiles = _tiles(blocks, _anchor_blocks(known, n_blocks), n_blocks, sized.bytes)
    kind = "anchor_id long, place long, positive_id long, positive_score long, score long, id long"
    out = _first(tiles.mapInArrow(_negative_pass(n_negative, least_pct, most_pct), kind), ["anchor_id", "place"], n_negative)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
