"""SimHash document fingerprints and search within a Hamming radius.

Every pair of neighbouring words of a text is a term; each occurrence votes with the term's length on 128 signed
bits of its hash. Likeness of two fingerprints is the share of equal bits. The search has one permuted table for each
way to choose ``blocks - radius`` of the fingerprint's blocks: two fingerprints within the radius agree on at least one
such choice, so looking up the chosen bits in every table finds them all, and an exact bit count decides. Distinct
fingerprints are packed, queries into blocks of QUERIES and the others into batches of PRINTS; every batch meets every
block of queries (a stated query set) in one tile, which sorts its tables and looks up in memory, so no table is sent
anywhere and no key can be hot.

Defined cases: null texts count as empty; texts without words have the all-zero fingerprint; a text of one word
votes with that word alone; equal texts have equal fingerprints; a table of one document is its own successor;
rows with equal ids follow each other in text order; null ids come last; texts are read
whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, tidy

BITS = 128
#: Near copies (a fifth of the five-word shingles differs at most) lie about 10 to 20 bits apart.
RADIUS, BLOCKS = 20, 22
#: Queries of a block, fingerprints of a batch, and candidates that are compared at once.
QUERIES, PRINTS, PAIRS = 50_000, 20_000, 1 << 20
CACHE_ENTRIES = 400_000
CHUNK = 50_000


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Simhasher:
    """Fingerprints of texts; word hashes are cached in the worker up to a bound."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            found = self.words[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found

    def __call__(self, text: str) -> bytes:
        words = text.split()
        if not words:
            return bytes(BITS // 8)
        hashes = np.fromiter(map(self._hash, words), dtype=np.uint64, count=len(words))
        lengths = np.fromiter(map(len, words), dtype=np.float32, count=len(words))
        if len(words) > 1:
            hashes = _spread(hashes[:-1], 1) + _spread(hashes[1:], 2) * np.uint64(3)
            lengths = lengths[:-1] + lengths[1:]
        both = np.stack([_spread(hashes, 3), _spread(hashes, 4)], axis=1)
        votes = np.zeros(BITS)
        for k in range(0, len(both), CHUNK):
            bits = np.unpackbits(both[k : k + CHUNK].view(np.uint8).reshape(-1, BITS // 8), axis=1)
            votes += lengths[k : k + CHUNK] @ bits.astype(np.float32)
        return np.packbits(votes * 2 > float(lengths.sum(dtype=np.float64))).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The second half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(simhash: Simhasher, doc_id: int | None, text: str, mine: bytes, following: str, theirs: bytes) -> tuple:
    changed = edited(text, following)
    other = simhash(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, mine.hex(), other.hex(), likeness(mine, other), likeness(mine, theirs))


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = Simhasher()
        for batch in batches:
            rows = [(i, len(t.as_py() or ""), simhash(t.as_py() or "").hex()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield _batch(rows, [_FIELDS[0], _FIELDS[1], _FIELDS[3]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text. Documents are range-partitioned by descending id once;
    a task pairs each with its successor as it streams, and sends the first and last document of its range on, so
    that the few pairs across ranges are finished apart."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = (F.desc_nulls_last("doc_id"), F.asc("text"))
    # ranges by id alone: the sample that sets them holds no texts, and equal ids stay together
    ordered = ordered.repartitionByRange(order[0]).sortWithinPartitions(*order)
    fields = [*_FIELDS, ("kind", pa.string()), ("part", pa.int32()), ("text", pa.string())]
    blank = (None,) * 3

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash, part = Simhasher(), TaskContext.get().partitionId()
        last: tuple | None = None
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                mine = simhash(text)
                if last is None:
                    rows.append((doc_id, len(text), None, mine.hex(), *blank, "head", part, text))
                else:
                    rows.append((*_pair(simhash, *last, text, mine), "done", part, None))
                last = (doc_id, text, mine)
            yield _batch(rows, fields)
        if last is not None:
            yield _batch([(last[0], len(last[1]), None, last[2].hex(), *blank, "open", part, last[1])], fields)

    made = cut(ordered.mapInArrow(run, f"{_SCHEMA}, kind string, part int, text string"))
    # the ranges that hold documents, by number: as many as the exchange has partitions
    parts = [r.part for r in made.filter("kind = 'head'").select("part").sort("part").collect()]
    following = made.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = made.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    opens = made.filter("kind = 'open'").select("part", "doc_id", "text").join(F.broadcast(following), "part")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = Simhasher()
        for batch in batches:
            rows = [_pair(simhash, i, a, simhash(a), b, simhash(b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(rows, _FIELDS)

    ends = opens.join(heads, "next_part").select("doc_id", "text", "next_text").mapInArrow(finish, _SCHEMA)
    return made.filter("kind = 'done'").select(*[n for n, _ in _FIELDS]).unionByName(ends)


def _values(prints: np.ndarray, blocks: int) -> tuple[np.ndarray, list[int]]:
    """The blocks of packed fingerprints as numbers, and each block's width."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    bits = np.unpackbits(prints, axis=1).astype(np.int64)
    values = np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(edges, edges[1:], strict=False)], axis=1)
    return values, np.diff(edges).tolist()


def _keys(values: np.ndarray, widths: list[int], chosen: tuple[int, ...]) -> np.ndarray:
    key = np.zeros(len(values), dtype=np.int64)
    for k in chosen:
        key = key << widths[k] | values[:, k]
    return key


def matches(queries: np.ndarray, prints: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, print, distance) of all pairs of different packed fingerprints (16 bytes a row) within the radius."""
    (q_values, widths), (p_values, _) = _values(queries, blocks), _values(prints, blocks)
    q_words, p_words = (np.ascontiguousarray(x).view(np.uint64) for x in (queries, prints))
    found: list[np.ndarray] = []
    for chosen in combinations(range(blocks), blocks - radius):
        q_keys = _keys(q_values, widths, chosen)
        order = np.argsort(q_keys, kind="stable")
        ranked, p_keys = q_keys[order], _keys(p_values, widths, chosen)
        low = np.searchsorted(ranked, p_keys)
        n = np.searchsorted(ranked, p_keys, side="right") - low
        ends = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            row = np.repeat(np.arange(a, b), n[a:b])
            at = order[np.repeat(low[a:b] - (ends[a:b] - n[a:b]), n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])]
            distance = np.bitwise_count(q_words[at] ^ p_words[row]).sum(axis=1)
            near = (distance <= radius) & (distance > 0)
            found.append(np.stack([at[near], row[near], distance[near].astype(np.int64)]))
            a = b
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    return pairs[0], pairs[1], pairs[2]


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= PRINTS:
            yield pa.RecordBatch.from_pydict({"prints": [bytes.fromhex("".join(held[:PRINTS]))]})
            held = held[PRINTS:]
    if held:
        yield pa.RecordBatch.from_pydict({"prints": [bytes.fromhex("".join(held))]})


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, match, distance) of different fingerprint strings within the radius. Both inputs have a column
    ``fingerprint``; equal fingerprints are one row, so copies never multiply."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be less than the number of blocks")
    known = lambda df: df.select("fingerprint").filter("fingerprint is not null").distinct()
    own = cut(known(queries))
    n_blocks = max(1, -(-own.count() // QUERIES))

    def block(rows: pa.Table) -> pa.Table:
        return pa.table({"block": rows["block"][:1], "queries": [bytes.fromhex("".join(sorted(rows["fingerprint"].to_pylist())))]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b = (np.frombuffer(row[name], dtype=np.uint8).reshape(-1, BITS // 8) for name in ("queries", "prints"))
                at, of, distance = matches(a, b, radius, blocks)
                for c in range(0, len(at), 10_000):
                    part = slice(c, c + 10_000)
                    yield pa.RecordBatch.from_pydict({"query": [a[i].tobytes().hex() for i in at[part]], "match": [b[i].tobytes().hex() for i in of[part]], "distance": distance[part].astype(np.int32)})

    asked = own.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.lit(n_blocks))).groupBy("block").applyInArrow(block, "block long, queries binary")
    packed = known(fingerprints).mapInArrow(_packed, "prints binary")
    numbered = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    tiles = numbered.join(F.broadcast(asked) if n_blocks == 1 else asked, "block")  # one block has a fixed size
    return tiles.mapInArrow(tidy(run), "query string, match string, distance int")
