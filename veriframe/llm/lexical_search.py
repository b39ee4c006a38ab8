"""Ranked lexical search over per-term posting lists in geometric blocks.

The corpus is cut into shards where it is read, so no exchange deals documents and no key can be hot. In a shard every
posting list is clustered by the similarity of its documents (random projections of their weighted term vectors, a
document goes to the most similar of a few seeds of the list), and a cluster is a block. A block's summary is the
coordinatewise maximum of its documents' term impacts, over the terms of the queries that hold the list's term. For a
query, the summary's inner product with the query weights is an exact upper bound of every score in the block: a block
is skipped only where that bound is below a score that 50 documents are known to reach, and so is a whole list where the
sum of the lowest lists' maxima stays below it. What is not skipped is scored exactly, so results equal a full scan.

The known scores come from a first sweep, which scores the documents of each query's rarest lists in every shard.

The term weight and the impact are integers (see ``weights`` and ``impacts``); scores are exact 64-bit integers.

Defined cases. Null and empty texts have no terms and are never found. Documents without an id count in all statistics
and cannot be found. Rows of equal id are documents of their own. Rows of one item id are one item with the terms of
all; items without a term, or of an empty corpus, have no rows. Texts are read whole. Ties go to the smaller id. Further
columns are ignored. Items are taken ITEMS at a time (about, by hash); every batch of them reads the corpus again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut_table, parts_of, tidy
from veriframe.llm.words import TERM_BYTES, split_words

#: Items of a pass; postings of a block, about; entries of a shard's matrix; documents of a shard at most; width of the
#: projection by which documents are similar.
ITEMS, BLOCK, CELLS, DOCS, SKETCH = 512, 24, 6_000_000, 2_048, 16
K1_SCALE, NORM_SCALE, SHARE = 1_000, 20, 50


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - SHARE + (SHARE * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (K1_SCALE * tf + NORM_SCALE * m)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, 1):
            terms, of = split_words(part.column(1), TERM_BYTES)
            yield pa.RecordBatch.from_pydict({"item_id": part.column(0).take(pa.array(of)), "term": terms.cast(pa.binary())})

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(tidy(run), "item_id long, term binary").distinct()


def _vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its number of terms, and the vocabulary's terms in it
    (numbers and counts as 32-bit integers)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for part in parts_of(batches, 1):
            terms, of = split_words(part.column(1), TERM_BYTES)
            n = np.bincount(of, minlength=part.num_rows)
            number = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)
            hit = number >= 0
            key, count = np.unique(of[hit] * len(vocabulary) + number[hit], return_counts=True)
            row = key // len(vocabulary)
            ends = 4 * np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.astype(np.int32))]) for x in (key % len(vocabulary), count)]
            made = pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n long, terms binary, counts binary")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents of each vocabulary term: counted in each task, summed in Spark, one row a term at the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]})

    out = np.zeros(size, dtype=np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a column of packed lists, and each list's length."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int32).astype(np.int64), lengths.astype(np.int64)


class Shard:
    """Some documents' term impacts, and the blocks of their posting lists, made when first asked for."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, weight: np.ndarray, coordinates: list[np.ndarray], block: int = BLOCK):
        self.ids, self.matrix, self.weight, self.coordinates, self.block = ids, matrix, weight, coordinates, block
        self.most, self.df = matrix.max(axis=0), np.count_nonzero(matrix, axis=0)
        signs = np.random.default_rng(17).integers(0, 2, (matrix.shape[1], SKETCH)).astype(np.float32) * 2 - 1
        sketch = matrix.astype(np.float32) @ (signs * weight[:, None].astype(np.float32))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-12)
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by block, each block's first place, summaries over the term's coordinates)."""
        if term not in self.made:
            held = np.flatnonzero(self.matrix[:, term])
            first = np.zeros(1, dtype=np.int64)
            if len(held) > self.block:
                seeds = held[:: self.block]
                nearest = np.argmax(self.sketch[held] @ self.sketch[seeds].T, axis=1)
                order = np.argsort(nearest, kind="stable")
                held, nearest = held[order], nearest[order]
                first = np.flatnonzero(np.append(True, nearest[1:] != nearest[:-1]))
            summary = np.maximum.reduceat(self.matrix[np.ix_(held, self.coordinates[term])], first, axis=0)
            self.made[term] = held, first, summary
        return self.made[term]

    def scores(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return self.matrix[np.ix_(rows, terms)].astype(np.int64) @ self.weight[terms]

    def rare(self, terms: np.ndarray, k: int) -> np.ndarray:
        """The documents of the rarest lists, at least ``k`` if the lists have as many."""
        lists = terms[np.argsort(self.df[terms], kind="stable")]
        lists = lists[self.df[lists] > 0]
        enough = np.searchsorted(np.cumsum(self.df[lists]), 2 * k) + 1
        return np.flatnonzero(self.matrix[:, lists[:enough]].any(axis=1))

    def reachable(self, terms: np.ndarray, places: list[np.ndarray], floor: int, seen: list[int]) -> np.ndarray:
        """The documents of all blocks whose bound reaches ``floor``, in lists that a document at the floor must be in.
        ``seen`` counts blocks looked at and skipped."""
        bound = self.weight[terms] * self.most[terms]
        order = np.argsort(bound, kind="stable")
        low = np.searchsorted(np.cumsum(bound[order]), floor)  # these lists together stay below the floor
        found = []
        for k in order[low:]:
            if not self.df[terms[k]]:
                continue
            held, first, summary = self.blocks(int(terms[k]))
            open_ = summary[:, places[k]].astype(np.int64) @ self.weight[terms] >= floor
            seen[0] += len(open_)
            seen[1] += len(open_) - int(open_.sum())
            if open_.any():
                found.append(held[np.repeat(open_, np.diff(np.append(first, len(held))))])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _shards(batches: Iterable[pa.RecordBatch], plan: dict) -> Iterator[Shard]:
    """Shards of so many documents that the matrix has at most CELLS entries."""
    size, held, n_held = len(plan["weight"]), [], 0
    most = max(1, min(DOCS, CELLS // size))

    def shard() -> Shard:
        ids, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        term, count, length = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
        row = np.repeat(np.arange(len(ids)), length)
        matrix = np.zeros((len(ids), size), dtype=np.int32)
        matrix[row, term] = impacts(count, n[row], plan["n_docs"], plan["n_terms"])
        held.clear()
        return Shard(ids, matrix, plan["weight"], plan["coordinates"])

    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            if held and n_held + part.num_rows > most:
                yield shard()
                n_held = 0
            term, length = _flat(part.column(2))
            held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(), term, _flat(part.column(3))[0], length))
            n_held += part.num_rows
    if held:
        yield shard()


def _swept(vectors: DataFrame, plan: dict, k: int, floors: list[int] | None) -> DataFrame:
    """(item, doc_id, score): each task's ``k`` best documents of every item. Without ``floors`` only the documents of
    the rarest lists are scored; with them, all that may reach their item's floor."""
    queries, floors_known = plan["queries"], floors is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = plan["coordinates"]
        places = [[np.searchsorted(coordinates[t], q) for t in q] for q in queries]
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in queries]
        floor = list(floors) if floors_known else [1] * len(queries)
        seen = [0, 0]
        for shard in _shards(batches, plan):
            for i, terms in enumerate(queries):
                rows = shard.reachable(terms, places[i], floor[i], seen) if floors_known else shard.rare(terms, k)
                if not len(rows):
                    continue
                score = shard.scores(rows, terms)
                good = score >= floor[i]
                score, named = np.concatenate([best[i][0], score[good]]), np.concatenate([best[i][1], shard.ids[rows[good]]])
                order = np.lexsort((named, -score))[:k]
                best[i] = score[order], named[order]
                if len(order) == k:
                    floor[i] = max(floor[i], int(score[order[-1]]))
        item = np.repeat(np.arange(len(queries)), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_pydict({"item": item, "doc_id": np.concatenate([d for _, d in best]), "score": np.concatenate([s for s, _ in best])})

    return vectors.mapInArrow(tidy(run), "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _plan(terms: DataFrame, docs: DataFrame) -> tuple[DataFrame, dict, list]:
    """The documents' vectors and what a sweep needs to know, for one batch of items."""
    rows = sorted(((r.item_id, bytes(r.term)) for r in terms.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vocabulary = sorted({t for _, t in rows})
    number = {t: k for k, t in enumerate(vocabulary)}
    names = list(dict.fromkeys(i for i, _ in rows))
    at = {name: k for k, name in enumerate(names)}
    queries: list[list[int]] = [[] for _ in names]
    for name, t in rows:
        queries[at[name]].append(number[t])
    queries = [np.array(q) for q in queries]
    together: list[set] = [set() for _ in vocabulary]
    for q in queries:
        for t in q:
            together[t].update(q.tolist())
    vectors = cut_table(_vectors(docs, vocabulary))
    total = vectors.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    weight = weights(_frequencies(vectors, len(vocabulary)), total.n_docs)
    plan = {"queries": queries, "coordinates": [np.array(sorted(c)) for c in together], "weight": weight, "n_docs": total.n_docs, "n_terms": total.n_terms}
    return vectors.filter("doc_id is not null"), plan, names


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ranks from 1."""
    spark = docs.sparkSession
    terms = cut_table(item_terms(items))
    batches = -(-terms.select("item_id").distinct().count() // ITEMS)
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for b in range(batches):
        vectors, plan, names = _plan(terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b), docs)
        if not names or not plan["n_docs"]:
            continue
        lowest = _ranked(_swept(vectors, plan, k, None), k).filter(F.col("rank") == k).select("item", "score").collect()
        floors = [1] * len(names)
        for r in lowest:
            floors[r.item] = r.score
        named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "item long, item_id long"))  # ITEMS rows, about
        out.append(_ranked(_swept(vectors, plan, k, floors), k).join(named, "item").select("item_id", "rank", "doc_id", "score"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
