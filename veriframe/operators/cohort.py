"""Score normalisation against a large cohort, in blocks.

Sides are dealt into strips of bounded size, one a task. A strip is held in memory and the whole cohort streams past it in
blocks (it may be of any size; nothing is broadcast), so what is exchanged is the cohort once for every strip, and no
partial result. A task keeps the best scores of each side in a bounded heap. Every side meets every member: the work grows
with sides times cohort. Scores are minus the Euclidean distance. Ties at the end of a heap do not matter, as only the
best scores' mean and deviation are taken."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of sides and of a cohort block; blocks of sides that a strip holds at most; rows that are worth a strip.
SIDES, MEMBERS, OPEN, WORTH = 1_024, 2_048, 32, 256


def _packed(rows: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, keys, matrix, single): the vectors of rows (key, v), dealt by hash into blocks of bounded size."""

    kind = rows.schema["v"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # floats travel as floats

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32 if kind == "float" else np.float64)
        return pa.table({"block": rows["block"][:1], "keys": [rows["key"].to_numpy().astype(np.int64).tobytes()], "matrix": [flat.tobytes()]})

    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), F.col(key).cast("long").alias("key"), F.col("v").cast(f"array<{kind}>").alias("v"))
    made = dealt.groupBy("block").applyInArrow(pack, "block long, keys binary, matrix binary")
    return made.select("block", "keys", "matrix", F.lit(kind == "float").alias("single"))


class Heaps:
    """The ``top_n`` least squared distances of each of some vectors, as negative squares: the largest stay."""

    def __init__(self, sides: np.ndarray, top_n: int):
        self.sides, self.norms, self.top_n = sides, (sides**2).sum(axis=1), top_n
        self.wide = np.column_stack([2 * sides, -self.norms, np.ones(len(sides))])  # times (v, 1, -|v|^2): negative squares
        self.best = np.zeros((len(sides), 0))

    def _near(self, found: np.ndarray, row: np.ndarray, column: np.ndarray, members: np.ndarray, norms: np.ndarray) -> None:
        """Squares come from products; those of near pairs, where these cancel, are taken again from the differences."""
        at = np.nonzero(found > -1e-2 * (self.norms[row] + norms[column]))[0]
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            found[some] = -((self.sides[row[some]] - members[column[some]]) ** 2).sum(axis=1)

    def add(self, members: np.ndarray) -> None:
        norms = (members**2).sum(axis=1)
        wide = np.column_stack([members, np.ones(len(members)), -norms]).T
        full = self.best.shape[1] == self.top_n
        grown = np.full((len(self.sides), min(self.top_n, self.best.shape[1] + len(members))), -np.inf)
        for a in range(0, len(self.sides), SIDES // 4):
            rows = slice(a, a + SIDES // 4)
            squares = self.wide[rows] @ wide
            if full:  # only what comes above a heap's least, but for errors of rounding; nothing is nearer than 0
                floor = self.best[rows].min(axis=1)
                floor = np.where(floor < 0, floor - 1e-13 * (self.norms[rows] + norms.max()), np.inf)
                row, column = np.nonzero(~(squares <= floor[:, None]))
            else:
                row, column = (x.ravel() for x in np.indices(squares.shape))
            found = squares[row, column]
            self._near(found, row + a, column, members, norms)
            own, first, n = np.unique(row, return_index=True, return_counts=True)
            more = np.full((len(own), n.max(initial=0)), -np.inf)
            more[np.repeat(np.arange(len(own)), n), np.arange(len(row)) - np.repeat(first, n)] = found
            if full:
                self.best[own + a] = merged(self.best[own + a], more, self.top_n)
            else:
                grown[own + a] = merged(self.best[own + a], more, self.top_n)
        if not full:
            self.best = grown

    def scores(self) -> np.ndarray:
        return -np.sqrt(np.maximum(-self.best, 0))


def merged(heaps: np.ndarray, more: np.ndarray, top_n: int) -> np.ndarray:
    """The ``top_n`` largest of each row of both."""
    both = np.concatenate([heaps, more], axis=1)
    return both if both.shape[1] <= top_n else np.partition(both, both.shape[1] - top_n, axis=1)[:, -top_n:]


def top_statistics(sides: DataFrame, cohort: DataFrame, top_n: int = 200) -> DataFrame:
    """(side, mu, sigma): mean and population deviation of each side's ``top_n`` best scores against the cohort (all, if
    it has fewer). ``sides`` has (side, v), unique; ``cohort`` has (cohort_id, v); all vectors have one length. Null
    vectors take no part; without a cohort no side has statistics."""
    sides, cohort = (x.filter("v is not null") for x in (sides, cohort))
    n_sides, n_members = sides.count(), cohort.count()
    tasks = 2 * sides.sparkSession.sparkContext.defaultParallelism
    strips = max(1, -(-n_sides // (OPEN * SIDES)), min(tasks, n_sides // WORTH))
    held = _packed(sides, "side", strips * max(1, -(-n_sides // (strips * SIDES)))).withColumn("strip", F.pmod("block", F.lit(strips)))
    passing = _packed(cohort, "cohort_id", max(1, -(-n_members // MEMBERS))).withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))
    both = held.withColumn("member", F.lit(False)).unionByName(passing.withColumn("member", F.lit(True)))
    dealt = both.repartitionById(strips, F.col("strip").cast("int")).sortWithinPartitions("member")  # one strip a task, its sides first

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors, heaps = [], [], None
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            n = len(row["keys"]) // 8
            matrix = np.frombuffer(row["matrix"], np.float32 if row["single"] else np.float64).reshape(n, -1).astype(np.float64)
            if not row["member"]:
                keys.append(np.frombuffer(row["keys"], np.int64))
                vectors.append(matrix)
            elif vectors:
                heaps = heaps or Heaps(np.concatenate(vectors), top_n)
                heaps.add(matrix)
        if heaps:
            scores = heaps.scores()
            yield pa.RecordBatch.from_pydict({"side": np.concatenate(keys), "mu": scores.mean(axis=1), "sigma": scores.std(axis=1)})

    return dealt.select("keys", "matrix", "single", "member").mapInArrow(sweep, "side long, mu double, sigma double")
