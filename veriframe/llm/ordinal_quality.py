"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a hashed bag of its words, of word shapes (classes of characters, runs collapsed) and of marks for words
that repeat their neighbour. One weight vector is shared by all grades; ordered thresholds cut its score, and the
logistic link gives P(grade >= k). The expected grade and the tail probability select documents.

Ratings: ``grade`` from 0 up; an empty table gives an empty table. Defined cases: null and empty texts have no features and get the thresholds' own
probabilities; rows with a null grade are ignored; a document rated twice counts with its lowest grade; with fewer
than two grades every document is kept with tail probability 1; texts are read whole; repeated rows score alike;
other columns are ignored. The fit reads a bounded, hash-chosen sample of ratings (``max_train_docs``, an expected
number) as sparse rows on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import hash_below, held_out

BUCKETS = 1 << 15
#: The feature beside the hashed ones: words that repeat their neighbour.
REPEATS = BUCKETS
MAX_TRAIN_DOCS = 5_000
STEPS = 150
RATE = 0.1
RIDGE = 1e-4
KEEP_AT = 0.5
CACHE_ENTRIES = 500_000


def shape(word: str) -> str:
    """Classes of the word's characters with runs collapsed, e.g. ``Aa`` or ``a*``."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Features:
    """Sparse rows of texts; a worker's cache of hashed words is bounded."""

    def __init__(self):
        self.words: dict[str, tuple[int, int]] = {}

    def _of(self, word: str) -> tuple[int, int]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            hashed = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS
            found = self.words[word] = (hashed("w" + word.lower()), hashed("s" + shape(word)))
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        both = np.array(list(map(self._of, words)), dtype=np.int64)
        same = int((both[1:, 0] == both[:-1, 0]).sum())
        ids = np.concatenate([both.ravel(), np.full(same, REPEATS)])
        index, times = np.unique(ids, return_counts=True)
        value = np.log1p(times)
        return index, value / np.sqrt((value**2).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, and the logarithms of the steps to the next."""
    return np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def loss(weights: np.ndarray, free: np.ndarray, index: np.ndarray, value: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with the ridge penalty, and its gradients by weights and by free thresholds. The
    sparse rows are given as features, values and row numbers."""
    n, cuts = len(y), cuts_of(free)
    score = np.bincount(owner, weights=value * weights[index], minlength=n)
    tail = _sigmoid(score[:, None] - cuts[None, :])  # P(y >= k)
    edge = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
    at = np.arange(n)
    p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-12)
    slope = edge * (1 - edge)
    by_score = -(slope[at, y] - slope[at, y + 1]) / p / n
    by_cut = np.array([(((y == k + 1) * slope[:, k + 1] - (y == k) * slope[:, k + 1]) / p).sum() / n for k in range(len(cuts))])
    by_free = np.array([by_cut.sum(), *(by_cut[k + 1 :].sum() * np.exp(free[k + 1]) for k in range(len(cuts) - 1))])
    by_weight = np.bincount(index, weights=value * by_score[owner], minlength=len(weights)) + RIDGE * weights
    return float(-np.log(p).mean() + RIDGE / 2 * (weights**2).sum()), by_weight, by_free


def fit(rows: list[tuple[list[int], list[float], int]], grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by gradient steps on the penalised likelihood."""
    index = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1], dtype=float) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    above = np.array([float((y >= k).mean()) for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))  # P(y >= k) = sigmoid(score - threshold_k)
    size = BUCKETS + 1
    at = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    moments = [np.zeros(len(at)), np.zeros(len(at))]
    for step in range(1, STEPS + 1):
        g = np.concatenate(loss(at[:size], at[size:], index, value, owner, y)[1:])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        at = at - RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    return at[:size], cuts_of(at[size:])


def grade_of(quality: Column, toxic: Column) -> Column:
    """The graded rating of a label row: 0 low quality, 1 sound but toxic, 2 sound."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """``ratings`` has doc_id and grade. Held-out ids are never learned from."""
    own = ratings.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = own.filter(hash_below(F.col("doc_id"), max_train_docs / max(own.count(), 1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            made = [features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0].tolist() for m in made], pa.list_(pa.int64())), pa.array([m[1].tolist() for m in made], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["index", "value", "grade"])

    # about max_train_docs ids and grades, so they may be broadcast and the texts stay where they are
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    rows = [(r.index_, r.value, r.grade) for r in joined.mapInArrow(run, "index array<long>, value array<double>, grade int").withColumnRenamed("index", "index_").collect()]
    grades = sorted({r[2] for r in rows})
    if len(grades) < 2:
        return {"grades": grades, "weights": np.zeros(BUCKETS + 1), "cuts": np.zeros(0)}
    weights, cuts = fit([(i, v, grades.index(y)) for i, v, y in rows], len(grades))
    return {"grades": grades, "weights": weights, "cuts": cuts}


def score(docs: DataFrame, model: dict, least_grade: int = 1, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``least_grade`` or better) and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the corpus
    kinds = (("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), shared.value
        grades = np.array(own["grades"], dtype=float)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index, value = features(text.as_py() or "")
                if len(grades) < 2:
                    out.append((doc_id, float(grades[0]) if len(grades) else None, 1.0, True))
                    continue
                tails = _sigmoid(float(value @ own["weights"][index]) - own["cuts"])
                expected = grades[0] + float((np.diff(grades) * tails).sum())
                above = np.flatnonzero(grades >= least_grade)
                tail = 0.0 if not len(above) else 1.0 if above[0] == 0 else float(tails[above[0] - 1])
                out.append((doc_id, expected, tail, tail >= keep_at))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
