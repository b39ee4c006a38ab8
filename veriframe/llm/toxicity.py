"""Toxic passages: maximum-scoring segments over token log-odds.

Every word weighs its log-odds ratio of toxic against clean labelled text under an informative Dirichlet prior (the
words' overall frequencies), shrunk by its own error: ``delta * z**2 / (z**2 + SHRINK)``; words are counted in hash
buckets, so the model has one size whatever the vocabulary, and words never seen weigh nothing. A drift is taken off
every word. A linear-time scan finds all maximal-scoring segments of a text. The largest scores of clean texts follow
an extreme-value law, P(max >= s) = 1 - exp(-K * words * exp(-lambda * s)); lambda and K are fitted to the maxima of
clean labelled texts by maximum likelihood. They give a segment's E-value. A text's evidence adds up over all its
significant passages, and a logistic curve fitted to labelled texts makes it a probability.

Defined cases: null and empty texts have no passages and get the score of the least evidence; labels other than 0
and 1 are ignored; a document labelled twice counts once, as toxic if either label says so; without toxic or clean
training rows every score is 0; texts are read whole; repeated rows score alike; other columns are ignored; an
empty table gives an empty table. The model
is learned from a bounded, hash-chosen sample of the labelled rows (``max_train_docs``, an expected number).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut, hash_below, held_out

MAX_TRAIN_DOCS = 24_000
#: Hash buckets that words are counted in.
BUCKETS = 1 << 20
#: Weight of the prior, as a share of the counted words.
PRIOR_SHARE = 0.1
#: Square of the z value at which half of a log-odds ratio counts.
SHRINK = 9.0
#: Words of ordinary text that cancel one average toxic word. This and SHRINK had the least logarithmic loss of seven pairs
#: on the training rows of sf0.1, and a smaller one than the former pair (9, 8) in five folds of these; held-out rows
#: took no part in the choice.
REACH = 4
SIGNIFICANT = 0.05
PREDICT_AT = 0.3
#: Evidence (powers of ten below SIGNIFICANT) is held between these.
LEAST, MOST = -6.0, 12.0
CACHE_ENTRIES = 200_000
_STRIP = ".,;:!?\"'()[]{}*%$&#|<>-_/\\"


def normal(token: str) -> str:
    return token.strip(_STRIP).lower()


def bucket(token: str) -> int:
    """The hash bucket of a token, -1 where nothing is left of it."""
    word = normal(token)
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS if word else -1


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Shrunk log-odds ratios of the buckets, from the numbers of texts with them."""
    n0, n1 = float(clean.sum()), float(toxic.sum())
    prior = PRIOR_SHARE * (clean + toxic)
    whole = float(prior.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = lambda y, n: np.log((y + prior) / (n + whole - y - prior))
        delta = ratio(toxic, n1) - ratio(clean, n0)
        z = delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        out = delta * z**2 / (z**2 + SHRINK)
    return np.where((clean + toxic > 0) & np.isfinite(out), out, 0.0)


class Weights(dict):
    """Weight of a raw token without the drift; a worker's bounded cache."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, token: str) -> float:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        at = bucket(token)
        found = self[token] = float(self.table[at]) if at >= 0 else 0.0
        return found


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end word, score). Linear in the number of words: a stack of candidate
    segments, each with the running sum before and after it and the last one below that began lower."""
    sums = np.append(0.0, np.cumsum(weights))
    stack: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(weights > 0).tolist():
        first, low, high = at, float(sums[at]), float(sums[at + 1])
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= high:
                stack.append((first, at + 1, low, high, k))
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def text_segments(text: str | None, weights: Weights, drift: float) -> tuple[int, list[tuple[int, int, float]]]:
    """(words, segments) of a text."""
    tokens = (text or "").split()
    own = np.fromiter(map(weights.__getitem__, tokens), dtype=np.float64, count=len(tokens)) - drift
    return len(tokens), segments(own)


def e_value(score: float, n_words: int, model: dict) -> float:
    return model["k"] * max(n_words, 1) * math.exp(-min(model["lambda"] * score, 700.0))


def evidence(n_words: int, found: list[tuple[int, int, float]], model: dict) -> float:
    """Powers of ten by which E-values lie below SIGNIFICANT, added up over the significant passages; without any,
    that of the best segment, which is negative."""
    below = [math.log10(SIGNIFICANT / max(e_value(s, n_words, model), 1e-300)) for _, _, s in found]
    held = [x for x in below if x >= 0]
    return min(MOST, sum(held)) if held else max(LEAST, max(below, default=LEAST))


def probability(x: float, model: dict) -> float:
    a, b = model["curve"]
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * x))))


def fit_maxima(n_words: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the largest scores of texts with so many words, by maximum likelihood: for a lambda the best K is
    ``texts / sum(words * exp(-lambda * max))``, and lambda is found by halving."""
    mean = best.mean()

    def slope(x: float) -> float:  # of the log-likelihood; falls from infinity to below 0
        w = n_words * np.exp(-x * (best - best.min()))
        return 1 / x - mean + float((w * best).sum() / w.sum())

    low, high = 1e-6, 1.0
    while slope(high) > 0 and high < 1e6:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return high, float(len(best) / (n_words * np.exp(-high * best)).sum())


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps; one text more of each kind at either end keeps it finite."""
    x = np.concatenate([x, [x.min(), x.min(), x.max(), x.max()]])
    y = np.concatenate([y, [0, 1, 0, 1]]).astype(float)
    weight = np.ones(len(x))
    weight[-4:] = (0.75, 0.25, 0.25, 0.75)
    beta = np.zeros(2)
    rows = np.column_stack([np.ones(len(x)), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -500, 500)))
        grad = rows.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    own = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.filter(hash_below(F.col("doc_id"), max_train_docs / max(own.count(), 1)))
    # about max_train_docs ids and labels, so they may be broadcast and the texts stay where they are
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    # read for the counts and again for the maxima: written once instead of joined twice
    rows = cut(training_rows(docs, labels, max_train_docs).withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(10)) < 3))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        buckets: dict[str, int] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = set()
                for token in set((text.as_py() or "").split()):
                    at = buckets.get(token)
                    if at is None:
                        if len(buckets) > CACHE_ENTRIES:
                            buckets.clear()
                        at = buckets[token] = bucket(token)
                    own.add(at)
                own.discard(-1)
                # once a document: a text that repeats a word is no further evidence
                sums[int(label), np.fromiter(own, dtype=np.int64, count=len(own))] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "clean", "toxic"])

    counted = rows.filter(~F.col("check")).select("text", "toxic").mapInArrow(count, "bucket long, clean long, toxic long")
    counted = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # at most BUCKETS rows
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    clean[counted["bucket"].to_numpy(dtype=int)], toxic[counted["bucket"].to_numpy(dtype=int)] = counted["clean"].to_numpy(), counted["toxic"].to_numpy()
    none = {"table": np.zeros(1, dtype=np.float32), "drift": 1.0, "lambda": 1.0, "k": 1.0, "curve": None}
    if not clean.sum() or not toxic.sum():
        return none
    table = log_odds(clean, toxic)
    # the average weight of the evidence that toxic texts have in excess
    excess = np.maximum(toxic / toxic.sum() - clean / clean.sum(), 0.0) * np.maximum(table, 0.0)
    mean = float((excess * table).sum() / excess.sum()) if excess.sum() else 0.0
    model = none | {"table": table.astype(np.float32), "drift": max(mean, 1e-3) / REACH}
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value["table"])
        for batch in batches:
            made = [text_segments(t.as_py(), weights, shared.value["drift"]) for t in batch.column(0)]
            scores = [[s for _, _, s in found] for _, found in made]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array(scores, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["n", "scores", "toxic"])

    # a few numbers for each of about 0.3 * max_train_docs texts
    checked = [(r.n, r.scores, r.toxic) for r in rows.filter("check").select("text", "toxic").mapInArrow(measure, "n long, scores array<double>, toxic int").collect()]
    maxima = [(n, max(scores)) for n, scores, label in checked if scores and not label]
    if maxima:
        model["lambda"], model["k"] = fit_maxima(np.array([n for n, _ in maxima], dtype=float), np.array([s for _, s in maxima]))
    x = np.array([evidence(n, [(0, 0, s) for s in scores], model) for n, scores, _ in checked])
    y = np.array([label for _, _, label in checked])
    model["curve"] = fit_curve(x, y) if len(x) else (math.log(toxic.sum() / clean.sum()), 0.0)
    return model


def score(docs: DataFrame, model: dict, with_passages: bool = False) -> DataFrame:
    """doc_id, score, predicted, n_passages (and the passages by word numbers) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the corpus
    schema = "doc_id long, score double, predicted int, n_passages int"
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    if with_passages:
        schema += ", passages array<struct<first_word: long, end_word: long, score: double, e_value: double>>"
        kinds.append(pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])))
    names = ["doc_id", "score", "predicted", "n_passages", "passages"][: len(kinds)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = Weights(own["table"])
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row: tuple = (doc_id, 0.0, 0, 0, [])
                if own["curve"]:
                    n, found = text_segments(text.as_py(), weights, own["drift"])
                    p = probability(evidence(n, found, own), own)
                    rows = [(a, b, s, e) for a, b, s in found if (e := e_value(s, n, own)) <= SIGNIFICANT]
                    row = (doc_id, p, int(p >= PREDICT_AT), len(rows), [{"first_word": a, "end_word": b, "score": s, "e_value": e} for a, b, s, e in rows])
                for column, x in zip(out, row, strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
