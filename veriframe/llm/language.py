"""Language identification of whole, possibly mixed texts.

Each word gets a score for every learned language (hashed character n-gram log-likelihoods, smoothed). The
scripts of the word's letters, read off Unicode ranges, narrow the candidates to languages that use one of them in training. A
Viterbi pass over the words with a fixed penalty for a switch then labels spans; the text's language is the one
whose spans hold the most letters.

Defined cases: null texts and texts without a letter are ``und`` with score 0; words without letters carry no
evidence and join the span around them; if nothing can be learned every text is ``und``; documents of any length
are read whole; repeated rows are scored alike; other columns are ignored; of equally likely languages the first in
their order is taken; an empty table gives an empty table. Training may read a bounded,
hash-chosen sample of the labelled rows (``max_train_docs``, an expected number).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriframe.llm.common import hash_below, held_out, quote, tidy

BUCKETS = 1 << 16
MAX_TRAIN_DOCS = 20_000
SWITCH_PENALTY = 12.0
#: A single word's evidence between two languages is limited to this, so that one odd word makes no span.
WORD_LIMIT = 4.0
CACHE_ENTRIES = 200_000

#: Unicode ranges of scripts (start, end, name).
SCRIPT_RANGES = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)


def letters_of(token: str) -> str:
    """The token's letters in lower case, white space where other characters stand between letters."""
    if token.isalpha():
        return token.lower()
    return " ".join("".join(c if c.isalpha() else " " for c in token.lower()).split())


@lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> str:
    point = ord(letter)
    for low, high, name in SCRIPT_RANGES:
        if low <= point <= high:
            return name
    return "other"


def scripts_of(word: str) -> set[str]:
    """The scripts of all letters of a normalised word."""
    if word.isascii():
        return {"latin"} if word else set()
    return {script_of(c) for c in word if c != " "}


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the 1- to 4-grams of all words (edges marked by a space) and each word's first position
    in that array; grams that would cross into the next word are folded onto a word's own unigrams."""
    joined = " " + " ".join(words) + "    "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    n = int(starts[-1]) + len(words[-1]) + 1
    own = np.repeat(np.arange(len(words)), np.diff(np.append(starts, n)))
    end = np.append(starts[1:], n)[own] + 1  # one past the closing space
    at = np.arange(n)
    out = np.empty((n, 4), dtype=np.uint32)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(4):
        step = value * np.uint64(0x100000001B3) + points[at + k] + np.uint64(1 + k)
        value = np.where(at + k < end, step, value)
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (mixed >> np.uint64(40)) % np.uint64(BUCKETS)
    return out.reshape(-1), starts * 4


def train(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Counts of hashed n-grams a language, from labelled rows that are not held out. The model is a
    ``BUCKETS x languages`` table."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    total = labelled.count()
    chosen = labelled.filter(hash_below(F.col("doc_id"), max_train_docs / max(total, 1))).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [w for t in text.as_py().split() for w in letters_of(t).split()]
                if not words:
                    continue
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(gram_hashes(words)[0], minlength=BUCKETS)
                for w in words:
                    for name in scripts_of(w):
                        scripts[lang, name] = scripts.get((lang, name), 0) + 1
        rows = [(lang, "", int(b), int(own[b])) for lang, own in sums.items() for b in np.flatnonzero(own)]
        rows += [(lang, s, -1, n) for (lang, s), n in scripts.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "script", "bucket", "n"])

    counted = chosen.mapInArrow(tidy(count), "lang string, script string, bucket long, n long")
    # at most BUCKETS rows a language: bounded by the hash table, not by the corpus
    got = counted.groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((BUCKETS, len(langs)), dtype=np.float64)
    scripts: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        table[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        used = own[own["bucket"] < 0]
        for script, n in zip(used["script"], used["n"], strict=True):
            if n >= 0.001 * used["n"].sum():
                scripts.setdefault(script, []).append(k)
    log = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)) if langs else table
    return {"langs": langs, "log": log.astype(np.float32), "scripts": scripts}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """One row for each normalised word: evidence of each language against the best, at least -WORD_LIMIT, and 0
    for all where there is none."""
    out = np.zeros((len(words), len(model["langs"])))
    full = [i for i, w in enumerate(words) if w]
    if full and model["langs"]:
        grams, starts = gram_hashes([words[i] for i in full])
        sums = np.add.reduceat(model["log"][grams].astype(np.float64), starts, axis=0)
        lengths = np.diff(np.append(starts, len(grams)))[:, None]
        sums *= np.minimum(1.0, 12.0 / lengths)  # overlapping n-grams repeat each other's evidence
        for row, i in enumerate(full):
            # a word of several scripts may be of any language that uses one of them
            used = scripts_of(words[i])
            allowed = model["scripts"].get(next(iter(used))) if len(used) == 1 else sorted({k for name in used for k in model["scripts"].get(name, ())})
            if not allowed:
                sums[row] = 0.0
            elif len(allowed) < sums.shape[1]:
                barred = np.ones(sums.shape[1], dtype=bool)
                barred[allowed] = False
                sums[row, barred] = -1e9
        out[full] = np.maximum(sums - sums.max(axis=1, keepdims=True), -WORD_LIMIT)
    return out


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word; a change of label costs ``penalty``; ties go to the earlier language and to staying."""
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int16)
    state = scores[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(state.argmax())
        jump = state[top] - penalty > state
        back[i] = np.where(jump, top, own)
        state = np.where(jump, state[top] - penalty, state) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(state.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class WordTable:
    """A worker's cache of word scores: a raw token's row number in growing tables."""

    def __init__(self, model: dict):
        self.model, self.rows = model, {}
        self.scores = np.zeros((1024, len(model["langs"])))
        self.letters = np.zeros(1024, dtype=np.int64)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_ENTRIES:
            self.rows = {}
        new = list(dict.fromkeys(t for t in tokens if t not in self.rows))
        if new:
            words = [letters_of(t) for t in new]
            first = len(self.rows)
            while first + len(new) > len(self.letters):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.scores[first : first + len(new)] = word_scores(words, self.model)
            self.letters[first : first + len(new)] = [len(w) - w.count(" ") for w in words]
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def label_words(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Viterbi labels; the pass itself is skipped where no other path can be better: a path with the best single
    language in it pays a penalty for each span of another, so none of these may gain more; one without it has a
    switch at least and no more than the others' best scores."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    others = np.delete(scores, best, axis=1)
    if (gain - low).max() <= penalty and (not others.size or others.max(axis=1).sum() - total[best] <= penalty):
        return np.full(len(scores), best, dtype=np.int64)
    return viterbi(scores, penalty)


def _spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(path)) + 1
    bounds = [0, *edges.tolist(), len(path)]
    return [(a, b, int(path[a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def identify(docs: DataFrame, model: dict, penalty: float = SWITCH_PENALTY, with_spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, n_spans (and the spans by word numbers, if asked for) of every document; columns
    in ``keep`` come along as ``_keep_0``, ``_keep_1``, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, whatever the corpus
    schema = "doc_id long, lang_pred string, score double, n_spans int"
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32()]
    if with_spans:
        schema += ", spans array<struct<first_word: long, end_word: long, lang: string>>"
        kinds.append(pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())])))
    names = ["doc_id", "lang_pred", "score", "n_spans", "spans"][: len(kinds)]
    chosen = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(quote(c)).alias(f"_keep_{k}") for k, c in enumerate(keep)])
    fields = StructType.fromDDL(schema)
    for k, c in enumerate(keep):
        fields.add(f"_keep_{k}", docs.schema[c].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(shared.value)
        langs = shared.value["langs"]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = (value.as_py() or "").split()
                ids = words.ids(tokens) if tokens and langs else np.zeros(0, dtype=np.int64)
                letters = words.letters[ids]
                row: tuple = (doc_id, "und", 0.0, 0, [])
                if letters.sum() > 0:
                    scores = words.scores[ids]
                    path = label_words(scores, penalty)
                    spans = _spans(path)
                    held = np.bincount(path, weights=letters, minlength=len(langs))
                    top = int(held.argmax())
                    mine = scores[path == top].sum(axis=0) * 0.5
                    odds = np.exp(np.clip(mine - mine[top], -700, 0))
                    share = held[top] / held.sum()
                    row = (doc_id, langs[top], float(share / odds.sum()), len(spans), [{"first_word": a, "end_word": b, "lang": langs[k]} for a, b, k in spans])
                for column, x in zip(out, row, strict=False):
                    column.append(x)
            made = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *[batch.column(2 + k) for k in range(len(keep))]], names=[*names, *[f"_keep_{k}" for k in range(len(keep))]])

    return chosen.mapInArrow(tidy(run), fields)
