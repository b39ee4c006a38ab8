"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the text's words (A-Z lower-cased) and one end. A token's probability is that of its class given the history,
times that of the token in its class. Classes: the most frequent words in classes of equal size, further frequent words
in classes of about equal weight, and one class for all other words and the unknown one. Words share a class that occur
between the same common words (bisection along principal axes of neighbour counts from the whole training text). The
class, and in the first kind of class also the word, has a softmax over weights of hashed features of the history: the
last word, a skip over it, both words, and both words' classes. In the other classes words have their smoothed share.
All weights start at 0 with biases at the smoothed shares, so the untrained model is the smoothed unigram.

Training goes over every training token once. Documents are dealt into rounds by hash; in a round each task takes
gradient steps (Adagrad) on its documents from the shared model, and rows of weights are averaged over the tasks, each
by how often it met the row. Counts are exact and cover all training tokens. The most frequent words (a bounded table)
are known in every task; the other words of each document are joined with the table of counts by exchange.

Defined cases. A null or empty text is one end. Documents whose crc32 of the id (null: '') is 0 modulo 10 are never
learned from. Rows of equal id are scored one by one. Without training text every token has probability 1 in both
scores, as the unknown word is all there is. Texts are read whole, further columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import cut_table, parts_of, tidy
from veriframe.llm.rolling import mixed, text_bytes
from veriframe.llm.words import WORD_BYTES, split_words

#: Known words at most, and bytes of one; classes of head words and words in each; classes of body words (both powers of
#: two); neighbours that describe a head word; rows of a weight table.
KNOWN, KNOWN_BYTES, HEADS, SLOTS, BODIES, HUBS, BUCKETS = 65_536, 64, 16, 32, 16, 128, 1 << 15
#: Rounds of training, tokens of a task's first and of its later steps, learning rate, tokens of a task and tasks of a round at most, rows of a block.
ROUNDS, FIRST_STEP, STEP, RATE, TASK_TOKENS, TASKS, BLOCK_ROWS = 3, 128, 8_192, 0.3, 2_000_000, 1_024, 256
CLASSES = HEADS + BODIES + 1
END, START, NEVER = b"\n", KNOWN, np.float32(-1e30)
SMOOTH = 0.1
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def learned_from(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def _tokens(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Words and ends of every text in order, and each one's text."""
    words, of = split_words(texts, WORD_BYTES)
    both = pa.concat_arrays([words, pa.array([END] * len(texts), pa.large_binary())])
    order = np.argsort(np.concatenate([of, np.arange(len(texts))]), kind="stable")
    return both.take(pa.array(order)), np.concatenate([of, np.arange(len(texts))])[order]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of ``docs`` (text), summed in each task as far as memory of fixed size allows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for part in parts_of(batches, 0):
            n = pc.value_counts(_tokens(part.column(0))[0])
            held.append(pa.table({"word": n.field(0), "c": n.field(1)}))
            rows += len(n)
            if rows > 400_000:
                held = [pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])]
                rows = held[0].num_rows
                if rows > 200_000:
                    yield from _counted(held[0])
                    held, rows = [], 0
        if held:
            yield from _counted(pa.concat_tables(held))

    return docs.select("text").mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(rows.cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).to_batches(max_chunksize=50_000))


@dataclass
class Model:
    """What a task needs to know: the known words with their counts, classes and slots, and the weights."""

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    kind: np.ndarray  # class of each known word, then of the start
    slot: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    share: np.ndarray  # log of a body word's share of its class
    rest: float  # smoothed count of the last class
    class_weights: np.ndarray
    slot_weights: np.ndarray
    class_met: np.ndarray  # how often a task met each row so far
    slot_met: np.ndarray


def _encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(uid, doc_id, learned, n_tokens, codes, rest): a known token's number or a negative hash, as 32-bit integers, and
    the other words with their number in the document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_binary())
        for part in parts_of(batches, 3):
            tokens, of = _tokens(part.column(3))
            n = np.bincount(of, minlength=part.num_rows)
            number = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            other = np.flatnonzero(number < 0)
            coded = tokens.take(pa.array(other)).dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            number[other] = -1 - _word_hash(coded.dictionary)[index] if len(other) else number[other]
            key, count = np.unique(of[other] * max(1, len(coded.dictionary)) + index, return_counts=True)
            row = key // max(1, len(coded.dictionary))
            ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            rest = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % max(1, len(coded.dictionary)))).cast(pa.binary()), pa.array(count.astype(np.int64))], ["word", "n"])
            codes = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.append(0, 4 * np.cumsum(n)).astype(np.int32)), pa.py_buffer(number)])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), codes, pa.ListArray.from_arrays(ends, rest)], ["uid", "doc_id", "learned", "n_tokens", "codes", "rest"])

    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), learned_from(F.col("doc_id")).alias("learned"), "text")
    return own.mapInArrow(tidy(run), "uid long, doc_id long, learned boolean, n_tokens long, codes binary, rest array<struct<word: binary, n: long>>")


def _word_hash(words: pa.Array) -> np.ndarray:
    """30-bit hashes of a dictionary's words, for features only."""
    if not len(words):
        return np.zeros(0, dtype=np.int32)
    raw, ends = text_bytes(words)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], np.diff(ends))
    value = mixed(raw.astype(np.uint64) * _SALTS[0] + place.astype(np.uint64) * _SALTS[1])
    return (mixed(np.add.reduceat(value, ends[:-1])) & np.uint64(0x3FFFFFFF)).astype(np.int32)


def _stream(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch: it, its tokens' codes, the two codes before each (START before the text), and its document."""
    for batch in batches:
        lists = batch.column(column)
        n = pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        codes = np.frombuffer(b"".join(lists.to_pylist()), dtype=np.int32)
        first = np.cumsum(n) - n
        one, two = np.append(np.int32(START), codes[:-1]), np.append(np.full(2, START, dtype=np.int32), codes[:-2])[: len(codes)]
        one[first], two[first] = START, START
        second = first[n > 1] + 1
        two[second] = START
        yield batch, codes, one, two, np.repeat(np.arange(batch.num_rows), n)


def _pair_counts(encoded: DataFrame, label: np.ndarray, width: int) -> np.ndarray:
    """How often each known word stands next after and next before each label (-1: none) of known words."""
    size = len(label)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * 2 * width, dtype=np.int64)
        named = np.append(label, -1)  # the start and all other words have none
        for _, codes, one, _, _ in _stream(batches, 0):
            word, before = (np.where((x < 0) | (x >= size), size, x) for x in (codes, one))
            for a, b, side in ((word, before, 0), (before, word, 1)):
                good = np.flatnonzero((a < size) & (named[b] >= 0))
                total += np.bincount((a[good] * 2 + side) * width + named[b[good]], minlength=len(total))
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"cell": at[a : a + 100_000], "n": total[at[a : a + 100_000]]})

    out = np.zeros(size * 2 * width, dtype=np.int64)
    learned = encoded.filter("learned").select("codes").coalesce(TASKS)
    got = learned.mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most size * 2 * width rows
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, 2 * width)


def split_alike(counts: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """A part (0 to ``parts`` - 1) for each row: halves of about equal weight along the first principal axis of the rows'
    log-ratios to independence, again and again."""
    part = np.zeros(len(counts), dtype=np.int64)
    total = max(1, counts.sum())
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0, keepdims=True) / total
    ratio = np.log((counts + 1) / (expected + 1))
    step = parts
    while step > 1:
        step //= 2
        for p in range(0, parts, 2 * step):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            centred = ratio[own] - np.average(ratio[own], axis=0, weights=weight[own])
            axis = np.linalg.eigh((centred * weight[own, None]).T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ axis, kind="stable")]
            mass = np.cumsum(weight[order])
            half = int(np.clip(np.searchsorted(mass, mass[-1] / 2) + 1, 1, len(order) - 1))
            part[order[half:]] = p + step
    return part


def _untrained(encoded: DataFrame, words: list[bytes], counts: np.ndarray, n: int, v: int) -> Model:
    head = min(len(words), HEADS * SLOTS)
    kind = np.full(KNOWN + 1, CLASSES - 1, dtype=np.int64)
    kind[START] = CLASSES
    slot = np.zeros(KNOWN + 1, dtype=np.int64)
    smooth = counts + SMOOTH
    if head:
        near = _pair_counts(encoded, np.where(np.arange(head) < HUBS, np.arange(head), -1), HUBS)
        kind[:head] = split_alike(near, np.ones(head), HEADS)
        for c in range(HEADS):
            own = np.flatnonzero(kind[:head] == c)
            slot[own] = np.arange(len(own))
    if len(words) > head:
        label = np.where(np.arange(len(words)) < head, kind[: len(words)], -1)
        near = _pair_counts(encoded, label, HEADS)[head:]
        kind[head : len(words)] = HEADS + split_alike(near, smooth[head:], BODIES)
    mass = np.bincount(kind[: len(words)], weights=smooth, minlength=CLASSES).astype(float)
    mass[-1] = rest = (n - counts.sum()) + SMOOTH * (v - len(words) + 1)
    with np.errstate(divide="ignore"):
        class_bias = np.maximum(np.log(mass / mass.sum()), float(NEVER)).astype(np.float32)
    slot_bias = np.full((HEADS, SLOTS), NEVER, dtype=np.float32)
    slot_bias[kind[:head], slot[:head]] = np.log(smooth[:head])
    share = np.zeros(KNOWN + 1)
    share[: len(words)] = np.log(smooth / mass[kind[: len(words)]])
    return Model(words, counts, n, v, kind, slot, class_bias, slot_bias, share, float(rest), np.zeros((BUCKETS, CLASSES), dtype=np.float32), np.zeros((BUCKETS, SLOTS), dtype=np.float32), np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64))


def _features(model: Model, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the four features of every place, and the rows of class weights."""
    a, b = one.astype(np.int64).view(np.uint64), two.astype(np.int64).view(np.uint64)
    pair = (_kind_of(model, one) * (CLASSES + 1) + _kind_of(model, two)).view(np.uint64)
    keys = np.stack([a, b, mixed(a * _SALTS[0]) + b, pair], axis=1)
    hashed = mixed(keys * _SALTS + _SALTS[::-1])
    return hashed, (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)


def _kind_of(model: Model, codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 0, CLASSES - 1, model.kind[np.maximum(codes, 0)])


def _class_logits(model: Model, rows: np.ndarray) -> np.ndarray:
    return _summed(model.class_weights, rows, model.class_bias)


def _summed(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    total = np.take(weights, rows[:, 0], axis=0)
    total += bias
    for k in range(1, rows.shape[1]):
        total += np.take(weights, rows[:, k], axis=0)
    return total


def _slot_logits(model: Model, hashed: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = (mixed(hashed + (kind[:, None] + 1).astype(np.uint64) * _SALTS[2]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return rows, _summed(model.slot_weights, rows, model.slot_bias[kind])


def _log_of(logits: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """The log-softmax of one outcome of each row; ``logits`` are used up."""
    most = logits.max(axis=1)
    own = logits[np.arange(len(outcome)), outcome] - most
    logits -= most[:, None]
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


class _Learner:
    """Gradient steps on one table of weights; ``met`` counts how often each row was met, and a row's steps shrink with
    the root of that and of ``before``, how often it was met in earlier rounds."""

    def __init__(self, weights: np.ndarray, before: np.ndarray | int = 0):
        self.weights, self.met, self.before = weights, np.zeros(len(weights), dtype=np.int64), np.zeros(len(weights), dtype=np.int64) + before

    def step(self, rows: np.ndarray, logits: np.ndarray, true: np.ndarray, draw: np.ndarray) -> None:
        """Ascend the likelihood of ``true`` outcomes under ``logits``, which are used up. The expected part of the
        gradient is taken at one outcome drawn from the model (``draw`` is uniform), so a step's mean is the exact gradient."""
        width = self.weights.shape[1]
        np.minimum(logits, 80, out=logits)  # far above what weights reach; sums stay finite without a search for the largest
        below = np.cumsum(np.exp(logits, out=logits), axis=1, out=logits)
        drawn = (below >= draw[:, None] * below[:, -1:]).argmax(axis=1)
        wrong = np.flatnonzero(drawn != true)  # elsewhere both parts cancel
        self.met += np.bincount(rows.ravel(), minlength=len(self.met))
        own = rows[wrong].ravel()
        size = (RATE / np.sqrt(self.met[own] + self.before[own])).astype(np.float32)
        flat, k = self.weights.reshape(-1), rows.shape[1]
        np.add.at(flat, own * width + np.repeat(true[wrong], k), size)  # one-dimensional: many times faster
        np.add.at(flat, own * width + np.repeat(drawn[wrong], k), -size)

    def blocks(self, name: str) -> Iterator[dict]:
        for a in range(0, len(self.met), BLOCK_ROWS):
            met = self.met[a : a + BLOCK_ROWS]
            if met.any():
                yield {"name": name, "block": a // BLOCK_ROWS, "met": met.tobytes(), "weights": self.weights[a : a + BLOCK_ROWS].tobytes()}


def learn(model: Model, codes: np.ndarray, one: np.ndarray, two: np.ndarray, classes: _Learner, slots: _Learner, draws: np.random.Generator) -> None:
    """One gradient step on these tokens; the learners hold the model's own tables."""
    hashed, rows = _features(model, one, two)
    kind = _kind_of(model, codes)
    classes.step(rows, _class_logits(model, rows), kind, draws.random(len(codes), dtype=np.float32))
    head = np.flatnonzero(kind < HEADS)
    if len(head):
        rows, logits = _slot_logits(model, hashed[head], kind[head])
        slots.step(rows, logits, model.slot[codes[head]], draws.random(len(head), dtype=np.float32))


def _round(encoded: DataFrame, model: Model, number: int, tasks: int) -> None:
    """One round of training: ``model`` gets the tasks' averaged weights."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own = Model(**{**own.__dict__, "class_weights": own.class_weights.copy(), "slot_weights": own.slot_weights.copy()})
        classes, slots, draws = _Learner(own.class_weights, own.class_met), _Learner(own.slot_weights, own.slot_met), np.random.default_rng(number)
        seen = 0
        for _, codes, one, two, _ in _stream(batches, 0):
            a = 0
            while a < len(codes):
                at = slice(a, a + min(STEP, FIRST_STEP + seen // 8))  # steps grow as the weights settle
                learn(own, codes[at], one[at], two[at], classes, slots, draws)
                seen += len(codes[at])
                a = at.stop
        for name, learner in (("class", classes), ("slot", slots)):
            for block in learner.blocks(name):
                yield pa.RecordBatch.from_pylist([block])

    def average(rows: pa.Table) -> pa.Table:
        width = CLASSES if rows["name"][0].as_py() == "class" else SLOTS
        # in an order of their own, so that sums do not depend on the order of arrival
        parts = sorted((bytes(r["met"]), bytes(r["weights"])) for r in rows.to_pylist())
        met = [np.frombuffer(m, dtype=np.int64) for m, _ in parts]
        total = sum(m[:, None] * np.frombuffer(w, dtype=np.float32).reshape(-1, width).astype(float) for m, (_, w) in zip(met, parts, strict=True))
        met = sum(met)
        return pa.table({"name": rows["name"][:1], "block": rows["block"][:1], "met": [met.tobytes()], "weights": [(total / np.maximum(met, 1)[:, None]).astype(np.float32).tobytes()]})

    schema = "name string, block long, met binary, weights binary"
    docs = encoded.filter(F.col("learned") & (F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == number)).select("codes").coalesce(tasks)
    # the blocks of one model, whatever the input's size
    for r in docs.mapInArrow(tidy(run), schema).groupBy("name", "block").applyInArrow(average, schema).collect():
        table, before = (model.class_weights, model.class_met) if r.name == "class" else (model.slot_weights, model.slot_met)
        met = np.frombuffer(r.met, dtype=np.int64)
        own = np.flatnonzero(met)
        at = r.block * BLOCK_ROWS + own
        table[at] = np.frombuffer(r.weights, dtype=np.float32).reshape(len(met), -1)[own]
        before[at] += -(-met[own] // tasks)
    shared.unpersist()


def token_logs(model: Model, codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural logarithms of each token's probability; of a word in the last class, only the class's."""
    hashed, rows = _features(model, one, two)
    kind = _kind_of(model, codes)
    out = _log_of(_class_logits(model, rows), kind).astype(float)
    body = (kind >= HEADS) & (kind < CLASSES - 1)
    out[body] += model.share[codes[body]]
    head = np.flatnonzero(kind < HEADS)
    if len(head):
        out[head] += _log_of(_slot_logits(model, hashed[head], kind[head])[1], model.slot[codes[head]])
    return out


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model]:
    """(encoded documents, word counts, model) of ``docs`` (doc_id, text)."""
    counts = cut_table(word_counts(docs.filter(learned_from(F.col("doc_id")))))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.filter(F.length("word") <= KNOWN_BYTES).orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()  # a bounded table
    words = top["word"].to_pylist()
    encoded = cut_table(_encoded(docs, words))
    model = _untrained(encoded, words, top["c"].to_numpy(), total.n, total.v)
    for number in range(ROUNDS if words else 0):
        _round(encoded, model, number, int(min(TASKS, max(1, math.ceil(total.n / ROUNDS / TASK_TOKENS)))))
    return encoded, counts, model


def score(encoded: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every encoded document."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    base_total = math.log10(model.n + SMOOTH * (model.v + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        unigram = np.append(np.log10(own.counts + SMOOTH) - base_total, np.zeros(KNOWN + 1 - len(own.counts)))
        for batch, codes, one, two, of in _stream(batches, 4):
            logs = np.concatenate([token_logs(own, codes[a : a + STEP], one[a : a + STEP], two[a : a + STEP]) for a in range(0, len(codes), STEP)])
            known = codes >= 0
            sums = [np.bincount(of, weights=x, minlength=batch.num_rows) for x in (known, np.where(known, unigram[np.maximum(codes, 0)], 0), logs / math.log(10))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["uid", "doc_id", "learned", "n_tokens", "known", "base", "model"])

    kind = "uid long, doc_id long, learned boolean, n_tokens long, known long, base double, model double"
    own = encoded.select("uid", "doc_id", "learned", "n_tokens", "codes").mapInArrow(tidy(run), kind)
    rest = encoded.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rest.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("r_known"), F.sum(F.col("n") * (F.log10(c + SMOOTH) - base_total)).alias("r_base"),
        F.sum(F.col("n") * (F.log10(c + SMOOTH) - math.log10(model.rest))).alias("r_model"),
    )
    both = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return own.join(rest, "uid", "left").select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", both("known", "r_known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        both("base", "r_base").alias("base_score"), both("model", "r_model").alias("score"),
    )
