"""Lexical search, hard negatives and the language model against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import hard_negatives as hn
from veriframe.llm import lexical_search as ls
from veriframe.llm import maxent_lm as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- hard negatives ---------------------------------------------------------------------------------------------


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (17, 33, 65), (64, 64, 64), (130, 7, 51), (0, 5, 3), (40, 64, 200)):
        a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert (hn.strassen(a, b, 4) == a @ b).all()  # both wrap modulo 2**64


def test_window_bounds():
    for p in [*range(-300, 301), 2**62 - 7, -(2**62)]:
        low, high = (int(x) for x in hn.window_of(np.array(p), 50, 95))
        assert 50 * p <= 100 * low and 50 * p > 100 * (low - 1) and 100 * high <= 95 * p and 100 * (high + 1) > 95 * p


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 9, (6, 90)), rng.permutation(90)
    allowed = rng.random((6, 90)) < 0.5
    want = [sorted(((-scores[r, c], ids[c]) for c in range(90) if allowed[r, c]))[:5] for r in range(6)]
    for size in (7, 90):
        heaps = hn.Heaps(6, 5)
        for a in range(0, 90, size):
            heaps.push(0, scores[:3, a : a + size], allowed[:3, a : a + size], ids[a : a + size])
            heaps.push(3, scores[3:, a : a + size], allowed[3:, a : a + size], ids[a : a + size])
        assert [[(-s, i) for o, s, i in zip(*heaps.entries(), strict=True) if o == r] for r in range(6)] == want


def _mined(rows, n_positive=5, n_negative=3):
    out = []
    for anchor in {r[0]: r for r in sorted((r for r in rows if r[0] % 5 == 0), key=lambda r: (r[0], r[1], r[2]), reverse=True)}.values():
        dot = lambda r: sum(x * y for x, y in zip(anchor[2], r[2], strict=False))  # noqa: B023, E731
        others = sorted((-dot(r), r[0], r[1]) for r in rows if r[0] != anchor[0])
        for p in [o for o in others if o[2] == anchor[1]][:n_positive]:
            fits = [o for o in others if o[2] != anchor[1] and -50 * p[0] <= -100 * o[0] <= -95 * p[0]][:n_negative]
            out += [(anchor[0], p[1], k + 1, o[1], -p[0], -o[0]) for k, o in enumerate(fits)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0], rng.integers(4, 7)).tolist(), int(rng.integers(0, 3))) for i in range(160)]
    vectors += [vectors[3], vectors[3], (7, vectors[8][1], 1), (40, [1.0, 1.0], 2)]  # repeated rows, equal ids
    odd = [(1000, None, 1), (1005, [1.0, None], 1), (1010, [float("nan")], 1), (1015, [float("inf")], 2), (1020, [1.0], None), (None, [1.0], 1), (1025, [], 0)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors + odd], "vec_id long, embedding array<float>, label int, score int, a_block string")
    rows = hn.valid_rows(df.repartition(3))
    flat = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in [*vectors, (1025, [], 0)]]
    got = sorted(tuple(r) for r in hn.mine(rows, F.col("vec_id") % 5 == 0).collect())
    assert got == _mined(flat) and len(got) > 50
    monkeypatch.setattr(hn, "ANCHORS", 7)  # several anchor blocks, joined by exchange, closed early
    monkeypatch.setattr(hn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(hn, "OPEN", 1)
    monkeypatch.setattr(hn, "ROWS", 32)
    assert sorted(tuple(r) for r in hn.mine(rows, F.col("vec_id") % 5 == 0).collect()) == got
    assert hn.mine(hn.valid_rows(df.filter("vec_id > 5000")), F.col("vec_id") % 5 == 0).count() == 0


# ---- lexical search ---------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _searched(docs, items, k):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    named = {}
    for i, t in items:
        named.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in named.items():
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_search_equals_a_full_scan(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("the", "Ära", "x9", "né") for b in range(30)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "... !!"), (None, words[0] * 2 + " " + words[5]), (5, docs[5][1]), (303, docs[9][1]), (304, "word " * 30_000 + words[3]), (305, words[3].upper() + "_" + words[4] + "\x00" + words[3])]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(20)] + [(20, None), (21, "unknown"), (3, words[7]), (None, words[1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, n int").repartition(3)
    q = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    monkeypatch.setattr(ls, "DOCS", 64)  # several shards
    monkeypatch.setattr(ls, "BLOCK", 4)
    want = _searched(docs, items, 10)
    assert sorted((tuple(r) for r in ls.search(d, q, 10).collect()), key=str) == want and len(want) > 150
    monkeypatch.setattr(ls, "ITEMS", 7)  # several passes
    assert sorted((tuple(r) for r in ls.search(d, q, 10).collect()), key=str) == want
    assert ls.search(d.filter("false"), q).count() == 0 and ls.search(d, q.filter("false")).count() == 0


def test_blocks_are_skipped_only_below_the_floor():
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 6, 600)
    matrix = (rng.random((600, 60)) < np.where(topic[:, None] == np.arange(60) // 10, 0.5, 0.05)) * rng.integers(1, 1000, (600, 60))
    weight = rng.integers(1, 9000, 60)
    query = np.arange(10, 18)
    shard = ls.Shard(np.arange(600), matrix.astype(np.int32), weight, [query if t in query else np.array([t]) for t in range(60)], 16)
    scores = shard.scores(np.arange(600), query)
    places = [np.searchsorted(query, query) for _ in query]
    for t in query:
        held, first, summary = shard.blocks(int(t))
        assert sorted(held) == np.flatnonzero(matrix[:, t]).tolist()
        for block, most in zip(np.split(held, first[1:]), summary, strict=True):
            assert (most == matrix[np.ix_(block, query)].max(axis=0)).all()
    for floor in np.sort(scores)[[-1, -10, -50, 0]]:
        seen = [0, 0]
        found = shard.reachable(query, places, max(1, int(floor)), seen)
        assert set(np.flatnonzero(scores >= max(1, floor))) <= set(found)
        assert seen[1] > 0 or floor < np.sort(scores)[-50]
    assert len(shard.reachable(query, places, int(np.sort(scores)[-10]), [0, 0])) < 300


# ---- language model ---------------------------------------------------------------------------------------------


def _trained(spark, docs):
    return lm.train(spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, n_tokens int, word string").repartition(2))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)
    tongues = [[f"{a}{k}" for k in range(200)] for a in ("aa", "bé", "Cc")]
    docs = []
    for i in range(400):
        own = tongues[i % 3]
        docs.append((i, " ".join(own[min(199, int(rng.zipf(1.5)) - 1)] for _ in range(rng.integers(1, 80)))))
    return docs + [(400, None), (401, ""), (402, " \n\t"), (None, "aa1 new"), (5, docs[5][1]), (403, "rare" + "x" * 100 + " aa1")]


def test_language_model(spark, corpus):
    encoded, counts, model = _trained(spark, corpus)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r) for r in lm.score(encoded, counts, model).collect()), key=lambda r: r[:2])
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"] for i, t in corpus}
    learned = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i in tokens}
    c = Counter(w for i, _ in corpus if learned[i] for w in tokens[i])
    n, v = c.total(), len(c)
    assert len(got) == len(corpus)
    for _, _, r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learned[r.doc_id], len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
    unseen = [r for _, _, r in got if r.held_out]
    assert sum(r.score for r in unseen) > 0.9 * sum(r.base_score for r in unseen)  # logarithms: clearly better
    # after every history the probabilities of all words and the unknown one sum to one
    known = np.arange(len(model.words), dtype=np.int32)
    for one, two in ((lm.START, lm.START), (0, lm.START), (5, -77), (-3, 9)):
        logs = lm.token_logs(model, np.append(known, np.int32(-1)), np.full(len(known) + 1, one, dtype=np.int32), np.full(len(known) + 1, two, dtype=np.int32))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_a_step_follows_the_gradient():
    """The mean of sampled steps is the exact gradient of the likelihood."""
    rng = np.random.default_rng(7)
    logits = rng.standard_normal(5)
    logs = (logits - np.log(np.exp(logits).sum())).astype(np.float32)
    n = 40_000
    learner = lm._Learner(np.zeros((3, 5), dtype=np.float32))
    learner.met[:] = 10**12  # steps of one size
    learner.step(np.full((n, 1), 1), np.tile(logs, (n, 1)), np.full(n, 2), rng.random(n, dtype=np.float32))
    moved = learner.weights[1] / (lm.RATE / 10**6) / n
    assert moved == pytest.approx(np.eye(5)[2] - np.exp(logs), abs=0.01) and not learner.weights[[0, 2]].any()


def test_alike_words_share_a_part():
    counts = np.zeros((40, 6), dtype=np.int64)
    for k in range(40):
        counts[k, k % 4] = 50 + k
    part = lm.split_alike(counts, np.ones(40), 4)
    assert [len(set(part[k::4])) for k in range(4)] == [1] * 4 and len(set(part)) == 4


def test_language_model_without_text(spark):
    encoded, counts, model = _trained(spark, [(1, "a b")][:0])
    assert lm.score(encoded, counts, model).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    encoded, counts, model = _trained(spark, [(held, "a b")])
    r = lm.score(encoded, counts, model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(0)
