"""Brute-force, round-trip and held-out tests of the text operators."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import common, components, fingerprints, language, mixing, near_duplicates, ordinal_quality, packing, pages, quality_rules, repeats, rolling, toxicity

ODD = [None, "", " ", "\u00a0\u2003", "\u00a0\u2003", "x", "ab\n\nc  d", "né à 日本", "\ttab", "a b c d e f", "a b c d e f", "word " * 3000]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("length", "part", "uid", "node", "score", "copies", "_uid", "_copies", "_copy", "_keep_text", "a.b", "x`y", "root", "band", "spans", "TEXT_"):
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


# ---- op1

def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 60))) for _ in range(57)] + ODD
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(frame(spark, texts, extra=True).repartition(5)).collect()}
    n = len(texts)
    simhash = fingerprints.Simhasher()
    for i, text in enumerate(texts):
        a, b = text or "", texts[(i - 1) % n] or ""
        changed = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[i]
        assert r.n_chars == len(a)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (simhash(a).hex(), simhash(changed).hex())
        assert r.near_next == pytest.approx(fingerprints.likeness(simhash(a), simhash(b)))


def test_votes_equal_brute_force(monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 7)
    rng = random.Random(4)
    word = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    spread = lambda x, salt: int(fingerprints._spread(np.array([x], dtype=np.uint64), salt)[0])
    for _ in range(20):
        words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))]
        if len(words) > 1:
            terms = [((spread(word(a), 1) + 3 * spread(word(b), 2)) % 2**64, len(a) + len(b)) for a, b in zip(words, words[1:], strict=False)]
        else:
            terms = [(word(w), len(w)) for w in words]
        bits = [0] * 128
        for term, weight in terms:
            raw = spread(term, 3).to_bytes(8, "little") + spread(term, 4).to_bytes(8, "little")
            for k in range(128):
                bits[k] += weight if raw[k // 8] >> (7 - k % 8) & 1 else -weight
        want = bytes(sum((bits[8 * j + k] > 0) << (7 - k) for k in range(8)) for j in range(16))
        assert fingerprints.Simhasher()(" ".join(words)) == want


def test_one_document_and_no_document(spark):
    one = fingerprints.fingerprint_with_edits(frame(spark, ["ab cd"])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert fingerprints.fingerprint_with_edits(frame(spark, [])).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = base + [b ^ sum(1 << rng.randrange(128) for _ in range(rng.randint(1, 5))) for b in base for _ in range(6)]
    hexes = [f"{v:032x}" for v in values]
    df = spark.createDataFrame([(h,) for h in hexes + hexes[:5]], "fingerprint string")
    queries = spark.createDataFrame([(h,) for h in hexes[::3]], "fingerprint string")
    for radius, blocks in ((3, 5), (fingerprints.RADIUS, fingerprints.BLOCKS), (0, 1)):
        got = [(r["query"], r["match"], r["distance"]) for r in fingerprints.within_radius(queries, df, radius, blocks).collect()]
        want = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values[::3] for b in values if a != b and (a ^ b).bit_count() <= radius}
        assert set(got) == want and len(got) == len(want) and (want or not radius)


def test_search_in_several_blocks(spark, monkeypatch):
    """Hot keys, several blocks of queries and batches, and few candidates at once give what all pairs give."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 2, (4, 128))
    bits = np.concatenate([centres[rng.integers(0, 4, 300)] ^ (rng.random((300, 128)) < 0.08), np.zeros((1, 128), dtype=int)])
    hexes = [np.packbits(b.astype(np.uint8)).tobytes().hex() for b in bits]
    for name, value in (("QUERIES", 40), ("PRINTS", 70), ("PAIRS", 50)):
        monkeypatch.setattr(fingerprints, name, value)
    df = spark.createDataFrame([(h,) for h in [*hexes, None]], "fingerprint string")
    got = {(r["query"], r["match"], r["distance"]) for r in fingerprints.within_radius(df.filter("substr(fingerprint, 1, 1) < '8'"), df, 20, 22).collect()}
    value = {h: int(h, 16) for h in hexes}
    want = {(a, b, (value[a] ^ value[b]).bit_count()) for a in value if a[0] < "8" for b in value if a != b and (value[a] ^ value[b]).bit_count() <= 20}
    assert got == want and len(want) > 1000
    assert fingerprints.within_radius(df.filter("false"), df).count() == 0


# ---- op2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="ad">Buy this thing now please it is good.</div>
<article><header><h1>The &amp; title</h1></header><p><b>First   para with enough words to be read.<br>Same block<p>Second para &eacute;&nbsp;x</p>
<aside>Side note that is long enough to look like a paragraph of text.</aside><div class="reader-comments"><p>I disagree with all of this text.</p></div></article>
<form><p>Name and mail please enter here</p></form><footer>&copy; all of us, in many words, here</footer>"""


def test_main_text():
    tree = pages.train()
    assert pages.main_text(PAGE, tree) == "The & title\n\nFirst para with enough words to be read. Same block\n\nSecond para é x"
    for broken in (None, "", "<", "<p", "text only, no markup at all here", "<p a='>", "</p></div>", "<script>x"):
        assert isinstance(pages.main_text(broken, tree), str)


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in pages.extract(df).collect())
    assert got[0][1] == got[0][2] and got[2] == (2, 0, 0)


def test_articles_of_the_table(spark):
    import html

    for r in pages.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(p for p in parts if p)


# ---- op3

def test_targets_and_copies(spark, docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
    open_, left, want = set(sizes), sum(sizes.values()), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weights[s] for s in open_}
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_odd_rows(spark):
    df = frame(spark, ODD + ODD[:2], extra=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", (ODD + ODD[:2])[r.doc_id] or "")) for r in rows)
    assert mixing.mix(frame(spark, [])).count() == 0
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    per = {r.doc_id: r.copies for r in rows}
    assert Counter(r.doc_id for r in out.collect()) == {k: v for k, v in per.items() if v}


def test_rates_are_tilted_by_newton_steps(spark, docs):
    prior = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)
    for q in (None, prior):
        rows = mixing.mix(docs, prior=q).join(docs.select("doc_id", "source"), "doc_id").collect()
        got, by = Counter(), {}
        for r in rows:
            got[r.source] += r.rate * r.size
            by.setdefault(r.source, []).append((r.size, r.rate, 1.0 if q is None else (2.0 if r.doc_id % 2 == 0 else 0.5)))
        for r in rows:
            assert got[r.source] == pytest.approx(r.target, rel=1e-6)
        for found in by.values():
            assert len({round(rate, 9) for _, rate, _ in found}) > 1
            # log(rate / prior) is one multiple of the size, but where the ceiling holds
            slopes = [np.log(rate / p) / size for size, rate, p in found if size and rate < 3 - 1e-9]
            assert max(slopes) - min(slopes) <= 1e-9 + 1e-6 * max(map(abs, slopes))
    base = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1.0).alias("prior"))
    steps = [r.steps for r in mixing.solve_dual(base, mixing.source_targets(base)).collect()]
    assert max(steps) >= 3, steps


def test_dual_equals_bisection(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 400) for _ in range(300)] + [9_000, 20_000]
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    shares = {"a": 0.3, "b": 1.4, "c": 2.6, "d": 3.0, "e": 1.0}
    docs = spark.createDataFrame([(s, n, 1.0) for s in shares for n in sizes] + [("e", 0, 1.0)], "source string, size long, prior double")
    targets = spark.createDataFrame([(s, total, share * total) for s, share in shares.items()] + [("none", 0, 0.0)], "source string, source_size long, target double")
    got = {r.source: r for r in mixing.solve_dual(docs, targets).collect()}
    assert got["e"].lam == 0 and got["e"].steps == 0 and got["none"].steps == 0
    for name in "abcd":
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            words = sum(n * min(3.0, np.exp(min(mid * n / mean, 2.0))) for n in sizes)
            low, high = (mid, high) if words < shares[name] * total - 1e-6 else (low, mid)
        rate = lambda lam, n: min(3.0, np.exp(min(lam * n / mean, 2.0)))
        assert all(rate(got[name].lam, n) == pytest.approx(rate(high, n), abs=1e-3) for n in sizes), name


# ---- op4

def test_ids_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    cache = packing.WordCache(packing.vocabulary_path("byte_bpe_50k.json"), packing.vocabulary_path("byte_bpe_50k.tiktoken"))
    plain = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    texts = [r.text for r in docs.select("text").limit(150).collect()] + [t or "" for t in ODD]
    texts += ["it's they'll I'd, no.. ok.,", "a\nb\n", "\n a", " lead", "trail ", "x y z", "<|endoftext|> a", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "b <|endoftext|>", "x\n<|endoftext|>\ny <|endoftext", "a1 b2. 3,4", "ﬁ ǅ ª.", "é à.", "a\x00b c", "a\x1cb c"]
    for t in texts:
        assert np.frombuffer(cache.ids(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((size if fit is None else fit) - n)
    return len(gaps)


def test_packs_nearly_as_well_as_best_fit_decreasing(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(packing, "PART_ROWS", 40)
    lengths = [rng.choice([rng.randint(1, 1024), rng.randint(1, 600), rng.randint(300, 420), 350]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(5)
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), [*sorted(places)[1:], (sum(n for _, n in places), 0)], strict=True))
        assert sum(n for _, n in places) <= 1024
    assert len(held) <= 1.01 * best_fit_decreasing(lengths, 1024)


def test_packed_sequences_are_whole(spark):
    texts = ODD + ["lorem ipsum " * k for k in range(0, 900, 45)] + ODD
    rows = packing.pack_documents(frame(spark, texts, extra=True)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert len(pieces) == len(texts)
    for found in pieces.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert all(n == 1024 for _, _, n in found[1:]) and all(s == sum(x[2] for x in found[:p]) for p, s, _ in found)
    assert packing.pack_documents(frame(spark, [])).count() == 0


# ---- op5

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rule_counts(spark, docs):
    texts = [*ODD, "a b c d e a b c d e x", "a\na\n\n \na\r\nb", "é é é é é é é", "| # * x"] + [r.text for r in docs.select("text").limit(200).collect()]
    for r in quality_rules.counts(frame(spark, texts, extra=True)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])


def test_decision_list_learns_and_keeps(spark, docs, labels):
    rules = quality_rules.learn(docs, labels)
    assert rules
    rows = quality_rules.apply(docs, rules).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0 and not r.base_failed]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.3
    none = quality_rules.learn(docs, labels.filter("quality = 7"))
    assert none == []
    plan = quality_rules.apply(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- op6

def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(r), sum(hit), spans, hashlib.sha256(bytes(b for b, k in zip(r, hit, strict=True) if not k)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "in_task"), [(20, 8, 20_000), (30, 10, 20_000), (15, 15, 20_000), (20, 8, 3)])
def test_repeats(spark, monkeypatch, length, gram, in_task):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(80)) for _ in range(4)]
    texts = ODD + ["aaaa" * 30, "ab" * 40, "ab" * 40] + ["".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(31, 80)] for _ in range(rng.randint(1, 6))) for _ in range(60)]
    monkeypatch.setattr(repeats, "IN_TASK", in_task)
    df = frame(spark, texts).repartition(3).cache()
    df.count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, length, gram).collect()}
    assert got == dict(enumerate(brute_repeats(texts, length)))


def test_long_texts_cross_chunks(spark, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef") for _ in range(500))
    texts = ["".join(rng.choice("abcdef") for _ in range(3000)) + passage + "z", passage + "y" * 10]
    data, bounds = repeats.text_bytes(__import__("pyarrow").array(texts))
    whole = {(int(t), int(f) + k) for t, f, n in zip(*repeats.runs(data, bounds)[:3], strict=True) for k in range(n)}
    monkeypatch.setattr(repeats, "CHUNK", 300)
    parts = {(int(t), int(f) + k) for t, f, n in zip(*repeats.runs(data, bounds)[:3], strict=True) for k in range(n)}
    assert whole == parts
    df = frame(spark, texts)
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()}
    assert got == {0: 500, 1: 500}


def test_deduplicate_keeps_columns_and_characters(spark):
    passage = "é" * 150
    df = frame(spark, ["x" + passage, "yy" + passage, None], extra=True)
    out = repeats.deduplicate(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text is None and rows[0].n_chars == len(rows[0].text)


# ---- op7

def test_segments_are_maximal():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(0, 25)
        scores = [rng.uniform(0.3, 2) if rng.random() < 0.4 else rng.uniform(-1.5, 0) for _ in range(n)]

        def maximal(a, b):
            if a >= b:
                return []
            best = max(((round(sum(scores[i:j]), 9), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return maximal(a, i) + [(i, j, best[0])] + maximal(j, b)

        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in maximal(0, n)]


def test_segments_of_a_long_text_are_linear():
    import time

    falling = np.tile([1.0, -2.0], 500_000)
    began = time.time()
    assert len(toxicity.segments(falling)) == 500_000 and time.time() - began < 20


def test_log_odds_equal_brute_force():
    rng = random.Random(1)
    clean, toxic = [rng.randint(0, 40) for _ in range(50)], [rng.randint(0, 9) for _ in range(50)]
    clean[0] = toxic[0] = 0
    got = toxicity.log_odds(np.array(clean, dtype=float), np.array(toxic, dtype=float))
    n0, n1, total = sum(clean), sum(toxic), 0.1 * (sum(clean) + sum(toxic))
    for y0, y1, value in zip(clean, toxic, got, strict=True):
        if not y0 + y1:
            assert value == 0
            continue
        a = 0.1 * (y0 + y1)
        delta = np.log((y1 + a) / (n1 + total - y1 - a)) - np.log((y0 + a) / (n0 + total - y0 - a))
        z2 = delta**2 / (1 / (y1 + a) + 1 / (y0 + a))
        assert value == pytest.approx(delta * z2 / (z2 + 9))


def test_maxima_are_fitted():
    rng = np.random.default_rng(3)
    words = rng.integers(20, 3000, 20_000).astype(float)
    best = (np.log(0.04 * words) - np.log(-np.log(rng.random(len(words))))) / 0.7
    lam, k = toxicity.fit_maxima(words, best)
    assert lam == pytest.approx(0.7, rel=0.03) and k == pytest.approx(0.04, rel=0.1)


def test_toxic_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert (model["table"] != 0).sum() > 1000
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter(common.held_out(F.col("doc_id"))).collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.75 and hit / sum(r.toxic for r in rows) > 0.75
    assert len({round(r.score, 9) for r in rows}) > 100
    odd = toxicity.score(frame(spark, [*ODD, "word " * 200_000], extra=True), model, with_passages=True).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in odd)
    # the score again, step by step
    some = docs.limit(40).collect()
    got = {r.doc_id: r for r in toxicity.score(docs.limit(40), model, with_passages=True).collect()}
    for d in some:
        tokens = (d.text or "").split()
        own = [float(model["table"][toxicity.bucket(t)]) - model["drift"] if toxicity.normal(t) else -model["drift"] for t in tokens]
        values = [model["k"] * len(tokens) * np.exp(-model["lambda"] * s) for _, _, s in toxicity.segments(np.array(own))]
        held = [np.log10(0.05 / e) for e in values if e <= 0.05]
        x = min(12.0, sum(held)) if held else max([-6.0, *(np.log10(0.05 / e) for e in values)])
        assert got[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-(model["curve"][0] + model["curve"][1] * x))))
        assert got[d.doc_id].n_passages == len(held) == len(got[d.doc_id].passages)
    none = toxicity.train(docs.limit(0), labels)
    assert toxicity.score(frame(spark, ["idiot"]), none).first().score == 0
    assert toxicity.score(frame(spark, []), model).count() == 0


# ---- op8

def exact_classes(texts, threshold=0.8):
    # words and shingles as Python sees them, no hashes
    shingles = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in ((t or "").split() for t in texts)]
    bags = [Counter(s) for s in shingles]
    alike = lambda a, b: (both := sum((a & b).values())) / (a.total() + b.total() - both)
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and alike(bags[i], bags[j]) >= threshold:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base))
    texts += ODD + ODD
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, texts, extra=True)).collect()}
    assert got == dict(enumerate(exact_classes(texts)))
    kept = near_duplicates.keep_one(frame(spark, texts, extra=True))
    assert kept.columns == frame(spark, texts, extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(exact_classes(texts)))
    assert near_duplicates.classes(frame(spark, [])).count() == 0


def test_block_search_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    texts = [" ".join(w if rng.random() > rate else f"u{rng.random()}" for w in base) for _ in range(25) for rate in (0.0, 0.01, 0.02, 0.03, 0.05)]
    want = dict(enumerate(exact_classes(texts)))
    assert len(set(want.values())) > 5
    for block, large, centres, group in ((400_000, 2, 1, 400), (900, 8, 1, 3), (900, 10_000, 3, 400)):
        for name, value in (("BLOCK", block), ("LARGE", large), ("CENTRES", centres), ("GROUP", group), ("few_entries", lambda *a: False)):
            monkeypatch.setattr(near_duplicates, name, value)
        got = {r.doc_id: r.class_id for r in near_duplicates.classes(frame(spark, texts)).collect()}
        assert got == want


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    pairs = [(a, np.concatenate([a[:200], a[:50]])), (np.repeat(a[:60], 6), np.repeat(a[:60], 3)), (a[:20], a[5:40])]
    pairs.append((np.repeat(a[:3], [300, 5, 77]), np.repeat(a[:3], [200, 9, 100])))
    for x, y in pairs:
        s = near_duplicates.signatures([np.unique(x, return_counts=True), np.unique(y, return_counts=True)], 4096)
        x, y = Counter(x.tolist()), Counter(y.tolist())
        share = (x & y).total() / (x | y).total()
        assert (s[0] == s[1]).mean() == pytest.approx(share, abs=0.035)
        assert near_duplicates.similarity(near_duplicates.cells(np.array(list(x.elements()), dtype=np.uint64)), near_duplicates.cells(np.array(list(y.elements()), dtype=np.uint64))) == pytest.approx(share)


def test_signatures_cost_little_for_heavy_shingles():
    heavy = (np.arange(1, 4, dtype=np.uint64), np.array([10**9, 1, 3]))
    assert near_duplicates.signatures([heavy]).shape == (1, near_duplicates.REGISTERS)


def test_words_of_bytes_are_those_of_split():
    import pyarrow as pa

    rng = random.Random(12)
    texts = [*ODD, "x\u3000y z\u2003w q\x85r", "\u00a0 \u00a0", *("".join(rng.choice("ab  é€\n\u2009\xa0") for _ in range(60)) for _ in range(100))]
    hashes, ends = rolling.word_hashes(*rolling.text_bytes(pa.array(texts)))
    seen = {}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert len(words) == ends[k + 1] - ends[k]
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes[ends[k] : ends[k + 1]].tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(70)] + [(500, 500), (1, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


# ---- op9

def test_ordinal_loss_and_gradient():
    rng = np.random.default_rng(5)
    n, size = 40, 12
    dense = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.4)
    owner, index = np.nonzero(dense)
    value, y = dense[owner, index], rng.integers(0, 4, n)
    weights, free = rng.normal(size=size), np.array([-0.5, 0.1, -0.3])

    def brute(w, f):
        cuts = [f[0], f[0] + np.exp(f[1]), f[0] + np.exp(f[1]) + np.exp(f[2])]
        total = 0.0
        for row, grade in zip(dense, y, strict=True):
            above = [1.0, *(1 / (1 + np.exp(-(row @ w - c))) for c in cuts), 0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total / n + ordinal_quality.RIDGE / 2 * (w @ w)

    got, by_weight, by_free = ordinal_quality.loss(weights, free, index, value, owner, y)
    assert got == pytest.approx(brute(weights, free))
    for k in range(size):
        step = np.eye(size)[k] * 1e-6
        assert by_weight[k] == pytest.approx((brute(weights + step, free) - brute(weights - step, free)) / 2e-6, abs=1e-6)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert by_free[k] == pytest.approx((brute(weights, free + step) - brute(weights, free - step)) / 2e-6, abs=1e-6)


def test_shapes_are_whole():
    assert ordinal_quality.shape("Aa0-" * 30) == "Aa0-" * 30


def test_ordinal_scores_separate(spark, docs, labels):
    ratings = labels.select("doc_id", ordinal_quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ordinal_quality.train(docs, ratings)
    assert (np.diff(model["cuts"]) > 0).all()
    rows = ordinal_quality.score(docs, model).join(labels, "doc_id").filter(common.held_out(F.col("doc_id"))).collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5
    odd = ordinal_quality.score(frame(spark, ODD, extra=True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in odd)
    assert all(r.kept for r in ordinal_quality.score(docs.limit(5), ordinal_quality.train(docs, ratings.limit(0))).collect())


# ---- op10

def test_language_held_out_and_mixed(spark, docs):
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(common.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    by = {}
    for r in docs.filter("n_chars between 500 and 3000").select("lang", "text").collect():
        by.setdefault(r.lang, r.text)
    mixed = " ".join(by["en"].split()[:60] + by["de"].split()[:90])
    got = {r.doc_id: r for r in language.identify(frame(spark, [*ODD, "123 ... ###", mixed], extra=True), model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, len(ODD))] == ["und"] * 4
    last = got[len(ODD) + 1]
    assert [s.lang for s in last.spans] == ["en", "de"] and abs(last.spans[1].first_word - 60) <= 6
    assert language.identify(frame(spark, ["abc"]), language.train(docs.limit(0))).first().lang_pred == "und"


def test_word_scores_equal_brute_force():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["", "пример", "aпb"]
    log = np.log(np.random.default_rng(2).random((language.BUCKETS, 3))).astype(np.float32)
    model = {"langs": ["a", "b", "c"], "log": log, "scripts": {"latin": [0, 1], "cyrillic": [2]}}
    got = language.word_scores(words, model)
    for word, row in zip(words, got, strict=True):
        if not word:
            assert (row == 0).all()
            continue
        grams = language.gram_hashes([word])[0]
        sums = log[grams].astype(float).sum(axis=0) * min(1.0, 12 / len(grams))
        if word == "пример":
            sums[:2] = -1e9
        elif word != "aпb":  # of two scripts: all three languages stay
            sums[2] = -1e9
        assert row == pytest.approx(np.maximum(sums - sums.max(), -language.WORD_LIMIT))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(50):
        s = -rng.random((6, 3)) * 4
        path = language.viterbi(s, 1.5)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert value(tuple(path)) == pytest.approx(max(value(p) for p in product(range(3), repeat=6)))
        assert value(tuple(language.label_words(s, 1.5))) == pytest.approx(value(tuple(path)))
