"""The repair of the mixture's rounding closes the whole gap."""

import random
from collections import Counter

import pytest

from veriframe.llm import mixing


def test_moved_units_close_the_gap():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [[rng.randint(0, 3) for _ in range(4)] for _ in sizes]
        docs = [sum(x) for x in counts]
        down = [sum(c * n for c, n in enumerate(x)) for x in counts]
        up = [3 * n - d for n, d in zip(docs, down, strict=True)]
        gap = rng.uniform(-sum(s * d for s, d in zip(sizes, down, strict=True)), sum(s * u for s, u in zip(sizes, up, strict=True)))
        moved = mixing.moved_units(gap, sizes, up, down, docs)
        assert all(-d <= m <= u for m, d, u in zip(moved, down, up, strict=True))
        left = gap - sum(m * s for m, s in zip(moved, sizes, strict=True))
        free = [s for s, m, u, d in zip(sizes, moved, up, down, strict=True) if (m < u if left > 0 else -m < d)]
        assert not left or abs(left) < min(free)
        for x, m in zip(counts, moved, strict=True):
            level, rest = mixing._levels(x, m)
            copies = [c for c, n in enumerate(x) for _ in range(n)]
            new = [max(c, level) if m > 0 else min(c, level) for c in copies] if m else copies
            assert sum(new) - sum(copies) + (rest if m > 0 else -rest) == m
            assert rest <= new.count(level)


@pytest.mark.parametrize("long", [100_000, 1_000_000])
def test_one_long_document_among_short_ones(spark, long):
    rng = random.Random(long)
    rows = []
    for source, rate in (("a", 1.3), ("b", 0.6), (None, 1.72)):
        sizes = [rng.randint(20, 300) for _ in range(3000)] + [long, 0]
        rows += [(len(rows) + k, len(rows) + k, source, n, rate, rate * sum(sizes)) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "uid long, doc_id long, source string, size long, rate double, target double")
    taken = Counter()
    for r in mixing.round_to_copies(df).collect():
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    want = {r[2]: r[5] for r in rows}
    assert all(abs(taken[s] - want[s]) < 20 for s in want), (taken, want)
