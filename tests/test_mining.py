"""Rank mining takes a hard negative for the given share of anchors, and any for the rest."""

import random

from veriframe.operators import losses


def test_hard_share(spark):
    rng = random.Random(3)
    rows = [(0, s, slot, [rng.random() for _ in range(4)]) for s in range(40) for slot in (0, 1)]
    batch = spark.createDataFrame(rows, "batch_id long, speaker long, slot int, embedding array<double>")
    at = {(s, slot): v for _, s, slot, v in rows}
    nearest = {s: min((sum((x - y + 1e-6) ** 2 for x, y in zip(at[s, 0], at[o, 1], strict=True)), o) for o in range(40) if o != s)[1] for s in range(40)}
    hits = {}
    for share in (0.0, 0.5, 1.0):
        got = {r.speaker: r.neg for r in losses.mined_negatives(batch, "rank", hard_prob=share).collect()}
        assert set(got) == set(range(40)) and all(s != n for s, n in got.items())
        hits[share] = sum(got[s] == nearest[s] for s in got)
    assert hits[1.0] == 40 and hits[0.0] < 10 and hits[0.0] < hits[0.5] < 40
