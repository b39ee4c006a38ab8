"""Files by byte range, live logs, sinks, the audio scan, sample operators and plug-ins."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.functions.registry import Registry
from veriframe.operators import audio as audio_ops
from veriframe.operators import cohort, losses, prepare, runs, scoring
from veriframe.plans.prefix_sum import numbered_within
from veriframe.sources import audio, line_files, lists, logs, sinks
from veriframe.streaming import monitor


# ---- byte ranges ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\nbb\r\n\nccc", b"\n\nx y\n", b"one\ntwo\n", "Ä ß\né\n".encode()])
def test_ranges_give_every_line_once(tmp_path, text):
    path = tmp_path / "f.txt"
    path.write_bytes(text)
    want = [x.removesuffix(b"\r") for x in text.split(b"\n")]
    want = want[:-1] if not want[-1] else want
    for size in (1, 2, 3, 5, 100):
        got = [x for r in line_files.ranges(str(path), 0, len(text), size) for x in line_files.lines_between(r.file, r.start, r.end)]
        assert [x for _, x in got] == want
        assert all(text[at : at + len(x)] == x for at, x in got)


def test_lines_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(line_files, "CHUNK", 7)
    path = tmp_path / "f.txt"
    lines = [b"x" * n for n in (0, 3, 40, 7, 6, 8, 100, 0)]
    path.write_bytes(b"\n".join(lines) + b"\n")
    for size in (4, 50, 1000):
        got = [x for r in line_files.ranges(str(path), 0, path.stat().st_size, size) for _, x in line_files.lines_between(r.file, r.start, r.end)]
        assert got == lines
    size = path.stat().st_size
    assert line_files.LogTailReader._whole_lines(str(path), size) == size
    assert line_files.LogTailReader._whole_lines(str(path), size - 2) == size - 2 - 100  # inside the long line


def test_list_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "t.txt").write_text("1 a/1.wav b/1.wav\na/1.wav c/1.wav\n\n0 x a/2.wav b/2.wav\nlonely\nyes a b\n")
    (tmp_path / "sub/u.txt").write_text("1 p q\n0 r s")
    (tmp_path / "_SUCCESS").write_text("1 no no\n")
    for size in (1, 6, 1000):
        rows = line_files.line_numbers(line_files.read_list(spark, str(tmp_path), "trials", size), str(tmp_path), size).collect()
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.label, r.ref, r.com) for r in rows)
        assert got == [("t.txt", 0, 1, "a/1.wav", "b/1.wav"), ("t.txt", 1, None, "a/1.wav", "c/1.wav"), ("t.txt", 3, 0, "a/2.wav", "b/2.wav"), ("t.txt", 5, None, "a", "b"), ("u.txt", 0, 1, "p", "q"), ("u.txt", 1, 0, "r", "s")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        own = line_files.read_list(spark, str(tmp_path), "trials").filter("label = 1 and ref > 'b' and length(com) = 1")
        assert [r.ref for r in own.collect()] == ["p"]
        filters = own._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
        assert "length(com" in filters and "label" not in filters.split("Filter")[-1]  # only what cannot be pushed is left
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert line_files.read_list(spark, str(tmp_path / "none"), "manifest").count() == 0
    (tmp_path / "c.txt").write_text("u1 o1 m1\nu2 m2\nu3\n")
    assert sorted((r.source, r.out, r.md5) for r in line_files.read_list(spark, str(tmp_path / "c.txt"), "checksums").collect()) == [("u1", "o1", "m1"), ("u2", None, "m2")]
    assert [r.speaker for r in lists.read_speakers(spark, str(tmp_path / "sub/u.txt")).collect()] == ["1 p q", "0 r s"]


# ---- live logs and sinks ----------------------------------------------------------------------------------------


def test_tail_follows_growing_files(spark, tmp_path):
    """Half-written lines wait, appended lines are found after a restart, and nothing comes twice."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.txt", tmp_path / "in/b.txt"

    def run():
        stream = line_files.tail(spark, source).select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "offset", "value")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, r.offset, r.value) for r in spark.read.parquet(out).collect())

    a.write_text("one\ntw")
    assert run() == [("a.txt", 0, "one")]
    a.write_text("one\ntwo\nthree\n")
    b.write_text("x\n")
    want = [("a.txt", 0, "one"), ("a.txt", 4, "two"), ("a.txt", 8, "three"), ("b.txt", 0, "x")]
    assert run() == want and run() == want
    b.write_text("")  # begun anew
    b.write_text("y\nz\nlonger\n")
    assert run()[len(want) - 1 :][:1] == [("b.txt", 0, "x")]


def test_live_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/log.txt").write_text("Epoch 1, VEER 31.5, MinDCF 0.97, Threshold 0.1\nnoise\nEpoch 1, TEER/TAcc 0.04, TLOSS 10.1, LR 0.001 \nEarly stopping at epoch 2.\n")
    stream = monitor.live_log(spark, str(tmp_path / "in"))
    stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.kind, r.epoch) for r in spark.table("live").orderBy("offset").collect()] == [("validation", 1), ("train", 1), ("stop", 2)]


def test_a_batch_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5, 0.5, 0.25), (2, 1.5, 0.4, 0.125)], "epoch int, veer double, min_dcf double, threshold double")
    log = str(tmp_path / "log")
    assert sinks.append_once(rows.filter("epoch = 1"), 0, log, sinks.validation_line())
    assert not sinks.append_once(rows.filter("epoch = 1"), 0, log, sinks.validation_line())
    # a batch that was cut off: lines are there, the ledger has nothing
    rows.selectExpr("'Epoch 9, VEER 9, MinDCF 9, Threshold 9' AS value").write.text(f"{log}/batch=1")
    assert sinks.append_once(rows.filter("epoch = 2"), 1, log, sinks.validation_line())
    assert [(r.epoch, r.veer, r.threshold) for r in logs.read_log(spark, log).orderBy("epoch").collect()] == [(1, 2.5, 0.25), (2, 1.5, 0.125)]
    sinks.append_log(rows.withColumns({"tacc": F.lit(1.0), "tloss": F.lit(2.0), "lr": F.lit(0.5)}), log, sinks.train_line())
    assert logs.read_log(spark, log).filter("kind = 'train'").count() == 2
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    for _ in range(2):
        sinks.stream_log(spark.readStream.schema(rows.schema).parquet(source), str(tmp_path / "log2"), str(tmp_path / "state"), sinks.validation_line(), ("epoch",)).awaitTermination()
    assert logs.read_log(spark, str(tmp_path / "log2")).count() == 2


def test_sidecars_are_replaced_whole(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, 5.0, 0.5), ("r", 2, 3.0, 0.25), ("r", 3, 3.0, 0.75), ("q", 1, None, 0.1)], "run string, epoch int, veer double, threshold double")
    where = str(tmp_path / "best")
    for part, want in ((rows.filter("epoch < 2"), {5.0, 0.5}), (rows, {3.0, 0.25})):
        sinks.write_best(part, "run", "veer", "threshold", where)
        assert {r.value for r in lists.sidecar_values(spark, where).collect()} == want
    assert [p.name for p in tmp_path.iterdir()] == ["best"]


def test_segments(spark, tmp_path):
    clips = spark.createDataFrame([("a", list(range(10))), ("b", [1]), ("c", [])], "utt string, x array<int>")
    sinks.write_segments(clips, "x", str(tmp_path / "s"), 4, 3)
    assert sorted((r.utt, r.start, r.samples) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 0, [0, 1, 2, 3]), ("a", 3, [3, 4, 5, 6])]


def test_arguments_given_twice(spark):
    df = spark.createDataFrame([("run20251029035150.cmd", "Namespace(a=1, b=['x=1', 'x=2'], a='2', c=None)"), ("f", "nothing")], "file string, value string")
    got = {r.file: r.args for r in logs.parse_run_arguments(df).collect()}
    assert got["run20251029035150.cmd"]["a"] == "2" and got["run20251029035150.cmd"]["c"] == "None" and got["f"] == {}


# ---- audio files ------------------------------------------------------------------------------------------------


def test_scan_tells_what_is_wrong(spark, tmp_path):
    from test_sources import put_wave

    put_wave(tmp_path / "m/noise/1.wav", range(100))
    put_wave(tmp_path / "m/noise/2.WAV", range(5))
    put_wave(tmp_path / "m/deep/er/3.wav", range(9))
    sound = (tmp_path / "m/noise/1.wav").read_bytes()
    for name, content in {"t.Wav": sound[:-3], "h.wav": sound[:30], "e.wav": b"", "u.flac": b"none", "a.AAC": b"\xff\xf1ab", "x.txt": b"none"}.items():
        (tmp_path / "m/noise" / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.integrity_scan(spark, str(tmp_path / "m")).collect()}
    assert {k: r.kind for k, r in rows.items()} == {"1.wav": None, "2.WAV": None, "3.wav": None, "t.Wav": "truncated", "h.wav": "header", "e.wav": "empty", "u.flac": "unknown", "a.AAC": "no decoder"}
    assert all(r.ok == (r.kind is None) and (r.error is None) == r.ok for r in rows.values()) and rows["1.wav"].n_samples == 100
    scanned = audio.integrity_scan(spark, str(tmp_path / "m"))
    assert {r.kind: r.n_files for r in audio.corruption_by_kind(scanned).collect()} == {"truncated": 1, "header": 1, "empty": 1, "unknown": 1, "no decoder": 1}
    assert audio.corrupted_files(scanned).count() == 5
    assert {r.category for r in lists.noise_pool(spark, str(tmp_path)).collect()} == {"m"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in lists.noise_pool(spark, str(tmp_path / "m")).collect()) == ["3.wav"]
    assert lists.noise_pool(spark, str(tmp_path / "missing")).count() == 0


def test_chunks_of_a_long_file(monkeypatch, tmp_path):
    from test_sources import put_wave

    put_wave(tmp_path / "l.wav", range(1000))
    whole = audio.decode_wave((tmp_path / "l.wav").read_bytes())[1]
    monkeypatch.setattr(audio, "CHUNK", 64)
    assert (audio.decode_wave((tmp_path / "l.wav").read_bytes())[1] == whole).all() and len(whole) == 1000


# ---- samples ----------------------------------------------------------------------------------------------------


def test_overlap_add_is_the_convolution():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (5, 9), (3000, 1), (2500, 400), (9999, 3000), (4096, 4096)):
        x, h = rng.standard_normal(n), rng.standard_normal(m)
        spectra = {}
        for _ in range(2):
            assert np.abs(audio_ops.overlap_add(x, h, spectra) - np.convolve(x, h)[:n]).max() < 1e-9 * max(1, m)
        assert len(spectra) == 1


def test_draws_are_distinct_and_uniform(spark):
    drawn = spark.range(6000).select(audio_ops.distinct_draws(F.lit(6), F.lit(3), 5, F.col("id")).alias("d")).collect()
    sets = Counter(tuple(sorted(r.d)) for r in drawn)
    assert len(sets) == 20 and all(len(set(s)) == 3 for s in sets)
    assert all(abs(n - 300) < 5 * 300**0.5 for n in sets.values())  # five deviations
    assert spark.range(3).select(audio_ops.distinct_draws(F.lit(4), F.lit(4), 1, F.col("id")).alias("d")).filter("size(array_distinct(d)) = 4").count() == 3
    assert spark.range(1).select(audio_ops.distinct_draws(F.lit(4), F.lit(0), 1, F.col("id")).alias("d")).first().d == []


def test_noises_are_added_up(spark):
    rng = np.random.default_rng(1)
    x, a, b = rng.standard_normal(50), rng.standard_normal(50), rng.standard_normal(30)
    clips = spark.createDataFrame([("u", x.tolist()), ("v", [1.0, 2.0])], "utt string, samples array<double>")
    plan = spark.createDataFrame([("u", 0, "a", 5.0), ("u", 1, "b", 10.0)], "utt string, noise_no int, path string, snr_db double")
    noises = spark.createDataFrame([("a", a.tolist()), ("b", b.tolist())], "path string, samples array<double>")
    got = {r.utt: r.mixed for r in audio_ops.mix_noises(clips, plan, noises, "utt").collect()}
    level = lambda v: 10 * np.log10((v**2).mean() + 1e-4)
    want = x + np.sqrt(10 ** ((level(x) - level(a) - 5) / 10)) * a
    want[:30] += np.sqrt(10 ** ((level(x) - level(b) - 10) / 10)) * b
    assert got["u"] == pytest.approx(want.tolist()) and got["v"] == [1.0, 2.0]


def test_an_empty_pool_plans_nothing(spark):
    rows = spark.createDataFrame([("u", "music")], "utt string, augmentation string")
    pool = spark.createDataFrame([], "category string, path string")
    assert audio_ops.noise_plan(rows, "utt", pool).count() == 0


def test_log_mel_frames_are_centred(spark, monkeypatch):
    rng = np.random.default_rng(2)
    clips = {"a": rng.standard_normal(1000), "b": rng.standard_normal(100), "c": np.array([0.5]), "d": np.zeros(0)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()] + [("e", None)], "utt string, x array<double>")
    got = {(r.utt, r.frame): r.mel for r in audio_ops.log_mel_frames(df, "utt", "x", n_mels=5).collect()}
    assert Counter(k for k, _ in got) == {k: 1 + len(v) // 160 for k, v in clips.items() if len(v)}
    filters, taper = audio_ops.mel_filters(5, 512, 16_000), np.zeros(512)
    taper[56:456] = [0.54 - 0.46 * np.cos(2 * np.pi * k / 400) for k in range(400)]
    for (utt, frame), mel in got.items():
        x, n = clips[utt], len(clips[utt])
        at = [n - 1 - abs(n - 1 - abs(t) % (2 * n - 2)) if n > 1 else 0 for t in range(frame * 160 - 256, frame * 160 + 256)]
        power = np.abs(np.fft.rfft(x[at] * taper)) ** 2
        assert mel == pytest.approx(np.log(filters @ power + 1e-6).tolist(), abs=1e-8)
    monkeypatch.setattr(audio_ops, "FRAMES", 2)
    assert sum(len(m) for _, m in audio_ops.mel_spectra(clips["a"], filters, 512, 400, 160, True)) == 7


# ---- plans and plug-ins -----------------------------------------------------------------------------------------


def test_quotas_fill_both_classes():
    for p, n, r in itertools.product((1, 7, 50, 200), (1, 9, 50, 300), (0.1, 0.25, 0.5, 0.8)):
        a, b = prepare.balance_quotas(p, n, r)
        assert 0 <= a <= p and 0 <= b <= n
        assert a + b == 0 or abs(a - r * (a + b)) <= 1 + 1e-9  # whole trials


def test_numbering_inside_groups(spark):
    df = spark.createDataFrame([(g, k * 7 % 50) for g, n in (("a", 31), ("b", 1), (None, 5)) for k in range(n)], "g string, k int")
    got = numbered_within(df.repartition(5), ["g"], ["k"]).collect()
    for g, n in (("a", 31), ("b", 1), (None, 5)):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.nth for r in own] == list(range(n)) and {r.n_nth for r in own} == {n}


def test_batches_are_counted(spark):
    groups = spark.createDataFrame([(f"s{k}", k % 3) for k in range(23)], "speaker string, group_no long")
    plan = {r["round"]: r["count"] for r in prepare.batch_plan(groups, "speaker", 1, 3).groupBy("round").count().collect()}
    for r in prepare.batch_counts(groups, 3).collect():
        assert (plan[r.round], r.n_kept + r.n_dropped, r.n_batches * 3) == (r.n_kept, r.n_tuples, r.n_kept)


def test_efficiency_ranks_share_ties(spark):
    best = spark.createDataFrame([("a", 4.0, 2), ("b", 2.0, 1), ("c", 1.0, 1), ("d", 9.0, 1), ("e", 1.0, 0)], "run string, best_value double, size int")
    assert {r.run: (r.ratio, r["rank"]) for r in runs.efficiency(best, "size").collect()} == {"a": (2.0, 2), "b": (2.0, 2), "c": (1.0, 1), "d": (9.0, 4), "e": (None, None)}


def test_distances_of_vectors_of_any_length(spark):
    one = spark.createDataFrame([("u", [3.0, 4.0])], "utt string, embedding array<double>")
    other = spark.createDataFrame([("u", [6.0, 8.0])], "utt string, embedding array<double>")
    assert losses.distillation(one, other, "mse").first().distance == pytest.approx(0)
    turned = spark.createDataFrame([("u", [-4.0, 3.0])], "utt string, embedding array<double>")
    assert losses.distillation(one, turned, "mse", 2.0).first().distance == pytest.approx(2 / 4 / 2)


def test_plug_ins(spark):
    own = Registry("thing")
    assert own.register("x", 5) == 5 and own["x"] == 5 and own.names() == ["x"]
    with pytest.raises(KeyError):
        own["y"]
    scoring.register_scorer("first", lambda a, b: a[0] * b[0])
    e = spark.createDataFrame([(1, [2.0, 1.0], 1), (2, [3.0, 1.0], 1)], "vec_id long, embedding array<double>, label long")
    assert scoring.neighbour_trials(e, 1, score="first").first().score == 6
    losses.batch_losses.register("constant", lambda batch: batch.sparkSession.range(1).select(F.lit(1.5).alias("loss")))
    try:
        assert losses.batch_losses["constant"](e).first().loss == 1.5
    finally:
        losses.batch_losses.known.pop("constant")
    big = spark.createDataFrame([(1, [1.0] * 10)], "cls int, w array<double>")
    with pytest.raises(ValueError):
        scoring.against_classes(e, big, max_bytes=50)


def test_cohort_statistics(spark, monkeypatch):
    monkeypatch.setattr(cohort, "SIDES", 8)
    monkeypatch.setattr(cohort, "MEMBERS", 16)
    monkeypatch.setattr(cohort, "OPEN", 2)
    rng = np.random.default_rng(3)
    sides, members = rng.standard_normal((30, 6)), rng.standard_normal((70, 6))
    members[:20] = members[0]  # ties
    sides[0] = members[0]
    a = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(sides)] + [(99, None)], "side long, v array<double>")
    b = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(members)], "cohort_id long, v array<double>")
    got = {r.side: (r.mu, r.sigma) for r in cohort.top_statistics(a.repartition(3), b.repartition(4), 15).collect()}
    assert len(got) == 30
    for k in range(30):
        best = np.sort(-np.linalg.norm(sides[k] - members, axis=1))[-15:]
        assert got[k] == pytest.approx((best.mean(), best.std()), abs=1e-9)
