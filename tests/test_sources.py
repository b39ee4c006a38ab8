"""Text, log, audio and streaming sources over small fixtures."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.functions import scalars
from veriframe.operators import audio as audio_ops
from veriframe.operators import losses, prepare, runs, scoring
from veriframe.sources import audio, lists, logs
from veriframe.streaming import monitor


def test_manifest_and_trials(spark, tmp_path):
    (tmp_path / "m.txt").write_text("id1 id1/k/1.wav\n\nid2   /abs/2.wav\nlonely\nid1 id1/k/1.wav\n")
    rows = [(r.line_no, r.speaker, r.path) for r in lists.read_manifest(spark, str(tmp_path / "m.txt"), "/root/").orderBy("line_no").collect()]
    assert rows == [(0, "id1", "/root/id1/k/1.wav"), (2, "id2", "/abs/2.wav"), (4, "id1", "/root/id1/k/1.wav")]
    (tmp_path / "t.txt").write_text("1 a/1.wav b/1.wav\na/1.wav c/1.wav\n0 x a/2.wav b/2.wav\n")
    rows = [(r.line_no, r.label, r.ref, r.com) for r in lists.read_trials(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()]
    assert rows == [(0, 1, "a/1.wav", "b/1.wav"), (1, None, "a/1.wav", "c/1.wav"), (2, 0, "a/2.wav", "b/2.wav")]
    assert {r.label for r in lists.read_trials(spark, str(tmp_path / "t.txt"), random_labels=True).collect()} <= {0, 1}


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([("id1", "a.wav")], "speaker string, path string")
    lists.write_lines(df, str(tmp_path / "out"), "speaker", "path")
    assert [r.speaker for r in lists.read_manifest(spark, str(tmp_path / "out")).collect()] == ["id1"]


def test_logs(spark, tmp_path):
    text = "Epoch 1, TEER/TAcc 0.04, TLOSS 10.156291, LR 0.001000 \nEpoch 1, VEER 31.6129, MinDCF 0.97204, Threshold 0.000000\n\nEpoch 2, TEER/TAcc 1.5, TLOSS 9.5, DistillLoss 0.25, LR 0.00095\nEarly stopping at epoch 2.\nEpoch 1, TEER/TAcc 0.1, TLOSS nan, LR 0.001\n"
    (tmp_path / "scores.txt").write_text(text)
    rows = logs.read_log(spark, str(tmp_path / "scores.txt")).orderBy("line_no").collect()
    assert [(r.kind, r.epoch) for r in rows] == [("train", 1), ("validation", 1), ("train", 2), ("stop", 2), ("train", 1)]
    assert (rows[0].tloss, rows[0].lr, rows[1].veer, rows[1].min_dcf, rows[2].distill) == (10.156291, 0.001, 31.6129, 0.97204, 0.25)
    train = logs.read_log(spark, str(tmp_path / "scores.txt")).filter("kind = 'train'")
    assert [r.segment for r in runs.segments(train, "file", "line_no").orderBy("line_no").collect()] == [0, 0, 1]
    (tmp_path / "run20251029035150.cmd").write_text("Namespace(config='a/b.yaml', lr=0.001, empty='', eval=False)")
    r = logs.read_run_arguments(spark, str(tmp_path / "run20251029035150.cmd")).first()
    assert str(r.run_ts) == "2025-10-29 03:51:50" and r.args == {"config": "a/b.yaml", "lr": "0.001", "empty": "", "eval": "False"}


def put_wave(path, samples):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.asarray(samples, dtype="<i2").tobytes())


def test_audio(spark, tmp_path):
    put_wave(tmp_path / "id1/k/1.wav", [0, 16384, -16384, 8192])
    put_wave(tmp_path / "id2/k/2.WAV", [1])
    (tmp_path / "id2/k/3.wav").write_text("no audio")
    (tmp_path / "id2/k/3.txt").write_text("other")
    assert lists.media_files(spark, str(tmp_path)).count() == 3
    assert [r.speaker for r in lists.speaker_directories(spark, str(tmp_path)).collect()] == ["id1", "id2"]
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert rows["1.wav"].samples == [0.0, 0.5, -0.5, 0.25] and rows["1.wav"].sample_rate == 16000
    assert not rows["3.wav"].ok and rows["3.wav"].error
    summary = audio.corruption_summary(audio.integrity_scan(spark, str(tmp_path))).first()
    assert summary.n_corrupt == 1
    assert {r.category for r in lists.noise_pool(spark, str(tmp_path)).collect()} == {"id1", "id2"}


def test_checksums_and_checkpoints(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"abc")
    (tmp_path / "d/model000000012.model").write_bytes(b"m")
    (tmp_path / "list.txt").write_text(f"http://x/a.bin {hashlib.md5(b'abc').hexdigest()}\nhttp://x/b.bin 00\n")
    got = {r.name: r.ok for r in lists.checksum_verdicts(spark, str(tmp_path / "d"), lists.read_checksums(spark, str(tmp_path / "list.txt"))).collect()}
    assert got == {"a.bin": True, "b.bin": False}
    assert [r.epoch for r in lists.checkpoints(spark, str(tmp_path / "d")).collect()] == [12]


def test_signal_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    r = df.select(
        scalars.wrap_pad(F.col("x"), 5).alias("pad"), scalars.pre_emphasis(F.col("x")).alias("pre"), scalars.level_db(F.col("x")).alias("db"),
        scalars.unit_energy(F.col("x")).alias("unit"), scalars.mel_to_hz(scalars.hz_to_mel(F.lit(440.0))).alias("hz"), scalars.round_down(F.lit(17), 5).alias("down"),
    ).first()
    assert r.pad == [1, 2, 3, 1, 2, 3] and r.down == 15 and r.hz == pytest.approx(440)
    assert r.pre == pytest.approx([1 - 0.97 * 2, 2 - 0.97, 3 - 0.97 * 2])
    assert r.db == pytest.approx(10 * np.log10(14 / 3 + 1e-4)) and sum(v * v for v in r.unit) == pytest.approx(1)


def test_noise_reverb_mel(spark):
    rng = np.random.default_rng(0)
    x, n = rng.standard_normal(2000), rng.standard_normal(2000)
    df = spark.createDataFrame([("u", x.tolist(), n.tolist(), [1.0, 0.5], 10.0)], "utt string, x array<double>, n array<double>, h array<double>, snr double")
    r = audio_ops.apply_reverb(audio_ops.apply_noise(df, "x", "n", "snr"), "x", "h").first()
    gain = np.sqrt(10 ** ((10 * np.log10((x**2).mean() + 1e-4) - 10 * np.log10((n**2).mean() + 1e-4) - 10) / 10))
    assert r.mixed == pytest.approx((x + gain * n).tolist())
    assert r.reverbed == pytest.approx(np.convolve(x, np.array([1, 0.5]) / np.sqrt(1.25))[:2000].tolist())
    frames = audio_ops.log_mel_frames(df, "utt", "x")
    assert frames.count() == 1 + 2000 // 160
    normal = np.array([r.mel for r in audio_ops.instance_normalized(frames, "utt").collect()])
    assert normal.shape[1] == 40 and abs(normal.mean(axis=0)).max() < 1e-6


def test_crops_and_segments(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 48239, 48240, 48241, 79999, 80000, 80001, 128001)], "n long")
    assert {r.n: r.c for r in audio_ops.sliding_segments(df, "n").groupBy("n").agg(F.count("*").alias("c")).collect()} == {80001: 1, 128001: 2}
    for r in audio_ops.evaluation_crops(df, "n").collect():
        assert r.start >= 0 and r.start + r.length <= max(r.n, 48241)


def test_embedding_job_and_strict_join(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [3.0])], "utt string, crop_id int, samples array<double>")
    made = audio_ops.extract_embeddings(df, lambda clips: [[float(len(c)), 1.0] for c in clips], 2)
    trials = spark.createDataFrame([("a", "b", 1), ("a", "c", 0)], "ref string, com string, label int")
    assert scoring.score_trials(trials, made, normalize=False).first().score == pytest.approx(-1)
    with pytest.raises(ValueError):
        scoring.score_trials(trials, made, strict=True)
    with pytest.raises(KeyError):
        scoring.scorer("none")


def test_batches_have_distinct_speakers(spark):
    df = spark.createDataFrame([(f"s{k % 7}", k) for k in range(150)], "speaker string, utt long")
    groups = prepare.capped_groups(df, "speaker", "utt", 3, 10, 2)
    assert groups.groupBy("speaker").count().filter("count > 10 or count % 2 > 0").isEmpty()
    plan = prepare.batch_plan(groups.select("speaker", "group_no").distinct(), "speaker", 3, 4)
    full = plan.groupBy("round", "batch_in_round").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("d"))
    assert full.filter("n <> 4 or d <> 4").isEmpty() and not full.isEmpty()


def test_quotas():
    assert prepare.balance_quotas(100, 40, 0.5) == (40, 40)
    assert prepare.balance_quotas(10, 100, 0.8) == (10, 2)
    assert prepare.balance_quotas(100, 10, 0.1) == (1, 10)


def test_monitor_resumes(spark, tmp_path):
    """Files dropped in steps give the events of one batch over all."""
    rng = np.random.default_rng(2)
    values = {run: rng.random(40).tolist() for run in (1, 2)}
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for step in range(2):
        rows = [(run, i, v[i]) for run, v in values.items() for i in range(step * 20, step * 20 + 20)]
        spark.createDataFrame(rows, "run long, seq long, value double").coalesce(1).write.mode("append").parquet(src)
        stream = monitor.monitored(monitor.state_session(spark).readStream.schema("run long, seq long, value double").parquet(src), 8)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.run, r.seq, r.event) for r in spark.read.parquet(out).collect())
    want = []
    for run, v in values.items():
        best, since = float("inf"), 0
        for i, x in enumerate(v):
            if x < best:
                best, since = x, 0
                want.append((run, i, "improved"))
            else:
                since += 1
                if since >= 8:
                    want.append((run, i, "stopped"))
                    break
    assert got == sorted(want)


def test_triplet_trials(spark):
    rows = [(0, s, slot, [float(s), float(slot), 0.1 * s * slot]) for s in range(5) for slot in (0, 1)]
    df = spark.createDataFrame(rows, "batch_id long, speaker long, slot int, embedding array<double>")
    assert losses.triplet_trials(df).groupBy("label").count().count() == 2
    assert losses.mined_negatives(df, "rank").filter("speaker = neg").isEmpty()
