"""Registered queries over files, streams and sample arrays that Spark derives from the driver tables, each with the SQL
it must equal. Importing this module adds them to the catalogue."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriframe.functions import scalars
from veriframe.operators import audio, cohort, losses, prepare
from veriframe.plans import catalogue
from veriframe.plans.catalogue import _BEST, _C, _CE, _E, _G, _T, ORACLES, batch, embeddings, query, rounded, table, trials
from veriframe.plans.materialize import materialize, shared_folder
from veriframe.plans.prefix_sum import numbered_within
from veriframe.sources import audio as audio_files
from veriframe.sources import line_files, lists, logs, sinks
from veriframe.streaming import monitor


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- lists ------------------------------------------------------------------------------------------------------


@query(f"WITH {_T} SELECT label, concat('v/', ref) AS ref, concat('v/', com) AS com FROM t WHERE label = 1")
def trial_list_source(spark, sf_dir):
    where = folder(spark, "trials")
    path = lambda c: F.concat(F.lit("v/"), F.col(c).cast("string")).alias(c)
    lists.write_lines(trials(spark, sf_dir).select("label", path("ref"), path("com")), where, "label", "ref", "com")
    return line_files.read_list(spark, where, "trials", 1 << 18).filter("label = 1").select("label", "ref", "com")


@query("SELECT concat_ws('|', source, lang) AS speaker, concat('d/', doc_id, '.wav') AS path, count(*) AS n_lines FROM documents GROUP BY ALL")
def manifest_source(spark, sf_dir):
    """Every line with a line number of its own: the numbers of a file are those from 0 on."""
    where = folder(spark, "manifest")
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("speaker"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    lists.write_lines(docs, where, "speaker", "path")
    rows = line_files.line_numbers(line_files.read_list(spark, where, "manifest", 1 << 12), where, 1 << 12)
    spans = rows.groupBy("file").agg(F.max("line_no").alias("last"), F.countDistinct("line_no").alias("n"))
    whole = spans.filter(F.col("last") + 1 == F.col("n")).select("file")  # else the file's rows are missing from the result
    return rows.join(whole, "file").groupBy("speaker", "path").agg(F.count("*").alias("n_lines"))


@query("SELECT DISTINCT concat('http://x/', page_id, '.bin') AS source, CASE WHEN page_id % 2 = 0 THEN concat('o', page_id) END AS out, md5(url) AS md5 FROM pages")
def checksum_source(spark, sf_dir):
    where = folder(spark, "checksums")
    p = F.col("page_id").cast("string")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://x/"), p, F.lit(".bin")).alias("source"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("o"), p)).alias("out"), F.md5(F.col("url").cast("binary")).alias("md5"))
    lists.write_lines(rows, where, "source", "out", "md5")
    return line_files.read_list(spark, where, "checksums").select("source", "out", "md5").distinct()


@query("SELECT DISTINCT concat('id', user_id) AS speaker FROM events")
def speaker_list_source(spark, sf_dir):
    where = folder(spark, "speakers")
    lists.write_lines(table(spark, sf_dir, "events").select(F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("speaker")).distinct(), where, "speaker")
    return line_files.read_list(spark, where, "speakers").select("speaker")


@query("SELECT n_nationkey + 1 AS epoch, n_nationkey + 1 = max(n_nationkey + 1) OVER () AS resume FROM nation")
def checkpoint_files(spark, sf_dir):
    where = folder(spark, "models")
    name = F.format_string("model%09d.model", F.col("n_nationkey") + 1)
    audio_files.write_files(table(spark, sf_dir, "nation").select(name.alias("path"), F.lit(b"m").alias("content")), where)
    found = lists.checkpoints(spark, where)
    last = found.agg(F.max("epoch").alias("last"))
    return found.crossJoin(F.broadcast(last)).select(F.col("epoch").cast("long").alias("epoch"), (F.col("epoch") == F.col("last")).alias("resume"))  # one row


@query("SELECT doc_id, CASE WHEN CAST(toxic AS VARCHAR) = '1' THEN 1 ELSE 0 END AS label FROM labels")
def trial_polarity(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", scalars.is_positive(F.col("toxic").cast("string")).alias("label"))


# ---- live logs and sinks ----------------------------------------------------------------------------------------

PARTS = 10


def _log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as epochs of four runs, in the order of time, with the tenth of its run that each is in. They are stored
    by tenth, so that a tenth is read without the others."""
    events = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).alias("run"), "ts", "event_id", F.round("value", 4).alias("veer"))
    placed = numbered_within(events, ["run"], ["ts", "event_id"])
    part = F.floor(F.col("nth") * PARTS / F.col("n_nth")).cast("int")
    rows = placed.select("run", "event_id", (F.col("nth") + 1).alias("epoch"), "veer", F.round(F.col("veer") / 10, 5).alias("min_dcf"), F.round(F.col("veer") / 2, 6).alias("threshold"), part.alias("part"))
    where = folder(spark, "records")
    rows.write.partitionBy("part").parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def _written_live(rows: DataFrame, where: str, start) -> None:
    """Write the rows' lines part by part, while a stream that ``start`` begins follows them; it is stopped halfway and
    begun again from its checkpoint. A run's part is one file, which appears as a whole: the stream must not meet
    later epochs of a run before earlier ones."""
    running: StreamingQuery | None = None
    for k in range(PARTS):
        if k == PARTS // 2 and running:
            running.stop()
            running = None
        part = rows.filter(F.col("part") == k).select("run", "epoch", sinks.validation_line().alias("value"))  # in all tasks, not a run's one
        part = part.repartition(rows.sparkSession.sparkContext.defaultParallelism, "run").sortWithinPartitions("run", "epoch")
        part.select("run", "value").write.mode("append").partitionBy("run").text(where)
        running = running or start()
        running.processAllAvailable()
    running.stop()


@query("SELECT CAST(event_id AS INT) AS epoch, round(value, 4) AS veer, round(round(value, 4) / 10, 5) AS min_dcf FROM events")
def live_log_ingest(spark, sf_dir):
    """Log lines are tailed while they are written, and appended to another log once each, though a batch comes twice."""
    rows = _log_records(spark, sf_dir).withColumn("epoch", F.col("event_id"))
    source, log, state = (folder(spark, x) for x in ("source", "log", "state"))
    taken: list[tuple[int, bool]] = []

    def take(found: DataFrame, batch_id: int) -> None:
        sinks.append_once(found, batch_id, log, sinks.validation_line())
        taken.append((batch_id, sinks.append_once(found, batch_id, log, sinks.validation_line())))

    def start() -> StreamingQuery:
        lines = monitor.live_log(spark, source).filter("kind = 'validation'")
        return lines.writeStream.foreachBatch(take).option("checkpointLocation", state).start()

    _written_live(rows, source, start)
    if len(taken) < PARTS or any(again for _, again in taken):
        raise AssertionError(f"batches and whether their replay appended: {taken}")
    return logs.parse_log(lists.numbered_lines(spark, log)).select("epoch", "veer", "min_dcf")


_LIVE = _BEST.replace("user_id AS run", "user_id % 4 AS run").replace("PARTITION BY user_id", "PARTITION BY user_id % 4").replace("value AS veer", "round(value, 4) AS veer")


@query(
    f"""WITH {_LIVE}, z AS (SELECT run, min(epoch) AS stop_at FROM s WHERE since >= 200 GROUP BY run)
 SELECT s.run, s.epoch AS seq, CASE WHEN improved THEN 'improved' ELSE 'stopped' END AS event, least(veer, coalesce(best, veer)) AS best FROM s LEFT JOIN z USING (run) WHERE (improved AND (stop_at IS NULL OR epoch < stop_at)) OR epoch = stop_at"""
)
def live_best_monitor(spark, sf_dir):
    """Best values and stops of runs whose logs grow in ten steps; the state outlives a restart."""
    rows, own = _log_records(spark, sf_dir), monitor.state_session(spark, few_keys=True)
    source, out, state = (folder(spark, x) for x in ("source", "events", "state"))

    def start() -> StreamingQuery:
        lines = monitor.live_log(own, source).filter("kind = 'validation'")
        numbered = lines.select(F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run"), F.col("epoch").cast("long").alias("seq"), F.col("veer").alias("value"))
        return monitor.monitored(numbered, 200).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()

    _written_live(rows, source, start)
    return spark.read.parquet(out)


@query(
    """WITH e AS (SELECT user_id % 4 AS run, round(value, 4) AS veer, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS epoch FROM events), b AS (SELECT run, min(veer) AS veer FROM e GROUP BY run)
 SELECT run, 'eer' AS kind, CAST(printf('%.4f', veer) AS DOUBLE) AS value FROM b UNION ALL SELECT run, 'threshold', CAST(printf('%f', round(veer / 2, 6)) AS DOUBLE) FROM b"""
)
def best_sidecars(spark, sf_dir):
    """Both sidecars of every run, written twice: the second time replaces the first."""
    rows, where = _log_records(spark, sf_dir), folder(spark, "sidecars")
    for records in (rows.filter(F.col("part") < PARTS // 2), rows):
        sinks.write_best(records, "run", "veer", "threshold", where)
    found = lists.sidecar_values(spark, where)
    return found.select(F.regexp_extract("path", r"run=(\d+)", 1).cast("long").alias("run"), F.regexp_extract("path", r"kind=(\w+)", 1).alias("kind"), "value")


@query(f"WITH {_E} SELECT vec_id, start, round(list_sum(v[start + 1:start + 16]), 6) AS total FROM e, range(0, 48, 12) r(start)")
def segment_files(spark, sf_dir):
    where = folder(spark, "segments")
    sinks.write_segments(embeddings(spark, sf_dir).select("vec_id", "embedding"), "embedding", where, 16, 12)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(where).select("vec_id", "start", rounded(total).alias("total"))


# ---- audio files ------------------------------------------------------------------------------------------------


def _wave_bytes(samples: np.ndarray, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(16_000)
        w.writeframes((samples * 8_000).astype("<i2" if width == 2 else "u1").tobytes())
    return out.getvalue()


def _sound_files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file for each vector: sound WAV files, and by id one of each kind of damage and other formats."""
    for b in batches:
        rows = []
        for i, v in zip(b["vec_id"], b["embedding"], strict=True):
            sound = _wave_bytes(np.abs(v))
            flac = b"fLaC\x80\x00\x00\x22" + bytes(10) + ((16_000 << 44) + 64).to_bytes(8, "big") + bytes(16)
            made = {
                0: (sound[:-10], "wav"), 1: (sound, "WAV"), 2: (b"no audio", "flac"), 3: (flac, "FLAC"), 4: (b"\x00\x00\x00\x20ftypM4A ", "m4a"),
                5: (b"", "aac"), 6: (_wave_bytes(np.abs(v), 1), "wav"), 7: (sound[:20], "wav"), 8: (b"text", "txt"),
            }.get(i % 10, (sound, "wav"))
            rows.append((f"id{i % 3}/k{i % 7}/{i}.{made[1]}", made[0]))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query(
    """WITH f AS (SELECT vec_id, vec_id % 10 AS d FROM embeddings WHERE vec_id % 10 <> 8)
 SELECT vec_id, CASE WHEN d IN (2, 5) THEN NULL WHEN d = 3 THEN 'flac' WHEN d = 4 THEN 'mp4' ELSE 'wav' END AS format, d IN (1, 3, 9) AS ok,
  CASE d WHEN 0 THEN 'truncated' WHEN 2 THEN 'unknown' WHEN 4 THEN 'no decoder' WHEN 5 THEN 'empty' WHEN 6 THEN 'width' WHEN 7 THEN 'header' END AS kind, CAST(CASE WHEN d IN (1, 3, 9) THEN 64 END AS BIGINT) AS n_samples FROM f"""
)
def integrity_report(spark, sf_dir):
    where = folder(spark, "sounds")
    audio_files.write_files(table(spark, sf_dir, "embeddings").mapInPandas(_sound_files, "path string, content binary"), where)
    found = audio_files.integrity_scan(spark, where)
    return found.select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("long").alias("vec_id"), "format", "ok", "kind", "n_samples")


# ---- samples ----------------------------------------------------------------------------------------------------

_DB = "10 * log10(list_dot_product({0}, {0}) / len({0}) + 1e-4)"


@query(
    f"""WITH {_E} SELECT vec_id, round({_DB.format("v")}, 6) AS db, 71 AS n_padded, round(v[7], 6) AS last_padded, round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) AS unit_total,
  round(v[1] - 0.97 * v[2], 6) AS first_emphasised, round(list_sum(v) - 0.97 * (list_sum(v) - v[64] + v[2]), 6) AS total_emphasised, round(2595 * log10(1 + abs(v[1]) * 8000 / 700), 6) AS mel,
  round(abs(v[1]) * 8000, 6) AS hz, vec_id - vec_id % 7 AS down, vec_id * 160 + 240 AS samples FROM e"""
)
def signal_functions(spark, sf_dir):
    x, hz = F.col("embedding"), F.abs(F.col("embedding")[0].cast("double")) * 8000
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double"))
    doubles = F.transform(x, lambda v: v.cast("double"))
    padded, emphasised = scalars.wrap_pad(x, 70), scalars.pre_emphasis(doubles)
    return embeddings(spark, sf_dir).select(
        "vec_id", rounded(scalars.level_db(x)).alias("db"), F.size(padded).alias("n_padded"), rounded(F.element_at(padded, -1).cast("double")).alias("last_padded"),
        rounded(total(scalars.unit_energy(x))).alias("unit_total"), rounded(emphasised[0]).alias("first_emphasised"), rounded(total(emphasised)).alias("total_emphasised"),
        rounded(scalars.hz_to_mel(hz)).alias("mel"), rounded(scalars.mel_to_hz(scalars.hz_to_mel(hz))).alias("hz"),
        scalars.round_down(F.col("vec_id"), 7).alias("down"), scalars.frames_to_samples(F.col("vec_id")).alias("samples"),
    )


def _long(df: DataFrame, column: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), (rounded("x") + F.lit(0.0)).alias("value"))  # no -0.0


@query(
    f"""WITH {_E}, g AS (SELECT a.vec_id, b.v, sqrt(pow(10, ({_DB.format("a.v")} - {_DB.format("b.v")} - 5 * k) / 10)) AS gain FROM e a JOIN range(1, 4) r(k) ON true JOIN e b ON b.vec_id = a.vec_id + k),
 y AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, gain * unnest(v) AS y FROM g), x AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e)
 SELECT vec_id, pos, round(any_value(x) + coalesce(sum(y), 0), 6) + CAST(0 AS DOUBLE) AS value FROM x LEFT JOIN y USING (vec_id, pos) GROUP BY vec_id, pos"""
)
def noise_mix(spark, sf_dir):
    """Every clip with the next three clips as noises of 5, 10 and 15 dB."""
    clips = embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("samples"))
    plan = clips.select("vec_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("noise_no"))
    plan = plan.select("vec_id", "noise_no", (F.col("vec_id") + F.col("noise_no")).cast("string").alias("path"), (F.col("noise_no") * 5.0).alias("snr_db"))
    noises = clips.select(F.col("vec_id").cast("string").alias("path"), "samples")
    return _long(audio.mix_noises(clips, plan, noises, "vec_id"), "mixed")


@query(
    f"""WITH {_E}, h AS (SELECT vec_id - 1 AS vec_id, generate_subscripts(v[1:8], 1) - 1 AS k, unnest(v[1:8]) / sqrt(list_dot_product(v[1:8], v[1:8])) AS h FROM e), x AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e)
 SELECT vec_id, pos + k AS pos, round(sum(x * h), 6) + CAST(0 AS DOUBLE) AS value FROM x JOIN h USING (vec_id) WHERE pos + k < 64 GROUP BY 1, 2"""
)
def reverb_mix(spark, sf_dir):
    """Every clip with the next clip's first samples as its response."""
    clips = embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    responses = clips.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("samples", 1, 8).alias("response"))
    return _long(audio.apply_reverb(clips.join(responses, "vec_id"), "samples", "response"), "reverbed")


@query(
    f"""WITH {_E}, s AS (SELECT vec_id, f, i, v[(CASE WHEN 4 * f + i - 8 < 0 THEN 8 - 4 * f - i WHEN 4 * f + i - 8 > 63 THEN 134 - 4 * f - i ELSE 4 * f + i - 8 END) + 1] * (0.54 - 0.46 * cos(2 * pi() * (i - 3) / 10)) AS x
  FROM e, range(17) a(f), range(3, 13) b(i)),
 p AS (SELECT vec_id, f, j, pow(sum(x * cos(2 * pi() * i * j / 16)), 2) + pow(sum(x * sin(2 * pi() * i * j / 16)), 2) AS power FROM s, range(9) c(j) GROUP BY ALL),
 d AS (SELECT k, 700 * (pow(10, 2595 * log10(1 + 8000 / 700) * k / 5 / 2595) - 1) AS hz FROM range(6) k(k)),
 w AS (SELECT a.k AS band, j, greatest(0, least((1000 * j - a.hz) / (b.hz - a.hz), (c.hz - 1000 * j) / (c.hz - b.hz))) AS w FROM d a JOIN d b ON b.k = a.k + 1 JOIN d c ON c.k = a.k + 2, range(9) j(j))
 SELECT vec_id, CAST(f AS INT) AS frame, CAST(band AS INT) AS band, round(ln(sum(w * power) + 1e-6), 5) AS value FROM p JOIN w USING (j) GROUP BY vec_id, f, band"""
)
def log_mel(spark, sf_dir):
    frames = audio.log_mel_frames(embeddings(spark, sf_dir), "vec_id", "embedding", n_mels=4, n_fft=16, window=10, hop=4)
    return frames.select("vec_id", "frame", F.posexplode("mel").alias("band", "x")).select("vec_id", "frame", "band", F.round("x", 5).alias("value"))


@query(f"WITH {_E}, x AS (SELECT label, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM e) SELECT label, pos, round(avg(x), 6) AS value FROM x GROUP BY label, pos")
def vector_mean_aggregate(spark, sf_dir):
    audio.register_functions(spark)
    means = spark.sql("SELECT label, vector_mean(embedding) AS m FROM {e} GROUP BY label", e=embeddings(spark, sf_dir))
    return means.select("label", F.posexplode("m").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), rounded("x").alias("value"))


@query(ORACLES["eval_crops"])
def crop_table_function(spark, sf_dir):
    audio.register_functions(spark)
    clips = catalogue._clips(spark, sf_dir)
    return spark.sql("SELECT doc_id, CAST(c.crop_id AS BIGINT) AS crop_id, c.start FROM {clips}, LATERAL crops(n, 300, 10) c", clips=clips)


# ---- losses by name, normalisation, counts ----------------------------------------------------------------------

_NAMED = {"softmax": "softmax_loss", "amsoftmax": "am_loss", "aamsoftmax": "aam_loss", "proto": "proto_loss", "angleproto": "angleproto_loss", "ge2e": "ge2e_loss", "triplet": "triplet_hinge"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, loss FROM ({ORACLES[own]})" for name, own in _NAMED.items()))
def losses_by_name(spark, sf_dir):
    classes, tuples = catalogue._classes(spark, sf_dir), batch(spark, sf_dir)
    made = [losses.class_losses[n](*classes) for n in losses.class_losses.names()] + [losses.batch_losses[n](tuples) for n in losses.batch_losses.names()]
    named = zip([*losses.class_losses.names(), *losses.batch_losses.names()], made, strict=True)
    out = [df.select(F.lit(n).alias("name"), F.round("loss", 5).alias("loss")) for n, df in named]
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


@query(
    f"""WITH {_E}, h AS (SELECT a.vec_id AS side, -list_distance(a.v, b.v) AS s FROM e a, e b), g AS (SELECT side, avg(s) AS mu, stddev_pop(s) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY s DESC) AS r FROM h) WHERE r <= 200 GROUP BY side),
 t AS (SELECT a.vec_id AS ref, b.vec_id AS com, round(-list_distance(a.v, b.v), 6) AS score FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + {catalogue.REACH})
 SELECT ref, com, round(((score - x.mu) / (x.sd + 1e-6) + (score - y.mu) / (y.sd + 1e-6)) / 2, 4) AS norm_score FROM t JOIN g x ON ref = x.side JOIN g y ON com = y.side"""
)
def snorm_cohort(spark, sf_dir):
    """Every trial, normalised by each side's 200 best among all vectors."""
    e = embeddings(spark, sf_dir)
    found = cohort.top_statistics(e.select(F.col("vec_id").alias("side"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("cohort_id"), F.col("embedding").alias("v")), 200)
    return catalogue.normalized_trials(e, materialize(found))


@query(f"WITH {_G}, u AS (SELECT DISTINCT speaker, group_no FROM g), n AS (SELECT group_no AS round, count(*) AS n_tuples FROM u GROUP BY 1) SELECT round, n_tuples, n_tuples // 4 AS n_batches, n_tuples - n_tuples % 4 AS n_kept, n_tuples % 4 AS n_dropped FROM n")
def batch_counts(spark, sf_dir):
    groups = prepare.capped_groups(catalogue._manifest(spark, sf_dir), "speaker", "doc_id", 7, 20, 3).select("speaker", "group_no").distinct()
    return prepare.batch_counts(groups, 4)


@query(
    f"""WITH d AS (WITH {_E} SELECT avg(1 - list_dot_product(v, list_reverse(v)) / greatest(list_dot_product(v, v), 1e-12)) AS d FROM e),
 c AS (WITH {_C}, s AS (SELECT row_id, dot AS score, is_target FROM s0) {_CE.replace("round(avg(top + ln(z) - own), 5)", "avg(top + ln(z) - own)").format(key="row_id")}) SELECT round(0.3 * loss + 0.7 * d, 5) AS loss FROM c, d"""
)
def blended_loss(spark, sf_dir):
    e = embeddings(spark, sf_dir).select(F.col("vec_id").alias("utt"), "embedding")
    distance = losses.distillation(e, e.withColumn("embedding", F.reverse("embedding")), "cosine").select("distance")
    both = losses.class_losses["softmax"](*catalogue._classes(spark, sf_dir)).select("loss").crossJoin(distance)  # one-row tables
    return both.select(F.round(losses.blended(F.col("loss"), F.col("distance"), 0.7), 5).alias("loss"))
