"""Audio sources: PCM decode with a status, and the integrity scan over all audio files of a folder.

A file's format is told by its first bytes, its extension only says that it is meant to be audio (any case). WAV with
16-bit PCM is decoded; FLAC's stream header is checked; AAC and MP4 are recognised. Every file is a row with a status:
``kind`` is null for a sound file, else one of KINDS."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sample_rate int, n_samples long, samples array<float>, ok boolean, error string"
SCAN = "path string, format string, ok boolean, kind string, error string, sample_rate int, n_samples long"
EXTENSIONS = ("wav", "flac", "m4a", "aac")
#: What can be wrong: no bytes, no known format, a damaged header, missing samples, samples of another width, no decoder.
KINDS = ("empty", "unknown", "header", "truncated", "width", "no decoder")
#: Frames that are decoded at once.
CHUNK = 1 << 16


class Unsound(ValueError):
    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def _glob(extensions: tuple[str, ...]) -> str:
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def audio_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content) of all files below the root with one of the extensions, in any case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(extensions)).load(root).select("path", "content")


def format_of(content: bytes) -> str | None:
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        return "wav"
    if content[:4] == b"fLaC":
        return "flac"
    if content[4:8] == b"ftyp":
        return "mp4"
    return "aac" if len(content) > 1 and content[0] == 0xFF and content[1] & 0xF6 == 0xF0 else None


def wave_chunks(content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Sample rate and mono samples in [-1, 1) of 16-bit PCM, CHUNK frames at a time; raises ``Unsound``."""
    try:
        w = wave.open(io.BytesIO(content))
    except (wave.Error, EOFError) as e:
        raise Unsound("header", f"{type(e).__name__}: {e}") from e
    with w:
        if w.getsampwidth() != 2:
            raise Unsound("width", f"{8 * w.getsampwidth()}-bit samples")
        wanted, channels, rate = w.getnframes(), w.getnchannels(), w.getframerate()
        yield rate, np.zeros(0, dtype=np.float32)
        while wanted > 0:
            raw = w.readframes(min(CHUNK, wanted))
            if len(raw) != min(CHUNK, wanted) * 2 * channels:
                raise Unsound("truncated", f"{wanted} frames or part of them are missing")
            wanted -= CHUNK
            yield rate, (np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768).reshape(-1, channels).mean(axis=1)


def decode_wave(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1) of 16-bit PCM."""
    parts = list(wave_chunks(content))
    return parts[0][0], np.concatenate([x for _, x in parts])


def flac_header(content: bytes) -> tuple[int, int]:
    """Sample rate and samples of a FLAC stream by its first block."""
    if len(content) < 42 or content[4] & 0x7F != 0 or int.from_bytes(content[5:8], "big") != 34:
        raise Unsound("header", "no stream information")
    packed = int.from_bytes(content[18:26], "big")
    if not packed >> 44:
        raise Unsound("header", "a sample rate of 0")
    return packed >> 44, packed & ((1 << 36) - 1)


def status_of(content: bytes) -> tuple[str | None, bool, str | None, str | None, int | None, int | None]:
    """format, ok, kind, error, sample rate and number of samples of a file's bytes."""
    name = format_of(content)
    try:
        if not content:
            raise Unsound("empty", "no bytes")
        if name == "wav":
            rate, n = 0, 0
            for rate, x in wave_chunks(content):  # noqa: B007
                n += len(x)
            return name, True, None, None, rate, n
        if name == "flac":
            return name, True, None, None, *flac_header(content)
        raise Unsound("no decoder" if name else "unknown", f"no decoder for {name}" if name else f"begins with {content[:4].hex()}")
    except Unsound as e:
        return name, False, e.kind, str(e), None, None


def _decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                rate, x = decode_wave(bytes(content))
                rows.append((path, rate, len(x), x.tolist(), True, None))
            except Exception as e:  # noqa: BLE001  the status column tells
                rows.append((path, None, None, None, False, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "sample_rate", "n_samples", "samples", "ok", "error"])


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(path, *status_of(bytes(content))) for path, content in zip(batch["path"], batch["content"], strict=True)]
        made = pd.DataFrame(rows, columns=["path", "format", "ok", "kind", "error", "sample_rate", "n_samples"])
        yield made.astype({"sample_rate": "Int32", "n_samples": "Int64"})


def read_audio(spark: SparkSession, root: str) -> DataFrame:
    """Decoded samples of the WAV files below the root."""
    return audio_files(spark, root, ("wav",)).mapInPandas(_decode, SCHEMA)


def scan(files: DataFrame) -> DataFrame:
    """The status of files (path, content); each is read once, and no samples are kept."""
    return files.mapInPandas(_scan, SCAN)


def integrity_scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """A row for every audio file below the root. Spark's readers pass over files without bytes, so these are found in
    the reader's own list of files, which the driver holds anyway."""
    files = audio_files(spark, root, extensions)
    found = scan(files)
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string")
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # noqa: E731  the list and the rows write local paths differently
    read = found.select(bare("path").alias("_bare"))
    none = [F.lit(v).cast(k).alias(n) for n, k, v in (("format", "string", None), ("ok", "boolean", False), ("kind", "string", "empty"), ("error", "string", "no bytes"), ("sample_rate", "int", None), ("n_samples", "long", None))]
    empty = listed.join(read, bare("path") == F.col("_bare"), "left_anti").select("path", *none)
    return found.unionByName(empty)


def corrupted_files(scanned: DataFrame) -> DataFrame:
    """(path, kind, error) of all files that are not sound."""
    return scanned.filter(~F.col("ok")).select("path", "kind", "error")


def corruption_summary(scanned: DataFrame) -> DataFrame:
    return scanned.agg(F.count("*").alias("n_files"), F.count_if(~F.col("ok")).alias("n_corrupt"))


def corruption_by_kind(scanned: DataFrame) -> DataFrame:
    """(kind, n_files, first_path, error): of each kind of damage the number of files, and the first with its error."""
    first = F.min(F.struct("path", "error")).alias("f")
    return corrupted_files(scanned).groupBy("kind").agg(F.count("*").alias("n_files"), first).select("kind", "n_files", F.col("f.path").alias("first_path"), "f.error")


def write_files(files: DataFrame, root: str) -> int:
    """Write rows (path below the root, content) as files, from the tasks; returns their number."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from veriframe.sources.line_files import file_system

        system, base = file_system(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = f"{base.rstrip('/')}/{path}"
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
