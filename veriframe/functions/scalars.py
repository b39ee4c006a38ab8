"""Scalar expressions: rounding, paths, levels, seeded choices, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_down(n: Column, d: int | Column) -> Column:
    """Largest multiple of ``d`` up to ``n``."""
    return n - F.pmod(n, d if isinstance(d, Column) else F.lit(d))


def frames_to_samples(frames: Column) -> Column:
    """Samples that so many 10 ms frames with a 25 ms window span at 16 kHz."""
    return frames * 160 + 240


def level_db(samples: Column) -> Column:
    energy = F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return 10 * F.log10(F.try_divide(energy, F.size(samples)) + 1e-4)


def noise_gain(clean_db: Column, noise_db: Column, snr_db: Column) -> Column:
    return F.sqrt(F.pow(F.lit(10.0), (clean_db - noise_db - snr_db) / 10))


def wrap_pad(samples: Column, length: Column | int) -> Column:
    """Clips up to ``length`` long are repeated to ``length + 1`` samples; longer and empty ones stay."""
    n = F.size(samples)
    size = length if isinstance(length, Column) else F.lit(length)
    padded = F.transform(F.sequence(F.lit(0), size), lambda i: F.get(samples, F.pmod(i, n)))
    return F.when((n > 0) & (n <= size), padded).otherwise(samples)


def mixed(a: Column, b: Column, gain: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + gain * F.coalesce(y, F.lit(0.0)))


def unit_energy(samples: Column) -> Column:
    energy = F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.element_at(F.transform(F.array(F.sqrt(energy)), lambda e: F.transform(samples, lambda x: F.try_divide(x.cast("double"), e))), 1)


def pre_emphasis(samples: Column, coef: float = 0.97) -> Column:
    """y[t] = x[t] - coef * x[t - 1]; the first sample is reflected, so it uses x[1]."""
    return F.transform(samples, lambda x, i: x - coef * F.coalesce(F.get(samples, F.when(i == 0, 1).otherwise(i - 1)), x))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def decayed_rate(rate: float | Column, gamma: float, step: int, epoch: Column) -> Column:
    """Step decay: multiplied by ``gamma`` after every ``step`` epochs, counted from 1."""
    return rate * F.pow(F.lit(float(gamma)), F.floor((epoch - 1) / step))


def detection_cost(fnr: Column, fpr: Column, p_target: float, c_miss: float, c_fa: float) -> Column:
    return c_miss * fnr * p_target + c_fa * fpr * (1 - p_target)


def seeded_key(seed: int, *key: Column) -> Column:
    """Shuffle key that any engine reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def seeded_int(seed: int, *key: Column) -> Column:
    """Integer in [0, 2**32) from the key's hash."""
    return F.conv(F.substring(seeded_key(seed, *key), 1, 8), 16, 10).cast("long")


def seeded_uniform(seed: int, *key: Column) -> Column:
    return seeded_int(seed, *key) / F.lit(4294967296.0)


def speaker_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return out


def to_wav(path: Column) -> Column:
    return F.regexp_replace(path, r"\.m4a$", ".wav")


def rearranged(path: Column) -> Column:
    """``id/key/utt.wav`` to ``id/utt_key.wav``; other shapes stay."""
    return F.regexp_replace(path, r"^([^/]+)/([^/]+)/([^/.]+)\.wav$", "$1/$3_$2.wav")


def trial_key(ref: Column, com: Column) -> Column:
    return F.concat_ws(" ", ref.cast("string"), com.cast("string"))


def is_positive(label: Column) -> Column:
    """Label tokens: '1' is positive, every other token negative."""
    return F.when(label == "1", 1).otherwise(0)
