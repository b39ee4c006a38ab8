"""Vector expressions over ``array<float>`` or ``array<double>`` columns.

With ``dim`` the sums are written out element by element, which stays inside generated code; without it, array
functions are used for vectors of any length. Sums are in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _at(v: Column, k: int) -> Column:
    return v[k].cast("double")


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim:
        return _sum([_at(a, k) * _at(b, k) for k in range(dim)])
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column, dim: int | None = None, eps: float = 0.0) -> Column:
    """Sum of squared differences; ``eps`` is added to each difference first."""
    if dim:
        return _sum([F.pow(_at(a, k) - _at(b, k) + eps, 2) if eps else (_at(a, k) - _at(b, k)) * (_at(a, k) - _at(b, k)) for k in range(dim)])
    both = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double") + eps, 2))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(squared_distance(a, b, dim))


def norm(v: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(v, v, dim))


def normalized(v: Column, floor: float = 1e-12) -> Column:
    """Unit-length vector; the divisor is at least ``floor``."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column, b: Column, dim: int | None = None, floor: float = 1e-12) -> Column:
    return dot(a, b, dim) / F.greatest(norm(a, dim) * norm(b, dim), F.lit(floor))


def log_softmax(v: Column, temperature: float = 1.0) -> Column:
    """Max-shifted log-softmax of ``v / temperature``."""
    scaled = F.transform(v, lambda x: x.cast("double") / temperature)

    def of(s: Column) -> Column:
        total = F.aggregate(F.transform(s, lambda x: F.exp(x - F.array_max(s))), F.lit(0.0), lambda t, x: t + x)
        return F.element_at(F.transform(F.array(F.log(total) + F.array_max(s)), lambda z: F.transform(s, lambda x: x - z)), 1)

    return F.element_at(F.transform(F.array(scaled), of), 1)


def kl_divergence(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """KL(teacher || student) of the softened distributions, times the squared temperature."""
    pairs = F.zip_with(log_softmax(teacher, temperature), log_softmax(student, temperature), lambda t, s: F.exp(t) * (t - s))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) * (temperature**2)


def margin_logit(cos: Column, is_target: Column, scale: float, margin: float, kind: str = "aam", easy: bool = False) -> Column:
    """Scaled class logit. ``am`` subtracts the margin from the target's cosine; ``aam`` adds it to the angle, with
    the linear continuation beyond pi - margin (or, with ``easy``, only where the cosine is positive)."""
    import math

    if kind == "softmax":
        return cos * scale
    if kind == "am":
        return scale * (cos - F.when(is_target, F.lit(margin)).otherwise(0.0))
    sine = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos))
    turned = cos * math.cos(margin) - sine * math.sin(margin)
    if easy:
        turned = F.when(cos > 0, turned).otherwise(cos)
    else:
        turned = F.when(cos > math.cos(math.pi - margin), turned).otherwise(cos - math.sin(math.pi - margin) * margin)
    return scale * F.when(is_target, turned).otherwise(cos)
