"""Dense-vector helpers on ``array<float|double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def window_offsets(dim: int, window: int, stride: int) -> list[int]:
    if window > dim:
        raise ValueError(f"window {window} is wider than the {dim} available dimensions")
    return list(range(0, dim, stride))


def wrapped_slice(vec: Column, offset: Column, window: int) -> Column:
    """``window`` entries from ``offset`` on, continuing at the front past the end."""
    overflow = F.greatest(offset + F.lit(window) - F.size(vec), F.lit(0))
    return F.concat(F.slice(vec, offset + 1, F.lit(window)), F.slice(vec, F.lit(1), overflow))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when ``body`` repeats it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps), gain 1 and bias 0."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def centred(x: Column) -> Column:
        return bind(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))

    def scaled(c: Column) -> Column:
        variance = F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.size(c)
        return bind(F.sqrt(variance + F.lit(eps)), lambda sd: F.transform(c, lambda v: v / sd))

    return bind(as_double(vec), lambda x: bind(centred(x), scaled))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda a, v: a + v * v))
