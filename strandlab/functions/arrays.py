"""Array column functions over series held as ``array<double>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; inside a lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), 0)


def total(c: str | Column) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def absolute_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def flatten_nested(c: str | Column, depth: int = 2) -> Column:
    """Flatten arrays nested ``depth`` levels into one level."""
    out = _col(c)
    for _ in range(depth - 1):
        out = F.flatten(out)
    return out


def tuples_to_matrix(c: str | Column, fields: list[str]) -> Column:
    """Array of structs to array of arrays."""
    return F.transform(_col(c), lambda s: F.array(*[s[f].cast("double") for f in fields]))


def series_length(c: str | Column) -> Column:
    return F.size(_col(c)).cast("bigint")


def expand_steps(c: str | Column) -> Column:
    """Series of numbers to a one-channel series: ``[x, y]`` to ``[[x], [y]]``."""
    return F.transform(_col(c), lambda x: F.array(x))


def cast_series(c: str | Column, dtype: str) -> Column:
    types = {"float": "float", "double": "double", "int": "int", "long": "bigint"}
    if dtype not in types:
        raise ValueError(f"unknown dtype: {dtype}")
    return _col(c).cast(f"array<{types[dtype]}>")


def as_panel(c: str | Column, data_type: str) -> Column:
    """One series to one-channel panel form ``[channel][t]``; panel input passes through."""
    kind = data_type.replace(" ", "").lower()
    if kind == "array<double>":
        return F.array(_col(c))
    if kind == "array<array<double>>":
        return _col(c)
    raise ValueError(f"unsupported series type: {data_type}")


def reverse_time(c: str | Column) -> Column:
    return F.reverse(_col(c))


def last_state(c: str | Column) -> Column:
    return F.element_at(_col(c), -1)


def l2_normalise(c: str | Column, eps: float = 1e-12) -> Column:
    length = F.greatest(F.sqrt(dot(c, c)), F.lit(eps))
    return let(length, lambda n: F.transform(_col(c), lambda x: x / n))


def log_softmax(c: str | Column) -> Column:
    log_sum = lambda v, top: F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    shifted = lambda v, top: let(log_sum(v, top), lambda ls: F.transform(v, lambda x: x - top - ls))
    return let(_col(c), lambda v: let(F.array_max(v), lambda top: shifted(v, top)))


def soft_cross_entropy(logits: str | Column, targets: str | Column) -> Column:
    return -dot(targets, log_softmax(logits))


def impute(c: str | Column, value: float = 0.0) -> Column:
    """Replace null and NaN by a constant."""
    return F.transform(_col(c), lambda x: F.coalesce(F.nanvl(x, F.lit(value)), F.lit(value)))


def has_missing(c: str | Column) -> Column:
    return _col(c).isNull() | F.coalesce(F.exists(_col(c), lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def mix(a: str | Column, b: str | Column, share: str | Column) -> Column:
    """``share * a + (1 - share) * b`` step by step."""
    s = _col(share)
    return F.zip_with(_col(a), _col(b), lambda x, y: s * x + (F.lit(1.0) - s) * y)
