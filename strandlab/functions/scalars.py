"""Scalar column functions: powers of two, sizes, names, the coefficient schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | int | float | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def closest_power_of_2(m: str | Column, v: str | int | float | Column) -> Column:
    """Power of two closest to ``m / v``; ties go up. Fails when ``v = 0`` or ``m / v <= 0``."""
    divisor = _col(v).cast("double")
    ratio = _col(m).cast("double") / F.when(divisor != 0, divisor)
    guess = F.pow(F.lit(2.0), F.floor(F.log2(ratio)))
    # log2 may be off by one unit in the last place next to an exact power
    low = F.when(guess > ratio, guess / 2).when(guess * 2 <= ratio, guess * 2).otherwise(guess)
    nearest = F.when((low == ratio) | (ratio - low < low * 2 - ratio), low).otherwise(low * 2)
    return (
        F.when(divisor == 0, F.raise_error(F.lit("the divisor must not be zero")).cast("double"))
        .when(ratio <= 0, F.raise_error(F.lit("the ratio must be positive")).cast("double"))
        .otherwise(nearest)
    )


def representation_size(series: str | Column, compression: int = 2) -> Column:
    """Length of the representation of a series: closest power of two to length / compression."""
    return closest_power_of_2(F.size(_col(series)), compression).cast("bigint")


def prefixed(base: str | Column, prefix: str | Column | None) -> Column:
    """``prefix_base``; just ``base`` when the prefix is empty or null."""
    if prefix is None:
        return _col(base)
    return F.concat_ws("_", F.nullif(_col(prefix), F.lit("")), _col(base))


def hint_coefficient(
    epoch: str | Column,
    total_epochs: int,
    final: float = 0.5,
    start: float = 0.0,
    rate: float = 1.0,
    start_epoch: int = 0,
    mode: str = "train",
    valid_value: float = 0.0,
) -> Column:
    """Weight of the hint loss in an epoch: 0 before ``start_epoch``, then a power ramp to ``final``."""
    if mode == "valid":
        return F.lit(float(valid_value))
    if mode != "train":
        raise ValueError(f"unknown mode: {mode}")
    done = (_col(epoch) - F.lit(start_epoch)).cast("double") / float(total_epochs - start_epoch)
    # greatest() keeps the power defined for the epochs the first branch covers
    ramp = F.lit(start) + F.lit(final - start) * F.pow(F.greatest(done, F.lit(0.0)), F.lit(float(rate)))
    return F.when(_col(epoch) < start_epoch, F.lit(0.0)).otherwise(ramp)


def total_loss(own: str | Column, hint: str | Column, coefficient: str | float | Column) -> Column:
    """Own loss and hint loss mixed by the weight of the hint."""
    weight = _col(coefficient)
    return (1 - weight) * _col(own) + weight * _col(hint)


def two_decimals(c: str | Column) -> Column:
    """Text with two decimals. ``format_string('%.2f')`` rounds some ties the other way."""
    return F.call_function("format_number", _col(c), F.lit("0.00"))


def mean_std_text(mean: str | Column, std: str | Column) -> Column:
    return F.concat(two_decimals(mean), F.lit(" ± "), two_decimals(std))
