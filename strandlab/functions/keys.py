"""Seeded order keys and uniform numbers that depend on row identity only.

``rand(seed)`` changes with the partitioning; an md5 of seed and key does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
HEX_RANGE = float(2 ** (4 * HEX_DIGITS))


def order_key(seed: int | str | Column, *cols: str | Column) -> Column:
    """Hex text that orders rows at random: md5 of ``seed-col1-col2-...``."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("-", head.cast("string"), *[p.cast("string") for p in parts]))


def key_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Leading digits of an order key: equal-sized buckets that keep the key order."""
    return F.substring(key, 1, hex_digits)


def unit_uniform(key: Column) -> Column:
    """Uniform number in (0, 1) from an order key."""
    return (F.conv(F.substring(key, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / HEX_RANGE
