"""Join of rows with a small table of settings per data set.

A plain join on the data set name sends a hot data set to one task, and an
aggregate on the same name right after it keeps Spark from splitting that task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.session import materialise

BROADCAST_BYTES = 32 << 20


def join_small(
    df: DataFrame,
    small: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    numbers: Column | None = None,
    row_key: str | Sequence[str] = "series_id",
    written: bool = False,
) -> DataFrame:
    """Join ``df`` with ``small``, which has at most one row per key.

    ``small`` is written first and its size counted (``numbers`` is the count
    of numbers in a row). Up to ``BROADCAST_BYTES`` it is broadcast. Beyond
    that it is copied to as many salts as there are shuffle partitions, so that
    every group of ``df`` is spread over all of them by ``row_key``. A table
    that was materialised before is passed as ``written``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not written:
        small = materialise(small, "small-side")
    width = F.lit(len(small.columns)) if numbers is None else numbers + len(small.columns)
    size = (small.agg(F.sum(width).alias("n")).first()["n"] or 0) * 16
    if size <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), keys, how)
    salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row_keys = [row_key] if isinstance(row_key, str) else list(row_key)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*row_keys), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def without_rows(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys``, which name single rows, are not in ``ids``.

    ``ids`` is written and counted: up to ``BROADCAST_BYTES`` it is broadcast, beyond that both sides shuffle on the keys. Since
    these name single rows, no key is hot and no row is copied.
    """
    ids = materialise(ids.select(*keys), "row-ids")
    small = ids.count() * 16 * len(keys) <= BROADCAST_BYTES
    return df.join(F.broadcast(ids) if small else ids, list(keys), "left_anti")
