"""Incremental min-max fit: the ranges of a channel grow as arrays arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def streamed_ranges(stream: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Running least and greatest value per key; state is two numbers per key."""
    return stream.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def fit_available(ranges: DataFrame, folder: str, name: str = "ranges") -> StreamingQuery:
    """Fit on everything that has arrived and stop. Every batch rewrites its version of the fit in ``folder``.

    A batch that is repeated after a failure overwrites its own version, so
    the newest version always equals the batch fit.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/version={number}")

    return (
        ranges.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/{name}-state")
        .trigger(availableNow=True)
        .start()
    )


def newest_fit(spark, folder: str, name: str = "ranges") -> DataFrame:
    versions = spark.read.parquet(f"{folder}/{name}")
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    return versions.where(F.col("version") == newest).drop("version")
