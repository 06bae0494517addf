"""Registered queries, their check queries, and the readings of the supplied tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.scalars import two_decimals  # noqa: F401  (used by query modules)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

ALGORITHMS = [f"A{i}" for i in range(1, 8)]
DATASETS = [f"ds{i}" for i in range(4)]

# Table readings in SQL, in order of use.
READINGS = {
    "ser": """ser AS (SELECT 'ds' || (vec_id % 4) AS dataset_name, vec_id AS series_id, CAST(label AS BIGINT) AS label,
        CAST(embedding AS DOUBLE[]) AS series FROM embeddings)""",
    "parts": """parts AS (SELECT *, CASE WHEN (series_id // 4) % 10 < 5 THEN 'train' WHEN (series_id // 4) % 10 < 7 THEN 'valid'
        ELSE 'test' END AS part FROM ser)""",
    "steps": """steps AS (SELECT dataset_name, series_id, label, unnest(range(0, len(series))) AS pos, unnest(series) AS value FROM ser)""",
    "cells": """cells AS (SELECT 'S' || l_suppkey AS dataset_name, 'A' || l_linenumber AS algorithm,
        CAST(l_quantity AS BIGINT) % 5 AS run, round(avg(l_extendedprice / 0.99991::DOUBLE), 4) AS value FROM lineitem GROUP BY 1, 2, 3)""",
    "pred": """pred AS (SELECT 'L' || l_linenumber AS dataset_name, l_returnflag AS label, l_linestatus AS cluster FROM lineitem)""",
    "graded": """graded AS (SELECT 'Q' || (doc_id % 3) AS dataset_name, quality AS label, toxic AS prediction FROM labels)""",
    "log": """log AS (SELECT 'T' || o_orderstatus AS dataset_name, o_orderpriority AS model_name,
        CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS epoch,
        round(avg(sqrt(o_totalprice)) / 400, 6) AS train_loss, round(avg(o_totalprice) / 99991, 6) AS val_loss
        FROM orders GROUP BY 1, 2, 3)""",
    "batched": """placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY series_id) AS place FROM ser),
        batched AS (SELECT *, (place - 1) // 8 AS batch_id FROM placed)""",
}
NEEDS = {"parts": ["ser"], "steps": ["ser"], "batched": ["ser"]}


def with_readings(names: str, sql: str) -> str:
    """Prefix ``sql`` by the named readings; ``sql`` may start with further CTEs after a leading comma."""
    ordered: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    head = "WITH " + ",\n".join(READINGS[n] for n in ordered)
    body = sql.strip()
    return f"{head}{body}" if body.startswith(",") else f"{head}\n{body}"


def query(name: str, readings: str = "", sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_readings(readings, sql) if readings else sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as labelled series of 64 steps in four data sets."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("ds"), F.col("vec_id") % 4).alias("dataset_name"),
        F.col("vec_id").alias("series_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("series"),
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    tenth = F.floor(F.col("series_id") / 4) % 10
    part = F.when(tenth < 5, "train").when(tenth < 7, "valid").otherwise("test")
    return series(spark, folder).withColumn("part", part)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a metric table: suppliers are data sets, line numbers are algorithms.

    Prices are divided by a number that keeps their means off rounding ties, where engines differ.
    """
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("dataset_name"),
            F.concat(F.lit("A"), F.col("l_linenumber")).alias("algorithm"),
            (F.col("l_quantity").cast("bigint") % 5).alias("run"),
        )
        .agg(F.round(F.avg(F.col("l_extendedprice") / 0.99991), 4).alias("value"))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_linenumber")).alias("dataset_name"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("cluster"),
    )


def graded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.concat(F.lit("Q"), F.col("doc_id") % 3).alias("dataset_name"),
        F.col("quality").alias("label"),
        F.col("toxic").alias("prediction"),
    )


def month_number(c: str = "o_orderdate") -> Column:
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).cast("bigint")


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as training logs: one model per status and priority, one epoch per month."""
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.concat(F.lit("T"), F.col("o_orderstatus")).alias("dataset_name"),
            F.col("o_orderpriority").alias("model_name"),
            month_number().alias("epoch"),
        )
        .agg(
            F.round(F.avg(F.sqrt("o_totalprice")) / 400, 6).alias("train_loss"),
            F.round(F.avg("o_totalprice") / 99991, 6).alias("val_loss"),
        )
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def long_series(df: DataFrame, keys: list[str], col: str = "series", digits: int = 6) -> DataFrame:
    """One row per number of an array column, for comparing."""
    return df.select(*keys, F.posexplode(col).alias("pos", "_v")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.round("_v", digits).alias("value")
    )
