"""Writers and readers for processed parts, representations and results.

Folders are partitioned by the columns later reads filter on, so that a seed,
a part or a data set is found by listing and not by reading.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions.scalars import prefixed
from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, LABEL, PART, SERIES, SERIES_ID


ROWS_PER_FILE = 1 << 18


def _spread(df: DataFrame, by: Sequence[str], files: int | None) -> DataFrame:
    """Deal the rows of each folder to as many files as they fill, or to ``files``; add the file's number ``_file``.

    A folder of few rows is one file, a hot folder is written by many tasks.
    """
    if files is None:
        counts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("bigint").alias("_files"))
        df = join_small(df, counts, by)
    else:
        df = df.withColumn("_files", F.lit(files).cast("bigint"))
    dealt = df.withColumn("_file", F.pmod(F.xxhash64(SERIES_ID), "_files")).drop("_files")
    return dealt.repartition(*by, "_file")


def write_parts(df: DataFrame, path: str, fmt: str = "parquet", files_per_part: int | None = None, mode: str = "overwrite") -> None:
    """Processed parts; as text each file has a header, and the steps come first and the label last.

    Files are filled by counted rows unless ``files_per_part`` is given. The header names as many steps as the first row of its
    file has; a task that holds two files of a folder writes them as one, whose second header is a line of names like the first.
    """
    by = [DATASET, PART]
    rows = _spread(df, by, files_per_part)
    if fmt == "parquet":
        rows.drop("_file").write.mode(mode).partitionBy(*by).parquet(path)
    elif fmt == "csv":
        line = F.concat_ws(",", F.array_join(F.col(SERIES).cast("array<string>"), ",", ""), F.col(LABEL).cast("string"))
        names = F.array_join(F.transform(F.sequence(F.lit(0), F.size(SERIES) - 1), lambda i: i.cast("string")), ",")
        header = F.concat(names, F.lit(f",{LABEL}"))
        heads = _headers(rows, by, header)
        lines = rows.select(*by, "_file", line.alias("value"), F.lit(1).alias("_place")).unionByName(heads)
        dealt = lines.repartition(*by, "_file").sortWithinPartitions(*by, "_file", "_place")
        dealt.select(*by, "value").write.mode(mode).partitionBy(*by).text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def _headers(rows: DataFrame, by: Sequence[str], header: Column) -> DataFrame:
    """One header line per file."""
    return rows.groupBy(*by, "_file").agg(F.max(header).alias("value")).withColumn("_place", F.lit(0))


def write_representations(df: DataFrame, path: str, files_per_part: int | None = None, mode: str = "overwrite") -> None:
    by = ["checkpoint", PART, DATASET]
    _spread(df, by, files_per_part).drop("_file").write.mode(mode).partitionBy(*by).parquet(path)


def result_name(base: str | Column, prefix: str | Column | None) -> Column:
    return prefixed(base, prefix)


def write_results(df: DataFrame, path: str, seed: int | None = None, prefix: str | None = None, mode: str = "append") -> None:
    """Result rows under their seed; ``prefix`` is kept as a column."""
    rows = df if seed is None else df.withColumn("seed", F.lit(seed))
    if prefix:
        rows = rows.withColumn("prefix", F.lit(prefix))
    rows.write.mode(mode).partitionBy("seed").parquet(path)


def read_results(spark: SparkSession, path: str, seeds: Iterable[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Results of the wanted seeds. Missing seeds are skipped; no seed at all is an error."""
    found = spark.read.parquet(path).where(F.col("seed").isin(list(seeds)))
    if found.isEmpty():
        raise FileNotFoundError(f"no results of the wanted seeds in {path}")
    return found.select(*columns, "seed") if columns else found
