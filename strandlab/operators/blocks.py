"""Blocks of rows: bounded pieces of a data set that one task can hold as a matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, SERIES, SERIES_ID
from strandlab.operators.task_state import STATE_BYTES, send_once
from strandlab.session import materialise

BLOCK_BYTES = 16 << 20


def dataset_sizes(df: DataFrame, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Rows and series length per data set."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(series)).cast("bigint").alias("d"))


def block_counts(sizes: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = DATASET) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("n") * F.col("d") * 8 / block_bytes), F.lit(1)).cast("int")
    return sizes.select(key, blocks.alias("blocks"))


def with_blocks(
    df: DataFrame, sizes: DataFrame, block_bytes: int = BLOCK_BYTES, key: str = DATASET, row_key: str = SERIES_ID
) -> DataFrame:
    """Add ``block`` (and ``blocks``, their number) so that a block holds about ``block_bytes`` of numbers."""
    counted = block_counts(sizes, block_bytes, key)
    return join_small(df, counted, key, row_key=row_key).withColumn("block", F.pmod(F.xxhash64(row_key), "blocks").cast("int"))


def matrix(table: pa.Table, col: str = SERIES) -> np.ndarray:
    """List column of equal-length lists to a matrix. A null list, a null number or another length is an error."""
    if table.num_rows == 0:
        return np.zeros((0, 0))
    lists = table[col].combine_chunks()
    sizes = pc.list_value_length(lists)
    least, most = pc.min_max(sizes).values()
    values = lists.flatten()
    if lists.null_count or values.null_count or least != most:
        where = f" in data set {table[DATASET][0].as_py()}" if DATASET in table.column_names else ""
        raise ValueError(f"{col} needs lists of one length without nulls{where}: from {least.as_py()} to {most.as_py()} numbers, "
                         f"{lists.null_count} null lists, {values.null_count} null numbers")
    return values.to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(table.num_rows, -1)


def list_column(rows: np.ndarray) -> pa.Array:
    """Matrix to a column of lists."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * d, d, dtype="int32") if d else np.zeros(n + 1, "int32"),
                                    pa.array(np.ascontiguousarray(rows).reshape(-1)))


def ranges_of(batch: pa.RecordBatch, key: str = DATASET) -> Iterator[tuple[str, pa.Table]]:
    """Rows of a batch by the value of ``key``. Rows without one are left out."""
    table = pa.Table.from_batches([batch])
    if table[key].null_count:
        table = table.filter(pc.is_valid(table[key]))
    if not table.num_rows:
        return
    codes = table[key].combine_chunks().dictionary_encode()
    numbers = codes.indices.to_numpy()
    if (np.diff(numbers) < 0).any():
        order = np.argsort(numbers, kind="stable")
        table, numbers = table.take(pa.array(order)), numbers[order]
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield codes.dictionary[int(numbers[lo])].as_py(), table.slice(lo, hi - lo).combine_chunks()


def apply_with_parameters(
    df: DataFrame,
    parameters: DataFrame,
    fn: Callable[[str, pa.Table, pa.Table], pa.Table],
    schema: str | T.StructType,
    sizes: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    key: str = DATASET,
    state_bytes: int = STATE_BYTES,
) -> DataFrame:
    """Run ``fn`` on runs of rows of one data set together with the parameter rows of that data set.

    Parameters are written and counted. Up to ``state_bytes`` they go to each task once and the rows stay where they are. Beyond that
    they travel by key to the blocks that need them. ``sizes`` may be given where they are cheaper to get than from ``df``. Rows of
    data sets without parameters are left out.
    """
    parameters = materialise(parameters, "parameters")
    sent = send_once(parameters, state_bytes)
    if sent is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[str, pa.Table] = {}
            table = sent()
            for batch in table.to_batches():
                for name, part in ranges_of(batch, key):
                    of[name] = pa.concat_tables([of[name], part]) if name in of else part
            for batch in batches:
                for name, rows in ranges_of(batch, key):
                    if name in of:
                        yield from fn(name, rows, of[name]).to_batches()

        return df.mapInArrow(run, schema)
    sizes = dataset_sizes(df, key) if sizes is None else sizes
    rows = with_blocks(df, sizes, block_bytes, key)
    counted = block_counts(sizes, block_bytes, key)
    copies = parameters.join(counted, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = [key, "block"]
    grouped = rows.drop("blocks").groupBy(*grid).cogroup(copies.drop("blocks").groupBy(*grid))
    return grouped.applyInArrow(lambda keys, table, fitted: fn(keys[0].as_py(), table, fitted), schema)
