"""Gram matrices of many data sets in one pass.

Least-squares models only need sums of products, so the rows are read once and
everything after that works on matrices whose size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators.blocks import list_column, matrix
from strandlab.operators.prep import DATASET, SERIES

HELD_BYTES = 256 << 20


def gram_rows(
    df: DataFrame,
    keys: Sequence[str],
    factors: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    columns: Sequence[str],
) -> DataFrame:
    """Sums of ``A^T B`` per group: one output row per row ``i`` of the product.

    ``factors`` turns the rows of one group into the matrices A and B. Every
    task adds up its rows and emits matrices, which then add up per group and
    row; a task that holds many groups emits early to bound its memory.
    """
    keys = list(keys)
    schema = ", ".join(f"{k} string" for k in keys) + ", i int, product array<double>, n bigint"

    def emit(held: dict) -> pa.RecordBatch:
        names = [k for k, (m, _) in held.items() for _ in range(len(m))]
        arrays = [pa.array([name[j] for name in names], pa.string()) for j in range(len(keys))]
        index = pa.array(np.concatenate([np.arange(len(m)) for m, _ in held.values()]), pa.int32())
        rows = pa.concat_arrays([list_column(m) for m, _ in held.values()])
        n = pa.array([c for m, c in held.values() for _ in range(len(m))], pa.int64())
        return pa.RecordBatch.from_arrays([*arrays, index, rows, n], names=[*keys, "i", "product", "n"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group in table.group_by(keys).aggregate([]).to_pylist():
                mask = None
                for k in keys:
                    same = pc.equal(table[k], group[k])
                    mask = same if mask is None else pc.and_(mask, same)
                a, b = factors(table.filter(mask))
                name = tuple(group[k] for k in keys)
                old, n = held.get(name, (0.0, 0))
                held[name] = (old + a.T @ b, n + len(a))
            if held and sum(m.nbytes for m, _ in held.values()) > HELD_BYTES:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    partial = df.select(*columns).mapInArrow(add_up, schema)
    summed = vector_to_array(Summarizer.sum(array_to_vector(F.col("product"))))
    return partial.groupBy(*keys, "i").agg(summed.alias("product"), F.sum("n").alias("n"))


def series_gram(df: DataFrame, keys: Sequence[str] = (DATASET,), other: str | None = None) -> DataFrame:
    """Rows of ``[X R]^T [X R]`` per group; ``other`` names the column behind R."""

    def factors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(rows, SERIES)
        both = x if other is None else np.hstack([x, matrix(rows, other)])
        return both, both

    return gram_rows(df, keys, factors, [*keys, SERIES, *([other] if other else [])])


def whole(table: pa.Table, col: str = "product") -> np.ndarray:
    """Matrix of one group from its rows."""
    return matrix(table.sort_by("i"), col)
