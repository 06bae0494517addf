"""Functions chosen by name: dtype casts, losses, encoders, and composition of table steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays

ColumnFn = Callable[[Column], Column]
TableFn = Callable[[DataFrame], DataFrame]

# Declared attribute type -> cast. Any other type is left as it is.
CASTS: dict[str, ColumnFn] = {
    "nominal": lambda c: c.cast("string").cast("bigint"),
    "numeric": lambda c: c.cast("double"),
}

# Loss name -> aggregate over two series columns: mean over all steps of all rows.
LOSSES: dict[str, Callable[[str, str], Column]] = {
    "mse_loss": lambda x, y: F.sum(arrays.squared_distance(x, y)) / F.sum(F.size(x)),
    "l1_loss": lambda x, y: F.sum(arrays.absolute_distance(x, y)) / F.sum(F.size(x)),
}


def cast_by_type(df: DataFrame, types: Mapping[str, str], casts: Mapping[str, ColumnFn] = CASTS) -> DataFrame:
    """Cast every column by its declared type; identity where the type has no cast."""
    keep: ColumnFn = lambda c: c
    return df.select(*[casts.get(types.get(c, ""), keep)(F.col(c)).alias(c) for c in df.columns])


def loss(name: str, x: str, y: str) -> Column:
    if name not in LOSSES:
        raise ValueError(f"unknown loss: {name}")
    return LOSSES[name](x, y)


def compose(*steps: TableFn | None) -> TableFn:
    """One step out of many, applied right to left; ``None`` steps are left out."""
    kept = [s for s in steps if s is not None]
    return lambda df: reduce(lambda acc, s: acc.transform(s), reversed(kept), df)


def hint_loss(states: str, teacher: str) -> Column:
    """Mean squared gap between the last student state and the teacher vector, over all rows."""
    return F.sum(arrays.squared_distance(arrays.last_state(states), teacher)) / F.sum(F.size(teacher))
