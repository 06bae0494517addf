"""State that every task needs, sent once per task as a broadcast of a counted size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.session import materialise

STATE_BYTES = 64 << 20


class Sent:
    """A small table inside a task. Calling it gives the rows."""

    def __init__(self, spark: SparkSession, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.packed = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def __call__(self) -> pa.Table:
        return pa.ipc.open_stream(pa.py_buffer(self.packed.value)).read_all()

    def release(self) -> None:
        self.packed.unpersist()


def counted_numbers(df: DataFrame) -> Column:
    """Numbers in a row of ``df``, lists of lists included; a text counts an eighth of its bytes."""
    total = F.lit(len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType):
            inner = F.aggregate(f.name, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.size(x), F.lit(0)) + 1)
            total = total + F.coalesce(inner, F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.coalesce(F.size(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0)) / 8
    return total


def state_bytes(df: DataFrame, numbers: Column | None = None) -> int:
    counted = counted_numbers(df) if numbers is None else numbers + len(df.columns)
    return int(8 * (df.agg(F.sum(counted)).first()[0] or 0))


def send_once(df: DataFrame, limit: int = STATE_BYTES) -> Sent | None:
    """The rows of a written table for all tasks, or None where they count more than ``limit`` bytes."""
    return Sent(df.sparkSession, df.toArrow()) if state_bytes(df) <= limit else None


def in_turns(
    state: DataFrame, keys: Sequence[str], numbers: Column, step: Callable[[DataFrame, Sent], DataFrame], limit: int = STATE_BYTES
) -> DataFrame:
    """``step(rows, sent)`` over all rows of a written table: at once up to ``limit`` bytes, beyond that in turns of about so many.

    Turns are dealt by ``keys``; what a step returns for a key must not depend on the others.
    """
    spark = state.sparkSession
    turns = max(1, -(-state_bytes(state, numbers) // limit))
    if turns == 1:
        return step(state, Sent(spark, state.toArrow()))
    done = None
    for turn in range(turns):
        rows = state.where(F.pmod(F.xxhash64(*keys), F.lit(turns)) == turn)
        sent = Sent(spark, rows.toArrow())
        part = materialise(step(rows, sent), "turn")
        sent.release()
        done = part if done is None else done.unionByName(part)
    return done
