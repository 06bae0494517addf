"""Batch encoding with supplied network weights.

The weights are an input table, one row per weight row: ``layer int, name
string, row_no int, weights array<double>``. The size of a model does not grow
with the data; it is checked before the model is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.operators.blocks import matrix
from strandlab.operators.prep import SERIES

MAX_MODEL_NUMBERS = 64 << 20
Layers = list[dict[str, np.ndarray]]


def load_weights(table: DataFrame) -> Layers:
    """Layers of a model, each a dict of matrices. Fails for a model of more than ``MAX_MODEL_NUMBERS`` numbers."""
    numbers = table.agg(F.sum(F.size("weights"))).first()[0] or 0
    if numbers > MAX_MODEL_NUMBERS:
        raise ValueError(f"the model has {numbers} numbers, more than {MAX_MODEL_NUMBERS}")
    layers: dict[int, dict[str, dict[int, list]]] = {}
    for row in table.collect():
        layers.setdefault(row["layer"], {}).setdefault(row["name"], {})[row["row_no"]] = row["weights"]
    return [
        {name: np.array([rows[i] for i in sorted(rows)]) for name, rows in layers[no].items()} for no in sorted(layers)
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _recurrent_layer(cell: str, w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Hidden states of one layer for a batch ``(rows, steps, inputs)``; start states are 0.

    ``w_ih`` and ``w_hh`` stack the gates: input, forget, cell, output for
    'lstm'; reset, update, new for 'gru'; any other name is a tanh cell.
    """
    units = w["w_hh"].shape[1]
    h = np.zeros((len(x), units))
    c = np.zeros_like(h)
    out = np.empty((len(x), x.shape[1], units))
    b_ih, b_hh = w["b_ih"].reshape(-1), w["b_hh"].reshape(-1)
    for t in range(x.shape[1]):
        a = x[:, t] @ w["w_ih"].T + b_ih
        b = h @ w["w_hh"].T + b_hh
        if cell == "lstm":
            i, f, g, o = np.split(a + b, 4, axis=1)
            c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
            h = _sigmoid(o) * np.tanh(c)
        elif cell == "gru":
            (ar, az, an), (br, bz, bn) = np.split(a, 3, axis=1), np.split(b, 3, axis=1)
            z = _sigmoid(az + bz)
            h = (1.0 - z) * np.tanh(an + _sigmoid(ar + br) * bn) + z * h
        else:
            h = np.tanh(a + b)
        out[:, t] = h
    return out


def _recurrent(cell: str, layers: Layers, x: np.ndarray) -> np.ndarray:
    for w in layers:
        x = _recurrent_layer(cell, w, x)
    return x


def _dense(layers: Layers, x: np.ndarray) -> np.ndarray:
    """Dense layers with optional normalisation by running moments and ReLU after all but the last."""
    for no, w in enumerate(layers):
        x = x @ w["w"].T + w["b"].reshape(-1)
        if "mean" in w:
            scale = w["scale"].reshape(-1) / np.sqrt(w["var"].reshape(-1) + 1e-5)
            x = (x - w["mean"].reshape(-1)) * scale + w["shift"].reshape(-1)
        if no < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return x


def _map_series(df: DataFrame, name: str, fn, nested: bool = False, series: str = SERIES) -> DataFrame:
    """Append ``name`` computed from batches of equal-length series; the rows stay where they are."""
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(vector) if nested else vector)])
    out_type = pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(series))
            for length in pc.unique(lengths).to_pylist():
                part = pa.Table.from_batches([batch]).filter(pc.equal(lengths, length))
                values = pa.array(fn(matrix(part, series)).tolist(), out_type)
                yield from part.append_column(name, values).to_batches()

    return df.mapInArrow(run, schema)


def encode_recurrent(df: DataFrame, weights: DataFrame, cell: str = "lstm", states: bool = False, series: str = SERIES) -> DataFrame:
    """Add ``repr``, the last state of a recurrent stack; with ``states`` also all states ``[t][unit]``."""
    held = df.sparkSession.sparkContext.broadcast(load_weights(weights))
    kind = cell.lower()
    if states:
        df = _map_series(df, "states", lambda x: _recurrent(kind, held.value, x[:, :, None]), True, series)
        return df.withColumn("repr", F.element_at("states", -1))
    return _map_series(df, "repr", lambda x: _recurrent(kind, held.value, x[:, :, None])[:, -1], False, series)


def reconstruct_recurrent(
    df: DataFrame, encoder: DataFrame, decoder: DataFrame, output: DataFrame, cell: str = "lstm", series: str = SERIES
) -> DataFrame:
    """Add ``decoded``: encode, reverse the states in time, decode, and map each state to a number."""
    context = df.sparkSession.sparkContext
    held = context.broadcast((load_weights(encoder), load_weights(decoder), load_weights(output)))
    kind = cell.lower()

    def run(x: np.ndarray) -> np.ndarray:
        enc, dec, out = held.value
        states = _recurrent(kind, enc, x[:, :, None])[:, ::-1]
        return (_recurrent(kind, dec, states) @ out[0]["w"].T + out[0]["b"].reshape(-1))[:, :, 0]

    return _map_series(df, "decoded", run, False, series)


def encode_dense(df: DataFrame, weights: DataFrame, head: DataFrame | None = None, series: str = SERIES) -> DataFrame:
    """Add ``repr`` of a convolutional encoder, or its projection when ``head`` is given.

    The whole series is one position with as many channels as steps, and the
    paddings equal half the dilated kernels, so only the centre tap of every
    convolution meets data: the encoder is a stack of dense layers.
    """
    body = load_weights(weights)
    top = load_weights(head) if head is not None else None
    held = df.sparkSession.sparkContext.broadcast((body, top))

    def run(x: np.ndarray) -> np.ndarray:
        encoder, projection = held.value
        h = _dense(encoder, x)
        return h if projection is None else _dense(projection, h)

    return _map_series(df, "repr", run, False, series)


def pool_series(steps: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Whole-series pooling: greatest value over time of every dimension, as long rows ``dim, value``."""
    long = steps.select(*keys, F.posexplode(vector).alias("dim", "_v"))
    return long.groupBy(*keys, "dim").agg(F.max("_v").alias("value"))


def centre_taps(weights: DataFrame, kernel_sizes: list[int]) -> DataFrame:
    """Dense weights of convolutions on a single position.

    The rows named ``w`` of layer ``i`` hold ``[input][tap]`` flattened; only the middle tap of
    ``kernel_sizes[i]`` is kept. Layers without a kernel size are dense already.
    """
    size = F.get(F.array(*[F.lit(k) for k in kernel_sizes]), F.col("layer"))
    kept = F.filter("weights", lambda w, i: i % size == F.floor(size / 2))
    is_conv = (F.col("name") == "w") & size.isNotNull()
    return weights.withColumn("weights", F.when(is_conv, kept).otherwise(F.col("weights")))
