"""Teacher-to-student representation: a linear encoder and decoder fitted from Gram matrices.

The student minimises ``(1 - c) * reconstruction + c * hint``, where the hint
is the gap to the teacher's representation. For linear maps both losses and
their gradients depend on the data through ``[X R]^T [X R]`` and the row count
only. One pass builds these sums for the train and valid parts of all data
sets; every epoch after that works on matrices of series length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlab.operators.blocks import apply_with_parameters, matrix
from strandlab.operators.gram import series_gram, whole
from strandlab.operators.logs import early_stopping_settings
from strandlab.operators.prep import DATASET, PART, SERIES

# Fixed values of the standard training.
EPOCHS = 500
LEARNING_RATE = 1e-3
HINT = {"start": 0.0, "final": 0.9, "rate": 1.5, "start_epoch": 0, "valid": 0.0}


def closest_power(m: float, v: float) -> int:
    """Same rule as the column function, for sizes inside a task."""
    ratio = m / v
    low = 2.0 ** np.floor(np.log2(ratio))
    return max(1, int(low if ratio - low < 2 * low - ratio or ratio == low else 2 * low))


def gram_parts(df: DataFrame, teacher: str | None = None) -> DataFrame:
    """Gram rows of train and valid parts; ``teacher`` names the column of teacher vectors."""
    return series_gram(df.where(F.col(PART).isin("train", "valid")), (DATASET, PART), teacher)


class Moments:
    """Mean of ``x x^T`` over the rows of a part. With fewer rows than half the steps it is kept as its eigenvectors of non-zero
    eigenvalues, so that a product costs rows and not steps per number."""

    def __init__(self, s: np.ndarray, n: int):
        self.trace, self.s, self.axes = float(np.trace(s)), s, None
        if 2 * n <= len(s):
            values, axes = np.linalg.eigh(s)
            self.s, self.values, self.axes = None, values[-n:], np.ascontiguousarray(axes[:, -n:])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.s @ w if self.axes is None else self.axes @ (self.values[:, None] * (self.axes.T @ w))


def _losses(moments: Moments, cross: np.ndarray, r2: float, w: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """Reconstruction and hint loss of one encoder and decoder."""
    moved = moments.dot(w)
    return _losses_of(moments, cross, r2, w, d, moved, w.T @ moved, d @ d.T)


def _losses_of(
    moments: Moments, cross: np.ndarray, r2: float, w: np.ndarray, d: np.ndarray, moved: np.ndarray, inner: np.ndarray, both: np.ndarray
) -> tuple[float, float]:
    """Reconstruction and hint loss, means per number. ``moved``: moments times ``w``; ``inner``: ``w`` times that; ``both``: ``d d^T``."""
    t, k = w.shape
    recon = (moments.trace - 2 * float((moved * d.T).sum()) + float((inner * both).sum())) / t
    if cross.size == 0:
        return recon, 0.0
    return recon, (float(np.trace(inner)) - 2 * float((w * cross).sum()) + r2) / k


def _coefficient(epoch: int, epochs: int, hint: dict) -> float:
    if epoch < hint["start_epoch"]:
        return 0.0
    done = (epoch - hint["start_epoch"]) / (epochs - hint["start_epoch"])
    return hint["start"] + (hint["final"] - hint["start"]) * done ** hint["rate"]


def _split_gram(product: np.ndarray, n: int, steps: int) -> tuple[Moments, np.ndarray, float]:
    g = product / n
    return Moments(g[:steps, :steps], n), g[:steps, steps:], float(np.trace(g[steps:, steps:]))


def random_start(steps: int, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(scale=1 / np.sqrt(steps), size=(steps, size)), rng.normal(scale=1 / np.sqrt(size), size=(size, steps))


def fit_students(
    grams: DataFrame,
    steps: DataFrame,
    epochs: int = EPOCHS,
    compression: int = 2,
    lr: float = LEARNING_RATE,
    hint: dict = HINT,
    seed: int = 42,
    stopping: dict | None = None,
    start: Callable[[int, int], tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """Fit one student per data set. ``steps`` holds the series length ``d`` per data set, ``start`` the first encoder and decoder
    from steps and size (random ones of ``seed`` by default).

    Output, one row per data set and epoch: ``train_loss``, ``val_loss``, and
    on the best and the final epoch the encoder ``w`` and decoder ``d``. A
    group holds the rows of two Gram matrices, whatever the number of series;
    an epoch multiplies each with the encoder once and no other steps by steps.
    A fit ends early by the rule of ``logs.early_stop``; ``stopping`` has its
    ``min_delta`` and ``patience``, by default those of the usual profile.
    """
    stopping = early_stopping_settings(epochs) if stopping is None else stopping
    min_delta, patience = stopping["min_delta"], max(stopping["patience"], 1)
    schema = (
        f"{DATASET} string, epoch bigint, train_loss double, val_loss double, checkpoint array<string>, "
        "w array<array<double>>, decoder array<array<double>>"
    )

    def fit(keys: tuple, table: pa.Table) -> pa.Table:
        t = int(table["d"][0].as_py())
        split = {}
        for part in ("train", "valid"):
            rows = table.filter(pa.compute.equal(table[PART], part))
            if rows.num_rows:
                split[part] = _split_gram(whole(rows), int(rows["n"][0].as_py()), t)
        s, cross, r2 = split["train"]
        k = cross.shape[1] or closest_power(t, compression)
        params = list(start(t, k) if start is not None else random_start(t, k, seed))
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        log, best, kept = [], None, {}
        watched, misses = np.inf, 0
        for epoch in range(epochs):
            w, d = params
            c = _coefficient(epoch, epochs, hint) if cross.size else 0.0
            moved, both = s.dot(w), d @ d.T
            inner = w.T @ moved
            recon, gap = _losses_of(s, cross, r2, w, d, moved, inner, both)
            v_recon, v_gap = recon, gap
            if "valid" in split:
                v_recon, v_gap = _losses(*split["valid"], w, d)
            val = (1 - hint["valid"]) * v_recon + hint["valid"] * v_gap if cross.size else v_recon
            log.append((epoch, (1 - c) * recon + c * gap, val))
            if best is None or val < log[best][2]:
                best, kept["best"] = epoch, (w.copy(), d.copy())
            kept["final"] = (w.copy(), d.copy())
            watched, misses = (val, 0) if val + min_delta < watched else (watched, misses + 1)
            if misses >= patience:
                break
            grads = [2 * (1 - c) / t * (moved @ both - s.dot(d.T)), 2 * (1 - c) / t * (inner @ d - moved.T)]
            if cross.size:
                grads[0] = grads[0] + 2 * c / k * (moved - cross)
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                step = (m[j] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v[j] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
                params[j] = params[j] - lr * step
        marks = {best: ["best"]}
        marks.setdefault(len(log) - 1, []).append("final")
        held = lambda e, j: kept[marks[e][0]][j].tolist() if e in marks else None
        nested = pa.list_(pa.list_(pa.float64()))
        return pa.table({
            DATASET: pa.array([keys[0].as_py()] * len(log), pa.string()),
            "epoch": pa.array([e for e, _, _ in log], pa.int64()),
            "train_loss": pa.array([a for _, a, _ in log], pa.float64()),
            "val_loss": pa.array([b for _, _, b in log], pa.float64()),
            "checkpoint": pa.array([marks.get(e) for e, _, _ in log], pa.list_(pa.string())),
            "w": pa.array([held(e, 0) for e, _, _ in log], nested),
            "decoder": pa.array([held(e, 1) for e, _, _ in log], nested),
        })

    return grams.join(steps.select(DATASET, "d"), DATASET).groupBy(DATASET).applyInArrow(fit, schema)


def checkpoints(fits: DataFrame) -> DataFrame:
    """Encoders of the best and the final epoch."""
    return fits.where(F.col("checkpoint").isNotNull()).select(
        DATASET, F.explode("checkpoint").alias("checkpoint"), "epoch", "w", "decoder"
    )


def principal_axes(df: DataFrame, compression: int = 2) -> DataFrame:
    """Linear optimum without a teacher: leading axes of ``X^T X`` per data set, as encoder ``w``.

    Axes are signed so that their largest entry is positive.
    """
    schema = f"{DATASET} string, checkpoint string, w array<array<double>>"

    def solve(keys: tuple, table: pa.Table) -> pa.Table:
        g = whole(table)
        k = closest_power(len(g), compression)
        _, axes = np.linalg.eigh(g)
        w = axes[:, ::-1][:, :k]
        w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(k)])
        return pa.table({DATASET: [keys[0].as_py()], "checkpoint": ["best"],
                         "w": pa.array([w.tolist()], pa.list_(pa.list_(pa.float64())))})

    return series_gram(df, (DATASET,)).groupBy(DATASET).applyInArrow(solve, schema)


def encode_linear(df: DataFrame, encoders: DataFrame, keep_series: bool = False) -> DataFrame:
    """Representations of all rows under all encoders of their data set, one job for all parts and checkpoints.

    All columns of ``df`` stay, the series itself only with ``keep_series``.
    """
    kept = [f for f in df.schema.fields if f.name != DATASET and (keep_series or f.name != SERIES)]
    extra = [f.name for f in kept]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[DATASET], T.StructField("checkpoint", T.StringType()), *kept, T.StructField("repr", vector)])

    def run(name: str, table: pa.Table, fitted: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            x = matrix(table)
            for e in fitted.to_pylist():
                part = table.select(extra)
                part = part.append_column("checkpoint", pa.array([e["checkpoint"]] * len(x), pa.string()))
                out.append(part.append_column("repr", pa.array((x @ np.array(e["w"])).tolist(), pa.list_(pa.float64()))))
        if not out:
            none = table.select(extra).slice(0, 0).append_column("checkpoint", pa.array([], pa.string()))
            out = [none.append_column("repr", pa.array([], pa.list_(pa.float64())))]
        joined = pa.concat_tables(out)
        named = joined.append_column(DATASET, pa.array([name] * joined.num_rows, pa.string()))
        return named.select([DATASET, "checkpoint", *extra, "repr"])

    return apply_with_parameters(df, encoders.select(DATASET, "checkpoint", "w"), run, schema)
