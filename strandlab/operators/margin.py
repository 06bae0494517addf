"""Margin machines (squared hinge loss) of many data sets, all values of C and all classes at once.

A machine minimises ``|w|^2 / 2 + C * sum(max(0, 1 - y * w.z)^2)`` over the features ``z`` of its data set, one class against the rest;
the last feature is the constant 1, whose weight is free. The loss is quadratic as long as the rows inside the margin stay the same, so
Newton steps end exactly, mostly after about ten.

A data set that fits a block is solved where it lies. A larger one is solved in rounds: each task adds up, per data set, value of C and
class, the curvature and the gradient of the rows inside the margin and the losses along the step, and only these sums are shuffled. All
machines move in the same round. The weights go to each task once, as a broadcast of a counted size; more machines than fit it take turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.blocks import BLOCK_BYTES, dataset_sizes, matrix, ranges_of
from strandlab.operators.task_state import STATE_BYTES, in_turns
from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, LABEL, SERIES, SERIES_ID
from strandlab.session import materialise

STEPS = 0.5 ** np.arange(32)
MAX_ROUNDS = 300
FREE = 1e-10  # penalty of the constant, so that a step exists when no row is inside the margin
HELD_BYTES = 128 << 20


@dataclass(frozen=True)
class Linear:
    """The numbers of the series themselves, and the constant."""

    def width(self, d: Column) -> Column:
        return d + 1

    def __call__(self, x: np.ndarray, gamma: float) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Fourier:
    """Random Fourier features of the RBF kernel, and the constant; the draw depends on seed and length only."""

    seed: int = 42
    n_features: int = 256

    def width(self, d: Column) -> Column:
        return F.lit(self.n_features + 1)

    def __call__(self, x: np.ndarray, gamma: float) -> np.ndarray:
        rng = np.random.default_rng([self.seed, x.shape[1]])
        weights = rng.normal(size=(x.shape[1], self.n_features)) * np.sqrt(2.0 * gamma)
        phase = rng.uniform(0.0, 2.0 * np.pi, size=self.n_features)
        z = np.sqrt(2.0 / self.n_features) * np.cos(x @ weights + phase)
        return np.hstack([z, np.ones((len(z), 1))])


def _penalty(size: int) -> np.ndarray:
    p = np.ones(size)
    p[-1] = FREE
    return p


def _target(gram: np.ndarray, right: np.ndarray, c: float) -> np.ndarray:
    """Minimum if the rows behind the sums stay inside the margin and no others enter it."""
    return np.linalg.solve(2.0 * c * gram + np.diag(_penalty(len(gram))), 2.0 * c * right)


def _size(w: np.ndarray) -> float:
    return 0.5 * float(_penalty(len(w)) @ (w * w))


def _losses(margin: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Sum of the squared losses at each step length, for margins before and after the full step."""
    return np.array([np.square(np.maximum(1.0 - (margin + s * (moved - margin)), 0.0)).sum() for s in STEPS])


def minimise(z: np.ndarray, y: np.ndarray, c: float, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Weights of one machine by Newton steps from ``w``, and the number of steps."""
    margin = y * (z @ w)
    value, rounds = np.inf, 0
    for rounds in range(1, MAX_ROUNDS + 1):
        inside = margin < 1.0
        a = z[inside]
        new = _target(a.T @ a, a.T @ y[inside], c)
        moved = y * (z @ new)
        if np.array_equal(moved < 1.0, inside):
            return new, rounds
        values = c * _losses(margin, moved) + [_size(w + s * (new - w)) for s in STEPS]
        best = int(values.argmin())
        if values[best] >= value * (1.0 - 1e-13):
            break
        w, margin, value = w + STEPS[best] * (new - w), margin + STEPS[best] * (moved - margin), values[best]
    return w, rounds


_FITTED = f"{DATASET} string, c double, class int, w array<double>, rounds int"


def _fitted(name: str, out: list[tuple], key: str) -> pa.Table:
    return pa.table({
        key: pa.array([name] * len(out), pa.string()), "c": pa.array([o[0] for o in out], pa.float64()), "class": pa.array([o[1] for o in out], pa.int32()),
        "w": pa.array([o[2].tolist() for o in out], pa.list_(pa.float64())), "rounds": pa.array([o[3] for o in out], pa.int32()),
    })


def _signs(labels: np.ndarray, label: int) -> np.ndarray:
    return np.where(labels == label, 1.0, -1.0)


def _fit_small(rows: DataFrame, small: DataFrame, features, tasks: int, key: str) -> DataFrame:
    """Machines of data sets of at most one block; ``tasks`` tasks share the classes of one data set."""
    joined = join_small(rows.select(key, SERIES_ID, LABEL, SERIES, "gamma"), small.select(key, "classes", "cs"), key, numbers=F.size("classes") + F.size("cs"))
    copied = joined.withColumn("_task", F.explode(F.sequence(F.lit(0), F.least(F.lit(tasks), F.size("classes")) - 1)))

    def fit(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(SERIES_ID)
        z = features(matrix(table), table["gamma"][0].as_py())
        labels, classes, cs = table[LABEL].to_numpy(), table["classes"][0].as_py(), sorted(table["cs"][0].as_py())
        out = []
        for number in range(keys[1].as_py(), len(classes), min(tasks, len(classes))):
            w = np.zeros(z.shape[1])
            for c in cs:  # the solution of one C is near that of the next
                w, rounds = minimise(z, _signs(labels, classes[number]), c, w)
                out.append((c, number, w, rounds))
        return _fitted(keys[0].as_py(), out, key)

    return copied.groupBy(key, "_task").applyInArrow(fit, _FITTED)


_STATE = f"{DATASET} string, c double, class int, label bigint, w array<double>, trial array<double>, value double, forced boolean, moving boolean, rounds int"
_SUMS = f"{DATASET} string, c double, class int, i int, sums array<double>"


def _add_up(sent, features, key: str):
    """Sums of the machines still moving, over the rows of a task: rows of the curvature from the diagonal on, each with its part of the
    gradient, and in row -1 the losses at each step length and the number of rows that crossed the margin."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (name, c, number), (both, line) in held.items():
            size = len(both)
            rows = [line, *(np.concatenate([both[i, i:size], both[i, size:]]) for i in range(size))]
            offsets = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
            sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([c] * n, pa.float64()), pa.array([number] * n, pa.int32()),
                                              pa.array(np.arange(-1, n - 1), pa.int32()), sums], names=[key, "c", "class", "i", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines: dict = {}
        for m in sent().to_pylist():
            machines.setdefault(m[key], []).append(m)
        held: dict = {}
        for batch in batches:
            for name, table in ranges_of(batch, key):
                own = machines.get(name)
                if not own:
                    continue
                z, labels = features(matrix(table), table["gamma"][0].as_py()), table[LABEL].to_numpy()
                before = z @ np.array([m["w"] for m in own]).T
                after = z @ np.array([m["trial"] for m in own]).T
                for j, m in enumerate(own):
                    y = _signs(labels, m["label"])
                    margin, moved = y * before[:, j], y * after[:, j]
                    inside = moved < 1.0
                    a = z[inside]
                    both = a.T @ np.hstack([a, y[inside, None]])
                    line = np.append(_losses(margin, moved), float(((margin < 1.0) != inside).sum()))
                    at = (name, m["c"], m["class"])
                    held[at] = (held[at][0] + both, held[at][1] + line) if at in held else (both, line)
                if sum(b.nbytes for b, _ in held.values()) > HELD_BYTES:
                    yield from emit(held)
                    held = {}
        yield from emit(held)

    return run


def _moved(m: dict, sums: dict[int, np.ndarray]) -> dict:
    """Accepts or shortens the step of one machine and makes the next one."""
    size, c = len(m["w"]), m["c"]
    gram, right = np.zeros((size, size)), np.zeros(size)
    for i in range(size):
        gram[i, i:], right[i] = sums[i][:-1], sums[i][-1]
    gram = gram + np.triu(gram, 1).T
    w, trial = np.array(m["w"]), np.array(m["trial"])
    losses, crossed = sums[-1][:-1], sums[-1][-1]
    values = c * losses + [_size(w + s * (trial - w)) for s in STEPS]
    best, least = int(values.argmin()), m["value"] * (1.0 - 1e-13)
    forced, moving = False, True
    if crossed == 0 and not m["forced"]:
        w, moving = trial, False  # the minimum of the quadratic that the loss still is
    elif m["forced"] or values[0] < least:
        w, m["value"] = trial, float(values[0])
        trial = _target(gram, right, c)
    elif values[best] < least:
        trial, forced = w + STEPS[best] * (trial - w), True
    else:
        moving = False
    rounds = m["rounds"] + 1
    return m | {"w": w, "trial": trial, "forced": forced, "moving": moving and rounds < MAX_ROUNDS, "rounds": rounds, "loss": float(losses[0])}


def _update(keys: tuple, state: pa.Table, sums: pa.Table) -> pa.Table:
    """One round of the machines of a class. A machine that ends hands its weights to the next C where they are better than that one's."""
    of: dict = {}
    for c, i, v in zip(sums["c"].to_pylist(), sums["i"].to_pylist(), sums["sums"].to_pylist()):
        of.setdefault(c, {})[i] = np.array(v)
    machines = [_moved(m, of[m["c"]]) for m in sorted(state.to_pylist(), key=lambda m: m["c"])]
    for m, after in zip(machines, machines[1:]):
        if not m["moving"] and after["moving"] and _size(m["w"]) + after["c"] * m["loss"] < after["value"]:
            after |= {"w": m["w"], "trial": m["w"], "value": float("inf"), "forced": True}
    for m in machines:
        m |= {"w": m["w"].tolist(), "trial": m["trial"].tolist()}
        del m["loss"]
    return pa.Table.from_pylist(machines, state.schema)


def _fit_large(rows: DataFrame, large: DataFrame, features, state_bytes: int, key: str) -> DataFrame:
    """Machines of data sets of many blocks, in rounds over all that still move."""
    # a task sends its sums of every machine of the data sets it meets, in every round: as many tasks as run at once, each with a range
    # of the data sets, so that what is shuffled depends on the machines and not on the rows
    points = join_small(rows.select(key, SERIES_ID, LABEL, SERIES, "gamma"), large.select(key), key)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    points = points.repartitionByRange(tasks, key, F.xxhash64(SERIES_ID)).drop(SERIES_ID).sortWithinPartitions(key)
    points = materialise(points, "margin-rows")
    machines = large.select(key, "width", "cs", F.posexplode("classes").alias("class", "label")).select("*", F.explode("cs").alias("c"))
    zeros = F.array_repeat(F.lit(0.0), F.col("width"))
    start = machines.select(key, "c", "class", "label", zeros.alias("w"), zeros.alias("trial"), F.lit(float("inf")).alias("value"),
                            F.lit(True).alias("forced"), F.lit(True).alias("moving"), F.lit(0).alias("rounds"))
    state = materialise(start, "margin-start")
    machine, one_class = [key, "c", "class"], [key, "class"]
    summed = vector_to_array(Summarizer.sum(array_to_vector(F.col("sums"))))
    while not (moving := state.where("moving")).isEmpty():

        def step(wave: DataFrame, sent) -> DataFrame:
            total = points.mapInArrow(_add_up(sent, features, key), _SUMS).groupBy(*machine, "i").agg(summed.alias("sums"))
            return wave.groupBy(*one_class).cogroup(total.groupBy(*one_class)).applyInArrow(_update, _STATE)

        moved = in_turns(moving, one_class, F.size("w") * 2, step, state_bytes)
        state = materialise(state.where("not moving").unionByName(moved), "margin-round")
    return state.select(*machine, "w", "rounds")


def fit_margin(
    rows: DataFrame, labelled: DataFrame, grid: DataFrame, features=Fourier(), block_bytes: int = BLOCK_BYTES, state_bytes: int = STATE_BYTES,
    tasks: int | None = None, key: str = DATASET,
) -> DataFrame:
    """One weight matrix (class by feature) per data set and value of C of ``grid``: ``c, classes, weights, rounds``.

    ``rows`` are prepared (series, label, ``gamma``); ``labelled`` are the same rows before scaling, which is all that sizes and classes
    need. Both ways to solve give the same weights; ``block_bytes`` decides which one a data set takes.
    """
    labels = labelled.groupBy(key, LABEL).agg(F.lit(1).alias("_one")).groupBy(key).agg(F.sort_array(F.collect_list(LABEL)).alias("classes"))
    values = grid.groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    settings = dataset_sizes(labelled, key).join(labels, key).join(values, key).withColumn("width", features.width(F.col("d")).cast("int"))
    sized = materialise(settings, "margin-settings", 1)
    fits_in_block = F.col("n") * F.col("width") * 8 <= block_bytes
    small, large = sized.where(fits_in_block), sized.where(~fits_in_block)
    fitted, n_small = None, small.count()
    if n_small:
        if tasks is None:
            tasks = max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // n_small))
        fitted = _fit_small(rows, small, features, tasks, key)
    if not large.isEmpty():
        rounds = _fit_large(rows, large, features, state_bytes, key)
        fitted = rounds if fitted is None else fitted.unionByName(rounds)
    if fitted is None:
        fitted = rows.sparkSession.createDataFrame([], _FITTED)
    by_class = F.sort_array(F.collect_list(F.struct("class", "w")))
    packed = fitted.groupBy(key, "c").agg(by_class.alias("_m"), F.max("rounds").alias("rounds"))
    return packed.join(labels, key).select(key, "c", "classes", F.transform("_m", lambda m: m["w"]).alias("weights"), "rounds")
