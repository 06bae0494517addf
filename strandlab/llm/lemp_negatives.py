"""Hard negatives by inner product, found with length buckets and sorted coordinate lists.

Rows of one label are ordered by their length and cut into buckets; a bucket holds one sorted list of unit-vector coordinates per
dimension. For an anchor and the score it still needs, the longest vector of a bucket says how small the angle must be, and that bounds
each coordinate. The lists of the anchor's largest ("focus") coordinates are cut to these ranges and intersected, and only the
rows left are multiplied. Longest buckets come first, so the score still needed rises early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.joining import join_small
from strandlab.session import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
FOCUS = 5
BUCKET_ROWS = 2048
SHELF_ROWS = 8192  # rows that travel and are indexed together: several buckets, longest first
CHUNK_ANCHORS = 256
LONGEST = float(1 << 31)  # inner products of vectors up to this length fit 64 bits
SLACK = 1e-9


class Bucket:
    """Vectors of similar length with a sorted list of unit coordinates per dimension, and each vector's place in each list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.longest = ids, vectors, float(lengths.max())
        self.floats = vectors.astype(np.float64)
        unit = (self.floats / np.where(lengths > 0, lengths, 1)[:, None]).T
        self.order = np.argsort(unit, axis=1, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=1)
        self.place = np.empty(self.order.shape, np.int32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=np.int32)[None, :], axis=1)

    def candidates(self, unit: np.ndarray, focus: np.ndarray, length: float, needed: float) -> np.ndarray | None:
        """Rows that may reach ``needed`` with an anchor of this direction and length; None: all of them."""
        if needed <= 0:
            return None
        most = length * self.longest
        if needed > most * (1 + SLACK):
            return np.zeros(0, np.int64)
        widest = np.arccos(min(1.0, needed / most * (1 - SLACK)))
        angle = np.arccos(unit[focus])
        low = np.cos(np.minimum(np.pi, angle + widest)) - SLACK
        high = np.cos(np.maximum(0.0, angle - widest)) + SLACK
        lo = [int(np.searchsorted(self.sorted[f], x, "left")) for f, x in zip(focus, low)]
        hi = [int(np.searchsorted(self.sorted[f], x, "right")) for f, x in zip(focus, high)]
        by_width = sorted(range(len(focus)), key=lambda j: hi[j] - lo[j])
        j = by_width[0]
        rows = self.order[focus[j]][lo[j] : hi[j]]
        for j in by_width[1:]:
            if hi[j] - lo[j] == len(self.ids) or not len(rows):
                break
            place = self.place[focus[j]][rows]
            rows = rows[(place >= lo[j]) & (place < hi[j])]
        return rows

    def scores(self, anchor: np.ndarray, length: float, rows: np.ndarray | None) -> np.ndarray:
        """Exact inner products. Below 2^53 every partial sum is a whole number that a double holds."""
        exact = length * self.longest < 2.0**52
        of = self.floats if exact else self.vectors
        of = of if rows is None else of[rows]
        return (of @ anchor.astype(of.dtype)).astype(np.int64)


def best_first(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:most]
    return scores[order], ids[order]


class Shelf:
    """Rows of one label, longest first, in buckets."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bucket_rows: int = BUCKET_ROWS):
        vectors = vectors.astype(np.int64)
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -lengths))
        ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        self.buckets = [Bucket(ids[i : i + bucket_rows], vectors[i : i + bucket_rows], lengths[i : i + bucket_rows]) for i in range(0, len(ids), bucket_rows)]
        self.tried = 0

    def _met(self, anchor: np.ndarray, own: int, needed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of the rows that may matter, bucket by bucket. ``needed``: the score that matters by then."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        unit = anchor / length if length > 0 else np.zeros(len(anchor))
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            rows = bucket.candidates(unit, focus, length, needed())
            ids = bucket.ids if rows is None else bucket.ids[rows]
            self.tried += len(ids)
            if len(ids):
                scores = bucket.scores(anchor, length, rows)
                other = ids != own
                yield scores[other], ids[other]

    def highest(self, anchor: np.ndarray, own: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``most`` rows of highest score."""
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s, i in self._met(anchor, own, lambda: float(scores[-1]) if len(scores) == most else -np.inf):
            scores, ids = best_first(np.concatenate([scores, s]), np.concatenate([ids, i]), most)
        return scores, ids

    def highest_between(self, anchor: np.ndarray, own: int, bounds: list[tuple[int, int]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pair of bounds the ``most`` rows of highest score inside, bounds included."""
        none = np.zeros(0, np.int64)
        found = [(none, none) for _ in bounds]

        def needed() -> float:
            return float(min(max(lo, int(s[-1])) if len(s) == most else lo for (lo, _), (s, _) in zip(bounds, found)))

        for s, i in self._met(anchor, own, needed):
            for j, (lo, hi) in enumerate(bounds):
                held = found[j]
                inside = (s <= hi) & (s >= (held[0][-1] if len(held[0]) == most else lo))
                if inside.any():
                    found[j] = best_first(np.concatenate([held[0], s[inside]]), np.concatenate([held[1], i[inside]]), most)
        return found


# ---- tables ----

PACKED = "part long, dim int, label long, longest double, n int, ids binary, vectors binary"


def _pack(most: int):
    """Consecutive rows of one dimension and label as rows of up to ``most`` vectors."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            part = pa.Table.from_batches(held).combine_chunks()
            vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = part["id"].to_numpy()
            row = {
                "part": pa.array([number], pa.int64()), "dim": pa.array([part["dim"][0].as_py()], pa.int32()), "label": pa.array([part["label"][0].as_py()], pa.int64()),
                "longest": pa.array([max(part["length"].to_pylist())], pa.float64()), "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([vectors.astype(np.int32).tobytes()], pa.binary()),
            }
            number += 1
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, label = batch.column("dim").to_numpy(), batch.column("label").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(label) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and key != (dim[lo], label[lo]):
                    yield packed()
                key = (dim[lo], label[lo])
                while lo < hi:
                    step = min(hi - lo, most - sum(b.num_rows for b in held))
                    held.append(batch.slice(lo, step))
                    lo += step
                    if sum(b.num_rows for b in held) == most:
                        yield packed()
        if held:
            yield packed()

    return run


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}vectors"], np.int32).reshape(-1, row["dim"]).astype(np.int64)


def _met(search, schema: pa.Schema):
    """Applies ``search(shelf, row)`` to rows that hold a shelf and a chunk; the shelf of the row before is kept."""

    def run(batches):
        held, shelf = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}
                if held != row["part"]:
                    held, shelf = row["part"], Shelf(*_unpacked(row))
                out = list(search(shelf, row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _schema(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _positives(most: int):
    def search(shelf: Shelf, row: dict):
        ids, anchors = _unpacked(row, "a_")
        for place, (own, anchor) in enumerate(zip(ids.tolist(), anchors)):
            for score, other in zip(*(x.tolist() for x in shelf.highest(anchor, own, most))):
                yield row["chunk"], place, own, other, score

    return _met(search, _schema("chunk", "place", "anchor_id", "positive_id", "positive_score"))


def _negatives(most: int, low: int, high: int):
    def search(shelf: Shelf, row: dict):
        ids, anchors = _unpacked(row, "a_")
        wanted: dict[int, list[int]] = {}
        for x in row["wanted"]:
            wanted.setdefault(x["place"], []).append(x["positive_score"])
        for place, scores in wanted.items():
            bounds = [(-(-low * s // 100), high * s // 100) for s in scores]
            for s, found in zip(scores, shelf.highest_between(anchors[place], int(ids[place]), bounds, most)):
                for score, other in zip(*(x.tolist() for x in found)):
                    yield row["chunk"], place, s, other, score

    return _met(search, _schema("chunk", "place", "positive_score", "negative_id", "negative_score"))


def usable_rows(vectors: DataFrame, anchor: Column, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``id, label, dim, length, vector, anchor`` of the rows that take part, each once; components are ``floor(scale * x)``."""
    x = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)))
    scaled = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * F.lit(float(scale))).cast("double"), 2)))
    rows = rows.select("id", "label", F.size("x").alias("dim"), length.alias("length"), "x", "anchor").where(F.col("length") < LONGEST)
    return rows.groupBy("id", "label", "dim", "length", scaled.alias("vector")).agg(F.max("anchor").alias("anchor"))


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shelf_rows: int = SHELF_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    Scores are inner products of ``floor(scale * x)``. An anchor's positives are its ``positives`` other rows of the same label with the
    highest scores; for each, the ``negatives`` rows of other labels with the highest scores from ``low`` to ``high`` percent of the
    positive's. Ties go to the smaller id; fewer rows are returned where fewer exist. Rows without id, label or vector, with an empty
    vector, a null or a non-finite number, or of a scaled length of 2^31 and more take no part. Vectors meet those of their own
    dimension only. Equal rows count once; rows that share an id but not the vector are rows of their own, and none is the other's
    positive or negative. Extra columns are ignored.
    """
    rows = materialise(usable_rows(vectors, anchor, id_column, vector_column, label_column, scale), "lemp-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    def packed(df: DataFrame, n: int, most: int, name: str) -> DataFrame:
        keys = [F.col("dim"), F.col("label"), F.desc("length"), F.col("id")]
        spread = df.repartitionByRange(max(1, -(-n // (4 * most))), *keys).sortWithinPartitions(*keys)
        return materialise(spread.mapInArrow(_pack(most), PACKED), name)

    chosen = rows.where("anchor")
    shelves = packed(rows, size, shelf_rows, "lemp-shelves")
    chunks = packed(chosen, chosen.count(), CHUNK_ANCHORS, "lemp-chunks")
    chunks = chunks.select("dim", "label", F.col("part").alias("chunk"), F.col("longest").alias("a_longest"), F.col("ids").alias("a_ids"), F.col("vectors").alias("a_vectors"))
    places = materialise(shelves.select("part", "dim", "label", "longest"), "lemp-places")
    held = shelves.select("part", "ids", "vectors")

    pairs = join_small(chunks, places.drop("longest"), ["dim", "label"], row_key="chunk", written=True)
    met = pairs.select("part", "dim", "chunk", "a_ids", "a_vectors").join(held, "part")
    fields = "chunk long, place long, anchor_id long, positive_id long, positive_score long"
    found = met.mapInArrow(_positives(positives), fields)
    order = Window.partitionBy("chunk", "place").orderBy(F.desc("positive_score"), F.asc("positive_id"))
    found = found.withColumn("k", F.row_number().over(order)).where((F.col("k") <= positives) & (F.col("positive_score") >= 0)).drop("k")
    found = materialise(found, "lemp-positives")

    # equal scores of an anchor have equal negatives
    wanted = found.groupBy("chunk").agg(F.collect_set(F.struct("place", "positive_score")).alias("wanted"), F.min("positive_score").alias("least"))
    other = places.select("part", "dim", F.col("label").alias("other"), "longest")
    pairs = join_small(chunks.join(wanted, "chunk"), other, ["dim"], row_key="chunk", written=True)
    reach = F.col("a_longest") * F.col("longest") * (1 + SLACK) >= F.col("least") * low / 100
    pairs = pairs.where((F.col("label") != F.col("other")) & reach).select("part", "dim", "chunk", "a_ids", "a_vectors", "wanted")
    fields = "chunk long, place long, positive_score long, negative_id long, negative_score long"
    against = pairs.join(held, "part").mapInArrow(_negatives(negatives, low, high), fields)
    order = Window.partitionBy("chunk", "place", "positive_score").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    best = against.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = found.join(best, ["chunk", "place", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
