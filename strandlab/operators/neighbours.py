"""Nearest centre and silhouette."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import arrays
from strandlab.operators.blocks import dataset_sizes, matrix
from strandlab.operators.joining import join_small
from strandlab.operators.prep import DATASET, SERIES, SERIES_ID

TILE_BYTES = 16 << 20
LINE_ROWS = 32 << 10  # bounds the work of a tile where rows are short
FINE_LINES = 8  # a wish for finer tiles is kept up to so many lines, since a row is sent once per line
CHUNK = 1024
NEAR = 1e-5  # pairs whose squared distance is a smaller share of their squared lengths are measured by their difference


def pack_centres(centres: DataFrame, key: str = DATASET) -> DataFrame:
    """One row per data set with its centres in cluster order (as many as classes)."""
    return centres.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("_centres"))


def nearest_centre(df: DataFrame, centres: DataFrame, key: str = DATASET, series: str = SERIES) -> DataFrame:
    """Add the closest centre of the same data set (``cluster``) and its ``distance``; the least cluster wins a tie.

    The centres are broadcast up to a checked size and salted beyond it.
    """
    packed = pack_centres(centres, key)
    joined = join_small(df, packed, key, numbers=F.size("_centres") * F.size(F.col("_centres")[0]["centre"]))
    scored = F.transform(
        "_centres",
        lambda c: F.struct(arrays.squared_distance(F.col(series), c["centre"]).alias("d2"), c["cluster"].alias("cluster")),
    )
    best = joined.withColumn("_best", F.array_min(scored)).drop("_centres")
    return best.withColumn("cluster", F.col("_best.cluster")).withColumn("distance", F.sqrt("_best.d2")).drop("_best")


class Side:
    """Rows of one line of the grid: vectors, squared lengths, numbers that equal vectors share, and the clusters of each labeling."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.x, self.labels, self.n = x, labels, len(x)
        self.members = [np.unique(labels[:, k], return_inverse=True) for k in range(labels.shape[1])]


def _same_vectors(sides: list[Side]) -> None:
    """Numbers the vectors of a tile, equal ones alike, and moves all of them so that their lengths are as small as their gaps."""
    rows = np.ascontiguousarray(np.vstack([s.x for s in sides]))
    codes = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).reshape(-1), return_inverse=True)[1] if rows.shape[1] else np.zeros(len(rows), int)
    at = 0
    with np.errstate(all="ignore"):
        good = np.isfinite((rows * rows).sum(axis=1))
        middle = rows[good].mean(axis=0) if good.any() else 0.0
        for s in sides:
            s.codes, s.moved = codes[at : at + s.n], s.x - middle
            s.length = (s.moved * s.moved).sum(axis=1)
            s.finite = s.length < 1e300  # so that sums of two are
            s.left = np.column_stack([-2.0 * s.moved, s.length, np.ones(s.n)])
            s.right = np.column_stack([s.moved, np.ones(s.n), s.length])
            at += s.n


def _direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows that stand beside each other."""
    gaps = x - y
    return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))


def _distances(a: Side, b: Side, rows: slice, cols: slice) -> np.ndarray:
    """Distances of some rows of two sides, by one matrix product. Where its rounding would show, the difference is taken."""
    near = None
    with np.errstate(all="ignore"):
        d2 = a.left[rows] @ b.right[cols].T
        if not d2.min() >= NEAR * (a.length[rows].max() + b.length[cols].max()):
            near = d2 < NEAR * (a.length[rows, None] + b.length[None, cols])
            np.maximum(d2, 0.0, out=d2)
        dist = np.sqrt(d2, out=d2)
    if near is not None and near.any():
        i, j = np.nonzero(near)
        equal = a.codes[rows][i] == b.codes[cols][j]
        dist[i[equal], j[equal]] = 0.0
        i, j = i[~equal], j[~equal]
        step = max(1, (1 << 20) // max(1, a.x.shape[1]))
        for lo in range(0, len(i), step):
            p, q = i[lo : lo + step], j[lo : lo + step]
            dist[p, q] = _direct(a.x[rows][p], b.x[cols][q])
    # numbers that are not finite, or whose square is not
    with np.errstate(all="ignore"):
        for p in np.flatnonzero(~a.finite[rows]):
            dist[p] = _direct(a.x[rows][p], b.x[cols])
        for q in np.flatnonzero(~b.finite[cols]):
            dist[:, q] = _direct(a.x[rows], b.x[cols][q])
    return dist


def _add_by_cluster(dist: np.ndarray, member: np.ndarray, out: np.ndarray, finite: bool) -> None:
    """Adds the columns of ``dist`` to ``out`` by their cluster."""
    if finite and out.shape[1] <= 64:
        out += dist @ (member[:, None] == np.arange(out.shape[1])).astype("float64")
        return
    order = np.argsort(member, kind="stable")
    ordered = member[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out[:, ordered[starts]] += np.add.reduceat(dist[:, order], starts, axis=1)


def _tile_sums(a: Side, b: Side) -> list[list[np.ndarray]]:
    """For both sides and each labeling: summed distances of its rows to each cluster of the other. One side with itself is summed once."""
    _same_vectors([a] if a is b else [a, b])
    first = [np.zeros((a.n, len(names))) for names, _ in b.members]
    second = [] if a is b else [np.zeros((b.n, len(names))) for names, _ in a.members]
    for r in range(0, a.n, CHUNK):
        rows = slice(r, min(r + CHUNK, a.n))
        for c in range(0, b.n, CHUNK):
            cols = slice(c, min(c + CHUNK, b.n))
            dist = _distances(a, b, rows, cols)
            finite = bool(a.finite[rows].all() and b.finite[cols].all())
            for k, out in enumerate(first):
                _add_by_cluster(dist, b.members[k][1][cols], out[rows], finite)
            for k, out in enumerate(second):
                _add_by_cluster(dist.T, a.members[k][1][rows], out[cols], finite)
    return [first] if a is b else [first, second]


def distance_sums_of_labelings(
    df: DataFrame, labelings: str = "clusters", tile_bytes: int = TILE_BYTES, key: str = DATASET, tile_rows: int | None = None
) -> DataFrame:
    """Per row, labeling and cluster the summed distance to the rows of that cluster in the same data set.

    ``labelings`` is an array with one cluster number per labeling; all labelings share one pass over the distances. A data set
    becomes a triangle of tiles: its rows lie on lines of at most about ``tile_bytes`` and ``LINE_ROWS``, and a tile holds two lines,
    however large the data set is. ``tile_rows`` asks for shorter lines, of which a data set gets up to ``FINE_LINES``: every row goes to
    each line, so more lines than memory needs only add to what is sent. A tile measures each distance once and returns sums for the
    rows of both lines, never a pair; sums of one task are added up before they travel.
    """
    lines = F.greatest(F.ceil(F.col("n") * F.col("d") * 8 / tile_bytes), F.ceil(F.col("n") / LINE_ROWS))
    if tile_rows:
        lines = F.greatest(lines, F.least(F.ceil(F.col("n") / tile_rows), F.lit(FINE_LINES)))
    counted = dataset_sizes(df, key).select(key, F.greatest(lines, F.lit(1)).cast("int").alias("_lines"))
    rows = df.select(key, SERIES_ID, F.col(labelings).cast("array<bigint>").alias("clusters"), SERIES)
    rows = join_small(rows, counted, key)
    rows = rows.withColumn("_line", F.pmod(F.xxhash64(SERIES_ID), "_lines").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_lines") - 1)))
    tiles = rows.select(key, F.least("_line", "_other").alias("_i"), F.greatest("_line", "_other").alias("_j"), "_line", SERIES_ID, "clusters", SERIES)
    schema = f"{key} string, {SERIES_ID} bigint, labeling int, cluster bigint, other bigint, total double"

    def side(table: pa.Table) -> tuple[np.ndarray, Side]:
        return table[SERIES_ID].to_numpy(), Side(matrix(table), matrix(table, "clusters").astype("int64"))

    def tile(keys: tuple, table: pa.Table) -> pa.Table:
        name, i, j = (k.as_py() for k in keys)
        at = table["_line"].to_numpy()
        sides = [side(table.filter(pa.array(at == line))) for line in ([i] if i == j else [i, j])]
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        (_, a), (_, b) = sides[0], sides[-1]
        for (ids, mine), (_, other), found in zip(sides, sides[::-1], _tile_sums(a, b) if a.n and b.n else []):
            for k, sums in enumerate(found):
                names = other.members[k][0]
                out[0].append(np.repeat(ids, len(names)))
                out[1].append(np.full(sums.size, k, "int32"))
                out[2].append(np.repeat(mine.labels[:, k], len(names)))
                out[3].append(np.tile(names, len(ids)))
                out[4].append(sums.reshape(-1))
        columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, ("int64", "int32", "int64", "int64", "float64"))]
        return pa.table([pa.array([name] * len(columns[0]), pa.string()), *map(pa.array, columns)],
                        names=[key, SERIES_ID, "labeling", "cluster", "other", "total"])

    partial = tiles.groupBy(key, "_i", "_j").applyInArrow(tile, schema)
    return partial.groupBy(key, SERIES_ID, "labeling", "cluster", "other").agg(F.sum("total").alias("total"))


def distance_sums(
    df: DataFrame, tile_rows: int | None = None, key: str = DATASET, cluster: str = "cluster", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """Per row and cluster the summed distance to the rows of that cluster in the same data set."""
    one = df.withColumn("clusters", F.array(F.col(cluster).cast("bigint")))
    return distance_sums_of_labelings(one, "clusters", tile_bytes, key, tile_rows).drop("labeling")


def _silhouettes(sums: DataFrame, sizes: DataFrame, key: str, by: list[str]) -> DataFrame:
    sums = sums.join(sizes, [key, *by, "other"])
    own = F.col("cluster") == F.col("other")
    mean_own = F.when(own & (F.col("_n") > 1), F.col("total") / (F.col("_n") - 1))
    mean_other = F.when(~own, F.col("total") / F.col("_n"))
    sides = sums.groupBy(key, *by, SERIES_ID).agg(F.max(mean_own).alias("_a"), F.min(mean_other).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    width = F.when(a.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return sides.where(b.isNotNull()).select(key, *by, SERIES_ID, width.alias("silhouette"))


def silhouette_rows(df: DataFrame, tile_rows: int | None = None, key: str = DATASET, cluster: str = "cluster") -> DataFrame:
    """Exact Euclidean silhouette of every row; 0 in a cluster of one. A data set of one cluster has no rows."""
    sizes = df.groupBy(key, F.col(cluster).cast("bigint").alias("other")).agg(F.count(F.lit(1)).alias("_n"))
    return _silhouettes(distance_sums(df, tile_rows, key, cluster), sizes, key, [])


def silhouette_score(df: DataFrame, tile_rows: int | None = None, key: str = DATASET, cluster: str = "cluster") -> DataFrame:
    return silhouette_rows(df, tile_rows, key, cluster).groupBy(key).agg(F.avg("silhouette").alias("ss"))


def silhouette_scores_of_labelings(df: DataFrame, labelings: str = "clusters", key: str = DATASET, tile_rows: int | None = None) -> DataFrame:
    """Mean silhouette per data set and place in the array ``labelings``, from one pass over the distances."""
    each = df.select(key, F.posexplode(labelings).alias("labeling", "other"))
    sizes = each.groupBy(key, "labeling", F.col("other").cast("bigint").alias("other")).agg(F.count(F.lit(1)).alias("_n"))
    sums = distance_sums_of_labelings(df, labelings, key=key, tile_rows=tile_rows)
    return _silhouettes(sums, sizes, key, ["labeling"]).groupBy(key, "labeling").agg(F.avg("silhouette").alias("ss"))
