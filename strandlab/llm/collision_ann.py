"""Nearest neighbours by collision counting: single random projections, sorted, with windows around the query that grow.

A block of vectors is indexed by one sorted array per projection. A query opens a window around its own projection in every array.
Windows widen in steps (virtual rehashing: the same arrays serve every radius); a vector that lies in enough windows is verified on the
original numbers. A query ends in a block when as many neighbours as wanted are verified within the radius its windows stand for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.task_state import STATE_BYTES, Sent, in_turns
from strandlab.session import materialise

NEIGHBOURS = 10
PROJECTIONS = 96  # at most 255: collisions are counted in bytes
WINDOW = 2.185  # width of a window of radius 1; the value for steps of 1.2 in distance
THRESHOLD = 0.62  # share of the windows a vector must lie in; 0.725 are expected at the radius
STEP = 1.1
BLOCK_VECTORS = 4096
CHUNK_QUERIES = 256
TASK_PAIRS = 1 << 28  # pairs of query and vector from which the blocks are dealt to more tasks than shuffle partitions
SCALE_SAMPLE = 16


def projections(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([dim, count, 7]).standard_normal((dim, count))


def usable(column: str):
    """True for vectors that have numbers, all finite, and not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


class Block:
    """Vectors with one sorted array per projection, and the place of each vector in each array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if len(ids) > BLOCK_VECTORS:
            raise ValueError(f"a block holds at most {BLOCK_VECTORS} vectors")
        self.ids, self.vectors = ids, vectors
        self.projections = projections(vectors.shape[1])
        moved = (vectors @ self.projections).T
        order = np.argsort(moved, axis=1, kind="stable")
        self.sorted = np.take_along_axis(moved, order, axis=1)
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        some = np.linspace(0, len(ids) - 1, min(SCALE_SAMPLE, len(ids))).astype(np.int64)
        near = np.sqrt(np.maximum(((vectors[some, None, :] - vectors[None, :, :]) ** 2).sum(2), 0.0))
        near.sort(axis=1)
        #: where windows start: a little below the usual distance of the wanted neighbour
        self.radius = 0.9 * float(np.median(near[:, min(NEIGHBOURS, near.shape[1] - 1)]))
        self.size = float(np.sqrt((vectors**2).sum(1).max()))

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each query's window in each sorted array."""
        lo = np.stack([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, at)], axis=1)
        hi = np.stack([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at)], axis=1)
        return lo.astype(np.uint16), (hi - lo).astype(np.uint16)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the nearest verified vectors other than its own: ids and distances, ties to smaller ids."""
        needed = int(np.ceil(THRESHOLD * len(self.sorted)))
        at = (queries @ self.projections).T
        seen = [self.ids == q for q in query_ids.tolist()]
        wanted = [min(k, int((~own).sum())) for own in seen]
        found: list[list[np.ndarray]] = [[] for _ in seen]
        far: list[list[np.ndarray]] = [[] for _ in seen]
        active = [q for q in range(len(seen)) if wanted[q]]
        moved, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        radius, step = 1e-9 * (self.size + float(np.sqrt((queries**2).sum(1).max(initial=0.0)))), STEP
        while active:
            low, width = self._windows(at[:, active], WINDOW / 2 * radius)
            left = []
            for row, q in enumerate(active):
                # unsigned: a place before the window wraps around and lies beyond its width
                np.subtract(self.place, low[row][:, None], out=moved)
                np.less(moved, width[row][:, None], out=inside)
                count = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
                new = np.flatnonzero((count >= needed) & ~seen[q])
                if len(new):
                    seen[q][new] = True
                    found[q].append(new)
                    far[q].append(np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(1)))
                if sum(int((d <= radius).sum()) for d in far[q]) < wanted[q] and not seen[q].all():
                    left.append(q)
            active = left
            if radius < self.radius:
                radius = self.radius
            else:
                radius = max(radius * step, 1e-12)
                step *= STEP if radius > 4 * self.radius else 1.0
        out = []
        for q in range(len(seen)):
            rows = np.concatenate(found[q]) if found[q] else np.zeros(0, np.int64)
            distance = np.concatenate(far[q]) if far[q] else np.zeros(0)
            best = np.lexsort((self.ids[rows], distance))[: wanted[q]]
            out.append((self.ids[rows[best]], distance[best]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch):
    """Row numbers of equal vector length."""
    sizes = np.asarray(batch.column(1).value_lengths())
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


PACKED = "part long, dim int, ids binary, vectors binary"


def _pack_batches(most: int):
    """Rows of up to ``most`` vectors of one length, as bytes."""

    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for dim, rows in _by_size(batch):
                for lo in range(0, len(rows), most):
                    part = batch.take(pa.array(rows[lo : lo + most]))
                    ids = np.asarray(part.column(0), np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {"part": [base + k], "dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "vectors": [_matrix(part.column(1)).tobytes()]}
                    )
                    k += 1

    return run


class Asked:
    """A chunk of queries of one length, and the nearest of what the blocks so far have answered."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def meet(self, block: Block, k: int) -> None:
        for q, found in enumerate(block.search(self.ids, self.vectors, k)):
            ids, distance = (np.concatenate(x) for x in zip(self.best[q], found))
            order = np.lexsort((ids, distance))[:k]
            self.best[q] = ids[order], distance[order]

    def answers(self) -> pa.RecordBatch:
        owner = np.repeat(self.ids, [len(ids) for ids, _ in self.best])
        columns = owner, np.concatenate([b[0] for b in self.best]), np.concatenate([b[1] for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])


def _asked(packed: pa.Table) -> dict[int, list[Asked]]:
    """All queries by the length of their vectors, in even chunks however they were packed."""
    out, dims = {}, packed["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        rows = packed.filter(pa.array(dims == dim))
        ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64)
        vectors = np.frombuffer(b"".join(rows["vectors"].to_pylist())).reshape(-1, dim)
        out[dim] = [Asked(ids[lo : lo + CHUNK_QUERIES], vectors[lo : lo + CHUNK_QUERIES]) for lo in range(0, len(ids), CHUNK_QUERIES)]
    return out


def _search_batches(sent: Sent, k: int):
    """The nearest of a task's blocks for every query."""

    def run(batches):
        asked = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}
                asked = _asked(sent()) if asked is None else asked
                if row["dim"] in asked:
                    block = Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, row["dim"]))
                    for chunk in asked[row["dim"]]:
                        chunk.meet(block, k)
        for chunks in (asked or {}).values():
            for chunk in chunks:
                yield chunk.answers()

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", neighbours: int = NEIGHBOURS,
    state_bytes: int = STATE_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of ``vectors`` found for each row of ``queries``, by Euclidean distance.

    All rows are indexed, block by block where they lie. The queries are sent to every task once, with room for their answers in turns of
    ``state_bytes``; a task answers with the nearest of all its blocks. Null or empty vectors, those with a null or non-finite number and zero
    vectors take no part, nor do rows with a null id; vectors are compared with those of their own length. A query's own row (equal id) is
    no neighbour. Ties go to the smaller id. Where fewer candidates exist, all are returned. Extra columns are ignored.
    """
    def packed(df: DataFrame, most: int, name: str) -> DataFrame:
        rows = df.where(F.col(id_column).isNotNull() & usable(vector_column))
        rows = rows.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>"))
        return materialise(rows.mapInArrow(_pack_batches(most), PACKED), name)

    index = packed(vectors, BLOCK_VECTORS, "blocks")
    chunks = packed(queries.select(id_column, vector_column), CHUNK_QUERIES, "query-chunks")
    blocks, indexed = index.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(rows: DataFrame, sent: Sent) -> DataFrame:
        asked = rows.agg(F.sum(F.octet_length("ids"))).first()[0]
        pairs = (asked or 0) // 8 * (indexed or 0) // 8
        tasks = max(1, min(blocks, max(spread, pairs // TASK_PAIRS)))
        return index.repartitionByRange(tasks, "part").mapInArrow(_search_batches(sent, neighbours), "query_id long, vec_id long, score double")

    # a query takes its vector, its answers and the two arrays that hold them
    held = F.octet_length("vectors") / 8 + F.octet_length("ids") / 8 * (2 * neighbours + 32)
    found = in_turns(chunks, ["part", "dim"], held, search, state_bytes)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return best.select("query_id", "rank", "vec_id", "score")
