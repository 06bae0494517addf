"""Near-duplicate documents by min-max hashing.

Every permutation gives two values of a shingle set, its smallest and its largest hash; both agree between two sets with the
probability of their similarity, so a signature of 112 values costs 56 hash evaluations per shingle. Bands of four
values are the buckets. Documents of a bucket are compared with its centre, the one that lies in the fullest buckets. Where
that does not show that all of them belong together, the bucket is looked at in tiles, each of which computes all
intersections of its documents as one matrix product and returns a forest of links. All links hold on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.components import components
from strandlab.llm.words import WordReader, chunks_of, list_array, mix, odd_numbers, signed, windows
from strandlab.session import materialise

SHINGLE_WORDS = 5
PERMUTATIONS = 56
BAND_VALUES = 4
SIMILARITY = 80
TILE_DOCUMENTS = 256
TILE_CELLS = 1 << 20
BROADCAST_IDS = 1 << 20


def _distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per row."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, starts: np.ndarray, permutations: int, band_values: int) -> np.ndarray:
    """Band keys of rows that have shingles, one column per band. Two values, least and largest, per permutation."""
    factor, shift = odd_numbers(41, permutations), odd_numbers(43, permutations)
    values = np.empty((len(starts), 2 * permutations), np.uint64)
    for p in range(permutations):
        moved = (hashes ^ shift[p]) * factor[p]
        values[:, 2 * p] = np.minimum.reduceat(moved, starts)
        values[:, 2 * p + 1] = np.maximum.reduceat(moved, starts)
    weight = odd_numbers(47, band_values)
    bands = values.reshape(len(starts), -1, band_values)
    keys = mix((mix(bands) * weight).sum(axis=2, dtype=np.uint64))
    return mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signature_batches(id_column: str, text_column: str, words: int, permutations: int, band_values: int):
    def run(batches):
        reader = WordReader(lower=True)
        for batch, data, offsets in chunks_of(batches, text_column):
            starts, ends, first = reader.places(data, offsets)
            shingles, at = windows(reader.hashes(data, starts, ends), first, words, short=True)
            shingles, at = _distinct(shingles, at)
            size = np.diff(at)
            full = np.flatnonzero(size)
            prints = np.zeros((2, len(size)), np.uint64)
            bands = 2 * permutations // band_values
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                prints[0, full] = np.add.reduceat(mix(shingles ^ np.uint64(1)), at[full])
                prints[1, full] = np.add.reduceat(mix(shingles ^ np.uint64(2)), at[full])
                keys = signatures(shingles, at[full], permutations, band_values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64()),
                    pa.array(size),
                    pa.array(signed(prints[0])),
                    pa.array(signed(prints[1])),
                    list_array(signed(keys.reshape(-1)), np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])),
                ],
                names=["doc_id", "n_shingles", "print_a", "print_b", "keys"],
            )

    return run


def _set_batches(id_column: str, text_column: str, words: int):
    def run(batches):
        reader = WordReader(lower=True)
        for batch, data, offsets in chunks_of(batches, text_column):
            starts, ends, first = reader.places(data, offsets)
            shingles, at = windows(reader.hashes(data, starts, ends), first, words, short=True)
            shingles, at = _distinct(shingles, at)
            ids = batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, list_array(signed(shingles), at)], names=["doc_id", "shingles"])

    return run


def _only(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``docs`` whose id is in the written table ``ids``, which is broadcast up to a counted size."""
    small = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("doc_id").alias(id_column))
    return docs.join(F.broadcast(wanted) if small else wanted, id_column, "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``a, b, linked`` for pairs of documents, on their full sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "a").join(two, "b").select(
        "a", "b", (100 * common >= similarity * (F.size("_a") + F.size("_b") - common)).alias("linked")
    )


def tile_links(sets: list[np.ndarray], sizes: np.ndarray, components: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links between documents of different components that tie together all that can be tied: no more than documents."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(1, TILE_CELLS // len(sets))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    out, label = [], components.copy()
    for i in range(len(sets)):
        for j in np.flatnonzero(linked[i] & (label != label[i])):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _tile_batches(similarity: int):
    """Tiles arrive one after the other; a tile may reach over two batches."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        whole = rows.combine_chunks()
        tile = np.stack([whole[c].to_numpy() for c in ("key", "lo", "hi")])
        starts = np.flatnonzero(np.concatenate([[True], (tile[:, 1:] != tile[:, :-1]).any(axis=0)]))
        ids, parts = whole["doc_id"].to_numpy(), whole["component"].to_numpy()
        lists = whole["shingles"].combine_chunks()
        at, values = np.asarray(lists.offsets), np.asarray(lists.values)
        sizes = np.diff(at)
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            if (parts[lo:hi] != parts[lo]).any():
                sets = [values[at[i] : at[i + 1]] for i in range(lo, hi)]
                out += [(ids[lo + i], ids[lo + j]) for i, j in tile_links(sets, sizes[lo:hi], parts[lo:hi], similarity)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            last = [rows[c][-1].as_py() for c in ("key", "lo", "hi")]
            same = np.logical_and.reduce([rows[c].to_numpy() == x for c, x in zip(("key", "lo", "hi"), last)])
            cut = int(np.flatnonzero(same)[0])
            held = rows.slice(cut)
            if cut:
                yield links(rows.slice(0, cut))
        if held is not None:
            yield links(held)

    return run


def _tile_links(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``a, b`` for documents of one bucket (``key``) that are linked and in different components.

    A bucket of several ``blocks`` is compared block by block: a row goes to every tile of its block, which holds at
    most two blocks. A tile returns links, never pairs.
    """
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = rows.withColumn("_mine", mine.cast("int")).withColumn("_other", F.explode(every))
    tiles = tiles.select(
        "key", F.least("_mine", "_other").alias("lo"), F.greatest("_mine", "_other").alias("hi"), "doc_id", "component"
    )
    tile = ["key", "lo", "hi"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.join(sets, "doc_id").repartition(parts, *tile).sortWithinPartitions(*tile, "doc_id")
    return dealt.mapInArrow(_tile_batches(similarity), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    permutations: int = PERMUTATIONS,
    band_values: int = BAND_VALUES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when at least ``similarity`` percent of their joint ``words``-word shingles are common; a
    component is named by its smallest id, which is the one kept. Null, empty and blank texts have no shingles and are
    linked with nothing; a text of fewer words is one shingle. Equal texts always share a component, as do rows that
    repeat an id. Rows with a null id keep their shingle count, have no component and are kept. Extra columns are ignored.
    Two documents of 80 percent similarity miss all 28 bands with a probability of 4 in 10 million; so do two of
    85 percent with 20 bands of 40 permutations.
    """
    def scan(fn, schema, frame):
        return frame.select(id_column, text_column).mapInArrow(fn, schema)

    signed_docs = materialise(
        scan(
            _signature_batches(id_column, text_column, words, permutations, band_values),
            "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>",
            docs,
        ),
        "signatures",
    )
    known = signed_docs.where("doc_id is not null and n_shingles > 0")
    prints = ["print_a", "print_b", "n_shingles"]
    # copies of one set: the smallest id stands for all; repeated ids are tied together by a link
    classes = materialise(known.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "classes")
    members = materialise(known.select("doc_id", *prints).join(classes, prints).select("doc_id", "rep", "n_shingles"), "class-members")
    keyed = known.join(classes.select(F.col("rep").alias("doc_id"), *prints), ["doc_id", *prints], "left_semi")
    placed = keyed.select("doc_id", "n_shingles", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    full = materialise(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    placed = materialise(placed.join(full, "key"), "placed")
    popular = placed.groupBy("doc_id").agg(F.sum("n").alias("popular"))
    placed = materialise(placed.join(popular, "doc_id").drop("n"), "placed")
    wanted = materialise(placed.select("doc_id").distinct(), "candidates")
    sets = materialise(
        scan(_set_batches(id_column, text_column, words), "doc_id long, shingles array<long>", _only(docs, wanted, id_column)), "sets"
    )
    same_id = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    tied = materialise(same_id.join(repeated, "a", "left_semi").select("a", "b"), "tied")

    # first all documents of a bucket against its centre
    rank = F.struct(F.col("popular").alias("r"), (-F.col("doc_id")).alias("i"), "n_shingles")
    centres = placed.groupBy("key").agg(F.max(rank).alias("c")).select("key", (-F.col("c.i")).alias("b"), F.col("c.n_shingles").alias("n_b"))
    fits = F.expr(f"a <> b and 100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    pairs = placed.select("key", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a")).join(centres, "key").where(fits)
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = tied.unionByName(materialise(_confirmed(pairs, sets, similarity), "checked").where("linked").select("a", "b"))
    # then the buckets whose documents are not yet known to belong together, in tiles of bounded size
    found = components(links).withColumnRenamed("node", "doc_id")
    here = placed.join(found, "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    here = materialise(here, "with-components")
    sizes = here.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count(F.lit(1)).alias("n")).where("l < h")
    blocks = F.ceil(F.col("n") / TILE_DOCUMENTS).cast("int").alias("blocks")
    open_rows = here.join(sizes.select("key", blocks), "key")
    links = links.unionByName(materialise(_tile_links(open_rows, sets, similarity), "tile-links"))
    parts = materialise(components(links).withColumnRenamed("node", "rep"), "components")
    named = members.join(parts, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = signed_docs.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that are kept: one document of each component, with all columns.

    Of rows that repeat an id within one component, the one with the smallest hash of its columns stays.
    """
    decided = materialise(near_duplicates(docs, id_column, **options), "decided")
    gone = materialise(decided.where("not kept").select("doc_id").distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    gone = gone.select(F.col("doc_id").alias(id_column))
    kept = docs.join(F.broadcast(gone) if small else gone, id_column, "left_anti")
    repeated = materialise(
        decided.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated"
    )
    if repeated.isEmpty():
        return kept
    ids = repeated.select(F.col("doc_id").alias(id_column))
    single = kept.join(ids, id_column, "left_anti")
    return single.unionByName(kept.join(ids, id_column, "left_semi").dropDuplicates([id_column]))
