"""Removal of repeated passages: every word run of a given length that occurs twice, found by super-k-mers.

Windows of consecutive words are cut into runs that share a minimiser (the word group of the smallest hash). A run travels as one
packed string to the bucket of its minimiser, where the windows of the bucket are sorted and counted on their real words.
Only runs whose minimiser occurs at two places travel, since a repeated window brings its minimiser along. Equal
packed strings are counted before that and travel once; a bucket of very many different strings is dealt out by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.words import WordReader, chunks_of, signed, windows
from strandlab.session import materialise

WINDOW_WORDS = 35
MINIMISER_WORDS = 8
BUCKET_STRINGS = 256
LIST_WINDOWS = 256
BROADCAST_IDS = 1 << 20


def _sliding_min(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value and its leftmost place in each window of ``size`` values (windows may pass the end)."""
    n = len(values)
    best, place, done = values.copy(), np.arange(n), 1
    while done < size:
        step = min(done, size - done)
        other = best[step:] < best[: n - step]
        best[: n - step] = np.where(other, best[step:], best[: n - step])
        place[: n - step] = np.where(other, place[step:], place[: n - step])
        done += step
    return best, place


def runs_of_windows(word_hash: np.ndarray, first: np.ndarray, window: int, group: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, minimiser and number of its leftmost places, for each run of windows."""
    words = np.diff(first)
    count = np.maximum(words - window + 1, 0)
    total = int(count.sum())
    if not total:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    grams, _ = windows(word_hash, np.array([0, len(word_hash)]), group, seed=71)
    least, place = _sliding_min(grams, window - group + 1)
    before = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(total) - np.repeat(before, count)
    at = inside + first[:-1][row]
    least, place = least[at], place[at]
    new = np.ones(total, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    moved = np.ones(total, np.int64)
    moved[1:] = new[1:] | (place[1:] != place[:-1])
    return row[starts], inside[starts], np.diff(starts, append=total), least[starts], np.add.reduceat(moved, starts)


def _run_batches(window: int, group: int):
    def run(batches):
        reader = WordReader(lower=False)
        for batch, data, offsets in chunks_of(batches):
            starts, ends, first = reader.places(data, offsets)
            row, start, count, least, places = runs_of_windows(reader.hashes(data, starts, ends), first, window, group)
            ids = batch.select(["doc_id", "text_key"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(signed(least)), pa.array(places, pa.int32())],
                names=["doc_id", "text_key", "start", "count", "least", "places"],
            )

    return run


def _pack_batches(window: int):
    """Runs of a document to packed strings: their words, joined by one space."""

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out = {k: [] for k in ("doc_id", "text_key", "start", "least", "packed")}
            size = 0
            for doc_id, key, text, runs in zip(cols["doc_id"], cols["text_key"], cols["text"], cols["runs"]):
                words = text.encode().split()
                for r in runs:
                    packed = b" ".join(words[r["start"] : r["start"] + r["count"] + window - 1])
                    for k, v in zip(out, (doc_id, key, r["start"], r["least"], packed)):
                        out[k].append(v)
                    size += len(packed)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=PACKED)
                    out, size = {k: [] for k in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=PACKED)

    return run


PACKED = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("least", pa.int64()), ("packed", pa.binary())]
)
FOUND = pa.schema([("least", pa.int64()), ("string_key", pa.int64()), ("offsets", pa.list_(pa.int32()))])


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """All windows of a packed string, as strings."""
    places = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    starts = np.concatenate([[0], places + 1]).tolist()
    ends = [*places.tolist(), len(packed)]
    return [packed[a:b] for a, b in zip(starts, ends[window - 1 :])]


def repeated_in_bucket(strings: list[tuple[int, bytes, int]], window: int) -> list[tuple[int, list[int]]]:
    """Repeated windows of a bucket. ``strings``: key, packed words and number of occurrences."""
    hits: dict[int, list[int]] = {}
    single = []
    for key, packed, n in strings:
        found = windows_of(packed, window)
        if n > 1:
            hits[key] = list(range(len(found)))
        single += [(w, key, i) for i, w in enumerate(found)]
    single.sort()
    for j, (w, key, i) in enumerate(single):
        if (j and single[j - 1][0] == w) or (j + 1 < len(single) and single[j + 1][0] == w):
            hits.setdefault(key, []).append(i)
    return [(key, sorted(set(found))) for key, found in hits.items()]


def _bucket_batches(window: int):
    """Buckets arrive one after the other; a bucket may reach over two batches."""

    def run(batches):
        least, strings = None, []
        for batch in batches:
            out = []
            for b, key, packed, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("least", "string_key", "packed", "n"))):
                if b != least:
                    out += [(least, *x) for x in repeated_in_bucket(strings, window)] if strings else []
                    least, strings = b, []
                strings.append((key, packed, n))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else ([], [], []), FOUND.types)], schema=FOUND)
        if strings:
            out = [(least, *x) for x in repeated_in_bucket(strings, window)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else ([], [], []), FOUND.types)], schema=FOUND)

    return run


def _prints(packed: bytes, window: int) -> np.ndarray:
    """128 bits for each window of a packed string."""
    joined = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows_of(packed, window))
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def _window_batches(window: int):
    """Different windows of the strings of large buckets and how often they are seen, added up per batch."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[int, int, int], int] = {}
            for b, packed, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("least", "packed", "n"))):
                for wa, wb in _prints(packed, window).tolist():
                    seen[b, wa, wb] = seen.get((b, wa, wb), 0) + n
            least, wa, wb = zip(*seen) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (least, wa, wb, list(seen.values()))], names=["least", "wa", "wb", "n"])

    return run


def _marked_batches(window: int):
    """Places of the repeated windows (``wa, wb``) in the strings of large buckets."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("least", "string_key", "packed", "wa", "wb")]
            ends = np.asarray(cols[3].offsets)
            wa, wb = np.asarray(cols[3].values), np.asarray(cols[4].values)
            out: list[tuple] = []
            for r, (b, key, packed) in enumerate(zip(*(c.to_pylist() for c in cols[:3]))):
                mine = slice(ends[r], ends[r + 1])
                prints = _prints(packed, window)
                maybe = np.flatnonzero(np.isin(prints[:, 0], wa[mine]))
                if len(maybe):
                    wanted = set(zip(wa[mine].tolist(), wb[mine].tolist()))
                    hits = [i for i in maybe.tolist() if tuple(prints[i].tolist()) in wanted]
                    if hits:
                        out.append((b, key, hits))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else ([], [], []), FOUND.types)], schema=FOUND)

    return run


def _clean_batches(window: int, columns: list[str], with_text: bool):
    """Kept words of each document. ``offsets``: first words of its repeated windows, or null."""

    def run(batches):
        for batch in batches:
            table = batch.select(columns)
            n_words, n_removed, shas, kept = [], [], [], []
            texts = batch.column(batch.schema.get_field_index("text"))
            found = batch.column(batch.schema.get_field_index("offsets"))
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                words = (text or "").encode().split()
                removed = 0
                places = found[i].as_py()
                if places:
                    change = np.zeros(len(words) + 1, np.int64)
                    places = np.unique(np.array(places))
                    np.add.at(change, places, 1)
                    np.add.at(change, places + window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed = int(gone.sum())
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                joined = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(removed)
                shas.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(text if not removed else joined.decode())
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)]
            names = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                more, names = [*more, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays([*table.columns, *more], names=[*columns, *names])

    return run


def _deal(df: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join with a written table of ids, which is broadcast up to a counted size."""
    small = ids.count() <= BROADCAST_IDS
    same = [df[k].eqNullSafe(ids[k]) for k in keys]
    return df.join(F.broadcast(ids) if small else ids, same, how)


def repeated_windows(
    docs: DataFrame, window: int = WINDOW_WORDS, group: int = MINIMISER_WORDS, bucket_strings: int = BUCKET_STRINGS
) -> DataFrame:
    """``doc_id, text_key, offsets``: first words of the windows of a document that also start elsewhere.

    ``docs`` has ``doc_id, text_key, text``; a row without such windows is absent.
    """
    if not 1 <= group <= window:
        raise ValueError("a minimiser is at most as long as a window")
    doc = ["doc_id", "text_key"]
    runs = materialise(
        docs.mapInArrow(_run_batches(window, group), "doc_id long, text_key long, start int, count int, least long, places int"), "runs"
    )
    twice = runs.groupBy("least").agg(F.sum("places").alias("k")).where("k > 1").select("least")
    carried = materialise(runs.join(twice, "least", "left_semi").drop("places"), "carried")
    listed = materialise(
        carried.groupBy(*doc).agg(F.collect_list(F.struct("start", "count", "least")).alias("runs")), "listed"
    )
    ids = listed.select(*doc)
    wanted = _deal(docs, ids, doc, "left_semi")
    # rows that repeat an id and its text bring their runs more than once, so all of them count as repeated
    with_runs = wanted.alias("d").join(
        listed.alias("r"), [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in doc]
    )
    packed = with_runs.select("d.doc_id", "d.text_key", "d.text", "runs").mapInArrow(
        _pack_batches(window), "doc_id long, text_key long, start int, least long, packed binary"
    )
    packed = materialise(packed.withColumn("string_key", F.xxhash64("packed")), "packed")
    strings = packed.groupBy("least", "string_key").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("n"))
    strings = materialise(strings, "strings")
    large = materialise(strings.groupBy("least").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > bucket_strings).select("least"), "large-buckets")
    small_side = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    ordinary = strings.join(small_side, "least", "left_anti")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by_bucket = ordinary.repartition(parts, "least").sortWithinPartitions("least").mapInArrow(
        _bucket_batches(window), "least long, string_key long, offsets array<int>"
    )
    # a window lies in one bucket only, so the repeated windows of a large bucket are brought to its strings, in lists of bounded size
    crowded = strings.join(small_side, "least", "left_semi")
    single = crowded.mapInArrow(_window_batches(window), "least long, wa long, wb long, n long")
    often = materialise(single.groupBy("least", "wa", "wb").agg(F.sum("n").alias("k")).where("k > 1").drop("k"), "often")
    lists = F.ceil(F.count(F.lit(1)) / LIST_WINDOWS).alias("lists")
    often = often.join(often.groupBy("least").agg(lists), "least").withColumn("part", F.pmod("wa", "lists"))
    pairs = often.groupBy("least", "part").agg(F.collect_list(F.struct("wa", "wb")).alias("w"))
    often = materialise(pairs.select("least", F.col("w.wa").alias("wa"), F.col("w.wb").alias("wb")), "often-lists")
    by_window = crowded.join(often, "least").select("least", "string_key", "packed", "wa", "wb").mapInArrow(
        _marked_batches(window), "least long, string_key long, offsets array<int>"
    )
    found = materialise(by_bucket.unionByName(by_window), "repeated")
    places = packed.select(*doc, "start", "least", "string_key").join(found, ["least", "string_key"])
    places = materialise(places.select(*doc, F.transform("offsets", lambda o: o + F.col("start")).alias("offsets")), "places")
    return places.groupBy(*doc).agg(F.flatten(F.collect_list("offsets")).alias("offsets"))


def drop_repeated_passages(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW_WORDS,
    group: int = MINIMISER_WORDS,
    bucket_strings: int = BUCKET_STRINGS,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) for every row of ``docs``.

    Removed is each word that lies in a run of ``window`` words which also starts at another place, in the same or in another
    row; all runs are judged on the input. Words are what white space separates. A null, empty or short text loses nothing; so
    does a document without repeats, whose ``kept_text`` is the text itself, else the kept words joined by one space. Rows that
    repeat an id and its text are two places. Null ids are allowed. Extra columns are ignored.
    """
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text")
    )
    doc = ["doc_id", "text_key"]
    found = materialise(repeated_windows(docs, window, group, bucket_strings), "found")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    clean = _clean_batches(window, ["doc_id"], with_text)
    ids = found.select(*doc)
    rest = _deal(docs, ids, doc, "left_anti").withColumn("offsets", F.lit(None).cast("array<int>"))
    hit = _deal(docs, ids, doc, "left_semi").alias("d").join(
        found.alias("f"), [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in doc]
    )
    hit = hit.select("d.doc_id", "d.text_key", "d.text", "offsets")
    return rest.mapInArrow(clean, kind).unionByName(hit.mapInArrow(clean, kind))
