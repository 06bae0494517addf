"""Benchmark passages in documents, found by templates: numbers, names and units become typed placeholders.

Windows of the benchmark and of the documents meet in a hash join, by their template words and by their words. Windows of one item that lie on one line of
offsets are one occurrence, whose words are compared place by place: windows count whose fillers stand for each other one to
one, or are equal, so a question with other numbers or names is caught, and mere chance likeness is not.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.words import WordReader, chunks_of, mix, odd_numbers, signed, windows
from strandlab.session import materialise

WINDOW_WORDS = 8
COVERED = 0.5
VERBATIM_WORDS = 14  # 13 equal words in a question with other numbers are no leak (case 103 of the tests)
SMALLEST_ITEM = 5
FILTER_BITS = 24
LITERAL_WORDS = 3
SEED = 93
BROADCAST_ROWS = 1 << 17
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s ms min h hz khz mhz ghz b kb mb gb tb w kw v a k c f mph kmh inch inches foot feet yard yards mile miles "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres second seconds minute minutes "
    "hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent degree degrees".split()
)
# all bytes but letters, digits and those beyond ASCII separate words; a point or comma between digits does not
SEPARATORS = tuple(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
NUMBER_MARK, NAME_MARK, UNIT_MARK = 1, 2, 3


def small_letters(data: np.ndarray) -> np.ndarray:
    """Small letters for the two-byte capitals of the Latin and Cyrillic alphabets; one-byte ones are left to the word reader."""
    out = data.copy()
    for lead, lo, hi, new_lead, step in ((0xC3, 0x80, 0x9E, 0xC3, 32), (0xD0, 0x90, 0x9F, 0xD0, 32), (0xD0, 0xA0, 0xAF, 0xD1, -32)):
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= lo) & (data[at + 1] <= hi) & ((lead != 0xC3) | (data[at + 1] != 0x97))]
        out[at] = new_lead
        out[at + 1] = (data[at + 1].astype(np.int64) + step).astype(np.uint8)
    return out


class Template(NamedTuple):
    """Words of a run of rows: places, number of each row's first word, hash of the template word, hash of the word, kind of placeholder."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    template: np.ndarray
    word: np.ndarray
    kind: np.ndarray


class TemplateReader:
    """Turns texts into template words.

    A word with a digit is a number. A unit is one of a fixed list right after a number. A name is a word of a capital and small
    letters that does not open a sentence: the word before it ends with a letter or digit and is followed by one space only. All else
    stands for itself, in lower case.
    """

    def __init__(self):
        self.reader = WordReader(lower=True, separators=SEPARATORS, seed=91)
        units = sorted(UNITS)
        data = np.frombuffer(" ".join(units).encode(), np.uint8)
        starts, ends, _ = self.reader.places(data, np.array([0, len(data)]))
        self.units = np.sort(self.reader.hashes(data, starts, ends))
        self.marks = mix(np.arange(4, dtype=np.uint64) + np.uint64(0x5EED))

    def read(self, data: np.ndarray, offsets: np.ndarray) -> Template:
        starts, ends, first = self.reader.places(data, offsets)
        n = len(starts)
        if not n:
            empty = np.zeros(0, np.uint64)
            return Template(starts, ends, first, empty, empty, np.zeros(0, np.int8))
        digit = (data >= 48) & (data <= 57)
        has_digit = np.add.reduceat(np.concatenate([digit, [False]]).astype(np.int32), np.stack([starts, ends], 1).reshape(-1))[::2] > 0
        gap = np.ones(n, np.int64) * 9
        gap[1:] = starts[1:] - ends[:-1]
        row_first = np.zeros(n, bool)
        row_first[first[:-1][first[:-1] < n]] = True
        mark = data[np.minimum(ends, len(data) - 1)]
        joined = np.zeros(n, bool)  # written together with the word before by a point or comma between digits
        joined[1:] = (gap[1:] == 1) & np.isin(mark[:-1], [44, 46]) & digit[starts[1:]] & digit[ends[:-1] - 1] & ~row_first[1:]
        if joined.any():
            head = np.flatnonzero(~joined)
            tail = np.append(head[1:], n) - 1
            moved = np.cumsum(~joined)
            first = np.concatenate([[0], moved])[first] if n else first
            starts, ends, has_digit = starts[head], ends[tail], np.logical_or.reduceat(has_digit, head)
            gap, row_first, mark, n = gap[head], row_first[head], data[np.minimum(ends, len(data) - 1)], len(head)
        word = self.reader.hashes(small_letters(data), starts, ends)
        kind = np.zeros(n, np.int8)
        kind[has_digit] = NUMBER_MARK
        upper = (data[starts] >= 65) & (data[starts] <= 90)
        second = data[np.minimum(starts + 1, len(data) - 1)]
        small = (ends - starts > 1) & (((second >= 97) & (second <= 122)) | (second >= 128))
        flows = np.zeros(n, bool)
        flows[1:] = (gap[1:] == 1) & (mark[:-1] == 32) & ~row_first[1:]
        kind[upper & small & flows & ~has_digit] = NAME_MARK
        if n > 1:
            at = np.searchsorted(self.units, word)
            unit = self.units[np.minimum(at, len(self.units) - 1)] == word
            after = np.zeros(n, bool)
            after[1:] = (kind[:-1] == NUMBER_MARK) & ~row_first[1:]
            kind[unit & after & (kind == 0)] = UNIT_MARK
        template = np.where(kind > 0, self.marks[kind], word)
        return Template(starts, ends, first, template, word, kind)


def _filter_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _bit_batches(bits: int):
    """Words of 64 bits of the filter table that the hashes of a batch set: their numbers and their bits."""

    def run(batches):
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            place = np.concatenate(_filter_places(hashes, bits))
            number, at = np.unique(place >> 6, return_inverse=True)
            word = np.zeros(len(number), np.uint64)
            np.bitwise_or.at(word, at, np.uint64(1) << (place & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(signed(word))], names=["number", "word"])

    return run


def bit_set(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits per hash in a table of ``2**bits``, set on the executors: at most ``2**(bits - 6)`` rows go to the driver."""
    words = hashes.mapInArrow(_bit_batches(bits), "number int, word long").groupBy("number").agg(F.expr("bit_or(word)").alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words["number"].to_numpy()] = words["word"].to_numpy()
    return table.view(np.uint8)


def in_bit_set(table: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """Numbers of the hashes that may be in the set; no hash of the set is missed."""
    a, b = _filter_places(hashes, bits)
    hit = np.flatnonzero((table[a >> 3] >> (a & 7).astype(np.uint8)) & 1)
    return hit[((table[b[hit] >> 3] >> (b[hit] & 7).astype(np.uint8)) & 1).astype(bool)]


def _item_batches(size: int, smallest: int):
    """Windows of items with their places, words and kinds."""

    def run(batches):
        reader = TemplateReader()
        for batch, data, offsets in chunks_of(batches):
            t = reader.read(data, offsets)
            out = {k: [] for k in ("item_id", "item_key", "n_words", "place", "window", "plain", "words", "kinds")}
            whole = {n: item_windows(t, n, size) for n in {min(int(k), size) for k in np.diff(t.first)} if n >= smallest}
            words_of = {n: plain_windows(t, n, size) for n in whole}
            for r in range(batch.num_rows):
                a, b = int(t.first[r]), int(t.first[r + 1])
                if a == b:
                    continue
                if b - a < smallest:
                    n, kind = b - a, np.zeros(len(t.kind), np.int8)
                    found = plain = line_hashes(t.word, np.array([a]), n, smallest)
                else:
                    n, kind = min(b - a, size), t.kind
                    hashes, at = whole[n]
                    found, plain = hashes[at[r] : at[r + 1]], words_of[n][at[r] : at[r + 1]]
                for p, (window, of_words) in enumerate(zip(signed(found).tolist(), signed(plain).tolist())):
                    stop = a + p + n
                    for name, v in zip(
                        out,
                        (
                            batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), b - a, p, window, of_words,
                            signed(t.word)[a + p : stop].tolist(), kind[a + p : stop].tolist(),
                        ),
                    ):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=ITEM)

    return run


ITEM = pa.schema(
    [("item_id", pa.int64()), ("item_key", pa.int64()), ("n_words", pa.int32()), ("place", pa.int32()), ("window", pa.int64()),
     ("plain", pa.int64()), ("words", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8()))]
)
HIT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("found", pa.list_(pa.int64()))])


def _hit_batches(size: int, table: np.ndarray, shortest: tuple[int, ...], smallest: int):
    """Windows of documents that may be windows of an item. ``table``: bit set of the items' windows; ``shortest``: sizes
    of items with fewer words than a window, which are looked for at their own size, and below ``smallest`` in whole lines only."""

    def run(batches):
        reader = TemplateReader()
        for batch, data, offsets in chunks_of(batches):
            t = reader.read(data, offsets)
            parts = []
            for n in (k for k in shortest if k < smallest):
                row, place = whole_lines(t, data, n)
                hashes = line_hashes(t.word, t.first[:-1][row] + place, n, smallest)
                hit = in_bit_set(table, hashes)
                parts.append((row[hit], place[hit], hashes[hit], np.full(len(hit), n)))
            for n in (size, *(k for k in shortest if k >= smallest)):
                hashes, at = item_windows(t, n, size)
                if not len(hashes):
                    continue
                plain = plain_windows(t, n, size)
                for found in (hashes, plain):
                    hit = in_bit_set(table, found)
                    if found is plain:
                        hit = hit[plain[hit] != hashes[hit]]
                    row = np.searchsorted(at, hit, "right") - 1
                    parts.append((row, hit - at[row], found[hit], np.full(len(hit), n)))
            if not parts:
                continue
            row, place, hashes, n = (np.concatenate(x) for x in zip(*parts))
            if not len(row):
                continue
            word = signed(t.word)
            first = t.first[:-1][row] + place
            found = [word[f : f + k].tolist() for f, k in zip(first.tolist(), n.tolist())]
            ids = batch.select(["doc_id", "text_key"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*ids.columns, pa.array(place, pa.int32()), pa.array(signed(hashes)), pa.array(found, pa.list_(pa.int64()))], schema=HIT
            )

    return run


def _hash_at(words: np.ndarray, starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of the ``n`` words from each start on: a whole window, or a short item as a whole."""
    factor = odd_numbers(SEED, size)
    total = np.full(len(starts), n if n < size else 0, np.uint64)
    for j in range(n):
        total += words[starts + j] * factor[j]
    return mix(total)


def _window_hashes(words: np.ndarray, t: Template, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words and where each row's windows start (one more than rows)."""
    if n == size:
        return windows(words, t.first, n, seed=SEED)
    count = np.maximum(np.diff(t.first) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    return _hash_at(words, np.arange(at[-1]) + np.repeat(t.first[:-1] - at[:-1], count), n, size), at


def plain_windows(t: Template, n: int, size: int) -> np.ndarray:
    """Hashes of the small words of all windows: capitals, line breaks and spaces that make a word a name or none do not matter."""
    return mix(_window_hashes(t.word, t, n, size)[0] ^ np.uint64(LITERAL_WORDS))


def item_windows(t: Template, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` template words and where each row's windows start (one more than rows).

    A window with fewer than ``LITERAL_WORDS`` words that stand for themselves is hashed by its words and not by its template: a
    table of numbers is not every other table of numbers.
    """
    hashes, at = _window_hashes(t.template, t, n, size)
    if not len(hashes):
        return hashes, at
    starts = np.arange(at[-1]) + np.repeat(t.first[:-1] - at[:-1], np.diff(at))
    literal = np.concatenate([[0], np.cumsum(t.kind == 0)])
    few = np.flatnonzero(literal[starts + n] - literal[starts] < LITERAL_WORDS)
    if len(few):
        hashes[few] = mix(_hash_at(t.word, starts[few], n, size) ^ np.uint64(LITERAL_WORDS))
    return hashes, at


def line_hashes(words: np.ndarray, starts: np.ndarray, n: int, smallest: int) -> np.ndarray:
    """Hash of the ``n`` words of a line, never that of a window."""
    return mix(_hash_at(words, starts, n, smallest) ^ np.uint64(LITERAL_WORDS + 1))


def whole_lines(t: Template, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and word number of all lines of ``n`` words, and of all rows of ``n`` words in several lines."""
    head = np.zeros(len(t.starts) + 1, bool)
    head[t.first] = head[-1] = True
    breaks = np.flatnonzero((data == 10) | (data == 13))
    head[1:-1] |= np.diff(np.searchsorted(breaks, t.starts)) > 0
    lines = np.flatnonzero(head)
    rows = t.first[:-1][np.diff(t.first) == n]
    starts = np.union1d(lines[:-1][np.diff(lines) == n], rows).astype(np.int64)
    row = np.searchsorted(t.first, starts, "right") - 1
    return row, starts - t.first[row]


OCCURRENCE = "doc_id long, text_key long, item_id long, item_key long, whole int, places array<int>, run int, first_word int, exact boolean"


def _occurrence_batches(batches):
    """Windows of each diagonal that count, its longest run of words equal to the item's, and whether all fillers are equal."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            equal, run, longest = set(r["equal"]), 0, 0
            places = counted(r["places"], equal, r["fillers"], r["size"])
            if not places:
                continue
            for p in sorted(equal):
                run = run + 1 if p - 1 in equal else r["size"]
                longest = max(longest, run)
            same = all(z["w"] == z["f"] for z in r["fillers"])
            rows.append([r[k] for k in ("doc_id", "text_key", "item_id", "item_key", "whole")] + [places, longest, r["offset"] + places[0], same])
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), FOUND)] if rows else [pa.array([], f.type) for f in FOUND]
        yield pa.RecordBatch.from_arrays(columns, schema=FOUND)


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("item_key", pa.int64()), ("whole", pa.int32()),
     ("places", pa.list_(pa.int32())), ("run", pa.int32()), ("first_word", pa.int32()), ("exact", pa.bool_())]
)


def counted(places: list[int], equal: set[int], fillers: list[dict], size: int) -> list[int]:
    """Sorted places of the windows of a diagonal that count: those of the item's very words, and those whose fillers are what
    the item's stand for in most of their places. A filler that stands for several equally often stands for itself, if
    that is one of them, or for none."""
    votes: dict[int, Counter] = {}
    for z in fillers:
        votes.setdefault(z["w"], Counter())[z["f"]] += 1
    stands: dict[int, int | None] = {}
    for w, of in votes.items():
        most = max(of.values())
        top = [f for f, n in of.items() if n == most]
        stands[w] = top[0] if len(top) == 1 else w if w in top else None
    against = sorted(z["p"] for z in fillers if stands[z["w"]] != z["f"])

    def agrees(p: int) -> bool:
        k = bisect.bisect_left(against, p)
        return k == len(against) or against[k] >= p + size

    return sorted(p for p in places if p in equal or agrees(p))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW_WORDS,
    smallest: int = SMALLEST_ITEM,
    covered: float = COVERED,
    verbatim: int = VERBATIM_WORDS,
) -> DataFrame:
    """``doc_id, item_id, n_windows, covered, first_word, exact`` for documents that hold a benchmark item.

    ``covered``: share of the item's template windows found in consistent occurrences, at least the given one, or less where
    ``verbatim`` words on end are those of the item;
    ``exact``: all fillers are those of the item; ``first_word``: smallest template word number of an occurrence. A filler of the item
    stands for one filler throughout an occurrence; windows that differ from what most places say do not count, unless their words are
    the item's. Items of fewer than ``smallest`` words are found where they are a whole line or
    document; those without words, null texts and empty tables give no rows; items shorter than a window are looked for as a whole. Rows that repeat an id give one row per item. Null ids are
    allowed and extra columns ignored.
    """
    items = benchmark.select(F.col(item_column).cast("long"), F.xxhash64(item_text_column), F.col(item_text_column).alias("text"))
    items = items.distinct().mapInArrow(
        _item_batches(window, smallest),
        "item_id long, item_key long, n_words int, place int, window long, plain long, words array<long>, kinds array<byte>",
    )
    both = F.explode(F.array_distinct(F.array("window", "plain"))).alias("window")
    items = materialise(items.select("item_id", "item_key", "n_words", "place", "words", "kinds", both), "item-windows")
    # of the items' windows only the words of the filter table, of a fixed size, go to the driver
    table = bit_set(items.select("window"))
    sizes = tuple(sorted(r[0] for r in items.where(F.col("n_words") < max(window, smallest)).select("n_words").distinct().collect()))
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    hits = docs.mapInArrow(
        _hit_batches(window, table, sizes, smallest), "doc_id long, text_key long, at int, window long, found array<long>"
    )
    small = items.count() <= BROADCAST_ROWS
    met = hits.join(F.broadcast(items) if small else items, "window")
    fillers = F.expr(
        "filter(transform(arrays_zip(words, found, kinds), (z, i) -> struct(place + i as p, z.words as w, z.found as f, z.kinds as k)), z -> z.k > 0)"
    )
    occurrence = ["doc_id", "text_key", "item_id", "item_key", (F.col("at") - F.col("place")).alias("offset")]
    whole = F.greatest(F.col("n_words") - window + 1, F.lit(1))
    equal = F.when(F.col("words") == F.col("found"), F.col("place"))
    found = met.select(*occurrence, "place", whole.alias("whole"), F.size("words").alias("size"), equal.alias("equal"), fillers.alias("fillers"))
    found = found.groupBy("doc_id", "text_key", "item_id", "item_key", "offset").agg(
        F.first("whole").alias("whole"),
        F.first("size").alias("size"),
        F.collect_set("place").alias("places"),
        F.collect_set("equal").alias("equal"),
        F.array_distinct(F.flatten(F.collect_set("fillers"))).alias("fillers"),
    )
    found = found.mapInArrow(_occurrence_batches, OCCURRENCE).groupBy("doc_id", "text_key", "item_id", "item_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"),
        F.first("whole").alias("whole"),
        F.max("run").alias("run"),
        F.min("first_word").cast("long").alias("first_word"),
        F.every("exact").alias("exact"),
    )
    found = found.withColumn("covered", F.col("n_windows") / F.col("whole")).where((F.col("covered") >= covered) | (F.col("run") >= verbatim))
    best = F.max(F.struct("covered", "n_windows", "exact", (-F.col("first_word")).alias("f"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.n_windows", "b.covered", (-F.col("b.f")).alias("first_word"), "b.exact"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` whose id is not that of a document with a benchmark item, with their columns."""
    gone = materialise(find_leaks(docs, benchmark, id_column, **options).select(F.col("doc_id").alias(id_column)).distinct(), "leaks")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_column].eqNullSafe(gone[id_column]), "left_anti")
