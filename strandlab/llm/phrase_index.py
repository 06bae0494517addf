"""Collocations from word n-grams: an FM-index per shard enumerates them by extending intervals to both sides, shards are added up.

A shard is a bounded run of texts of one language. Its words become numbers, pieces are divided by the symbol 0, and two indexes are
made of it: one of suffixes sorted by their first words, one of prefixes sorted by their last ones. The n-grams of a length are intervals
kept in step in both; all of them are extended by one word on the right (counting the symbols of the reverse index's transform inside
each interval) or on the left (the forward one's) at once, so each gets its count and its extensions without a hash table of phrases.

Shards are added up in two steps, so that n-grams that are rare everywhere hardly travel as text: hashed counters are summed
first and each shard is told, one bit per n-gram, which of its counters reach the least count; only the text of those is then summed. A
counter is never below the count of a phrase in it, so none is lost, and counts are made on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.words import U64, WordReader, mix, odd_numbers, texts
from strandlab.session import materialise

SHARD_BYTES = 3 << 20
HELD_BYTES = 9 << 20
BUCKET_ENTRIES = 1 << 20
# counters per n-gram as a power of two, and least number of bits: so few n-grams share a counter that hardly a rare phrase travels as text
SPARE_BITS, LEAST_BITS = 10, 40
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
UNKNOWN = "und"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_END = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
IS_WORD = ~(IS_END | np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8)))


# ---- one shard ----


def encode(text: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Symbols of a text's bytes (0 before, between and after pieces, words from 1) and its distinct words."""
    data = LOWER[text]
    word = IS_WORD[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(1, np.int64), pa.array([], pa.binary())
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[word])])
    coded = words.dictionary_encode()
    piece = np.cumsum(IS_END[data], dtype=np.int64)[starts]
    piece = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])
    symbols = np.zeros(len(starts) + piece[-1] + 2, np.int64)
    symbols[np.arange(len(starts)) + piece + 1] = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return symbols, coded.dictionary


class Grams:
    """N-grams of one length: first row in the forward and in the reverse index, count, and their words' symbols."""

    def __init__(self, low: np.ndarray, reverse_low: np.ndarray, count: np.ndarray, words: list[np.ndarray]):
        self.low, self.reverse_low, self.count, self.words = low, reverse_low, count, words


class ShardIndex:
    """Burrows-Wheeler transforms of a sequence and of its reverse, sorted as deep as n-grams of up to ``depth`` words need."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.alphabet = depth, int(symbols.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.alphabet))])
        # extensions alternate: to the right from odd lengths, to the left from even ones
        lefts = [k for k in range(1, depth) if k % 2 == 0]
        rights = [k for k in range(1, depth) if k % 2 == 1]
        self.before = self._transform(symbols, max(lefts, default=1))
        self.after = self._transform(symbols[::-1], max(rights, default=1))
        self.ranks: dict[bool, np.ndarray] = {}

    def _transform(self, symbols: np.ndarray, depth: int) -> np.ndarray:
        """The symbol before each suffix, suffixes sorted by ``depth`` symbols."""
        padded = np.concatenate([symbols, np.zeros(depth, np.int64)])
        key, n = symbols, len(symbols)
        for d in range(1, depth):
            if d > 1:  # names keep the order and leave room for the next symbol
                key = np.unique(key, return_inverse=True)[1]
            key = key * self.alphabet + padded[d : n + d]
        order = np.argsort(key, kind="stable")
        return symbols[order - 1]

    def single_words(self) -> Grams:
        low = self.first[1:-1]
        return Grams(low, low, np.diff(self.first[1:]), [np.arange(1, self.alphabet)])

    def _rank(self, left: bool, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a row of a transform."""
        transform = self.before if left else self.after
        n = len(transform)
        if left not in self.ranks:
            self.ranks[left] = np.sort(transform * n + np.arange(n))
        return np.searchsorted(self.ranks[left], symbol * n + row) - self.first[symbol]

    def extend(self, grams: Grams, left: bool, follow: bool) -> Grams:
        """All n-grams one word longer, on the left or on the right. ``follow``: they will be extended on this side again."""
        own, other = (grams.low, grams.reverse_low) if left else (grams.reverse_low, grams.low)
        start = np.cumsum(grams.count) - grams.count
        owner = np.repeat(np.arange(len(own)), grams.count)
        rows = np.arange(len(owner)) + np.repeat(own - start, grams.count)
        key = np.sort(owner * self.alphabet + (self.before if left else self.after)[rows])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(at, append=len(key))
        owner, symbol = np.divmod(key[at], self.alphabet)
        # words smaller than this one come before it in the other index's interval
        moved = other[owner] + at - start[owner]
        real = symbol > 0
        owner, symbol, count, moved = owner[real], symbol[real], count[real], moved[real]
        kept = self.first[symbol] + self._rank(left, symbol, own[owner]) if follow else np.zeros_like(moved)
        words = [w[owner] for w in grams.words]
        words = [symbol, *words] if left else [*words, symbol]
        return Grams(kept, moved, count, words) if left else Grams(moved, kept, count, words)

    def enumerate(self) -> Iterator[Grams]:
        grams = self.single_words()
        yield grams
        for k in range(1, self.depth):
            grams = self.extend(grams, left=k % 2 == 0, follow=k + 2 < self.depth)
            yield grams


class Entries:
    """All n-grams of a shard in the order of their hashed counters."""

    def __init__(self, symbols: np.ndarray, words: pa.Array, lang: str, depth: int, bits: int):
        data, offsets = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        of_word = np.concatenate([np.zeros(1, U64), self._bytes_hash(data, offsets)])
        name = np.frombuffer(lang.encode(), np.uint8)
        seed = self._bytes_hash(name, np.array([0, len(name)]))[0]
        factor = odd_numbers(13, depth)
        self.words = words
        slots, self.grams = [], list(ShardIndex(symbols, depth).enumerate())
        for g in self.grams:
            total = np.full(len(g.count), seed + U64(len(g.words)), U64)
            for j, w in enumerate(g.words):
                total += of_word[w] * factor[j]
            slots.append(mix(total) >> U64(64 - bits))
        self.count = np.concatenate([g.count for g in self.grams])
        self.starts = np.cumsum([0, *(len(g.count) for g in self.grams)])
        slots = np.concatenate(slots)
        self.order = np.argsort(slots, kind="stable")
        self.slots = slots[self.order]

    @staticmethod
    def _bytes_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A hash for each of the byte strings that lie one behind the other."""
        reader = WordReader(lower=False, separators=())
        size = np.diff(offsets)
        out = np.zeros(len(size), U64)
        full = np.flatnonzero(size)
        if len(full):
            out[full] = reader.hashes(data, offsets[:-1][full], offsets[1:][full])
        return mix(out + size.astype(U64))

    def texts_of(self, chosen: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        """Phrases, counts and length of the chosen n-grams, by length. ``chosen``: a bit for each, in the order of counters."""
        mask = np.zeros(len(self.order), bool)
        mask[self.order] = chosen
        for k, g in enumerate(self.grams):
            at = np.flatnonzero(mask[self.starts[k] : self.starts[k + 1]])
            if len(at):
                parts = [self.words.take(pa.array(w[at] - 1)) for w in g.words]
                joined = parts[0] if k == 0 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", parts[0].type))
                yield pa.Array.from_buffers(pa.large_string(), len(joined), joined.buffers()), g.count[at], k + 1


# ---- shards of a table ----

SHARD = "shard long, lang string, n long, entries long, symbols binary, words binary, sizes binary, overlaps array<string>"


def _cuts(text: bytes, limit: int, context: int) -> Iterator[tuple[bytes, list[str]]]:
    """Parts of a long text. One that goes on inside a piece starts with the last ``context`` words of the former part; the n-grams
    inside these words are listed, since they are counted twice."""
    data = np.frombuffer(text, np.uint8)
    lo, carried, overlaps = 0, b"", []
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            step = limit
            while hi < len(data) and not len(ends := np.flatnonzero(~IS_WORD[data[hi : hi + step]])):
                hi += step
            hi = min(hi + int(ends[0]), len(data)) if hi < len(data) else len(data)
        part = carried + text[lo:hi]
        yield part, overlaps
        tail = part[max(0, part_start(part)) :]
        words = tail.translate(LOWER.tobytes()).replace(b"\t", b" ").split(b" ")
        words = [w for w in words if w][-context:] if context else []
        carried = b" ".join(words)
        overlaps = [" ".join(x.decode("utf-8", "replace") for x in words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        lo = hi


def part_start(part: bytes) -> int:
    """Where the last piece of a text begins."""
    return max(part.rfind(bytes([c])) for c in PIECE_ENDS) + 1


def _shards(depth: int, limit: int):
    def packed(number: int, lang: str, held: list[tuple[bytes, list[str]]]) -> dict:
        symbols, words = encode(np.frombuffer(b"\n".join(t for t, _ in held), np.uint8))
        overlaps = [p for _, o in held for p in o]
        n = int((symbols > 0).sum()) - sum(" " not in p for p in overlaps)
        sizes = np.diff(np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]) if len(words) else np.zeros(0, np.int64)
        return {
            "shard": number, "lang": lang, "n": n, "entries": depth * len(symbols), "symbols": symbols.astype(np.uint16 if len(words) < 1 << 16 else np.uint32).tobytes(),
            "words": b"".join(words.to_pylist()), "sizes": sizes.astype(np.uint32).tobytes(), "overlaps": overlaps,
        }

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[tuple[bytes, list[str]]]] = {}
        size: dict[str, int] = {}

        def flush(lang: str):
            nonlocal number
            row = packed(number, lang, held.pop(lang))
            size.pop(lang)
            number += 1
            return pa.RecordBatch.from_pylist([row], OUT)

        for batch in batches:
            data, offsets = texts(batch.column(0))
            for r, lang in enumerate(batch.column(1).to_pylist()):
                lo, hi = int(offsets[r]), int(offsets[r + 1])
                if lo == hi:
                    continue
                whole = data[lo:hi].tobytes()
                for part in [(whole, [])] if hi - lo <= limit else _cuts(whole, limit, depth - 1):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part[0]) + 1
                    if size[lang] >= limit:
                        yield flush(lang)
                if sum(size.values()) > HELD_BYTES:
                    yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    return run


OUT = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("entries", pa.int64()), ("symbols", pa.binary()),
    ("words", pa.binary()), ("sizes", pa.binary()), ("overlaps", pa.list_(pa.string())),
])


def _opened(row: dict, depth: int, bits: int) -> Entries:
    places = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.uint32), dtype=np.int64)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(row["words"])])
    symbols = np.frombuffer(row["symbols"], np.uint16 if len(words) < 1 << 16 else np.uint32)
    return Entries(symbols.astype(np.int64), words, row["lang"], depth, bits)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}


def _bounds(buckets: int, bits: int) -> np.ndarray:
    return np.array([(b << bits) // buckets for b in range(buckets)], U64)


def _packed_steps(steps: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs: up to four, or eight."""
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return steps.tobytes() if width > 4 else steps.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpacked_steps(packed: bytes, n: int) -> np.ndarray:
    width = len(packed) // n
    if width > 4:
        return np.frombuffer(packed, U64)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(n, width)
    return wide.view(np.uint32).ravel()


def _counters(depth: int, buckets: int, bits: int, least: int):
    """One row per shard and range of counters that it has: steps between counters, counts up to the least that matters."""

    def run(batches):
        for row in _rows(batches):
            entries = _opened(row, depth, bits)
            count = np.minimum(entries.count[entries.order], min(least, 255)).astype(np.uint8)
            at = np.append(np.searchsorted(entries.slots, _bounds(buckets, bits)), len(entries.slots))
            steps = np.diff(entries.slots, prepend=U64(0))
            some = np.flatnonzero(np.diff(at))
            out = {"bucket": [], "shard": [], "origin": [], "steps": [], "counts": []}
            for b in some.tolist():
                lo, hi = at[b], at[b + 1]
                step = steps[lo:hi].copy()
                step[0] = 0
                out["bucket"].append(b)
                out["shard"].append(row["shard"])
                out["origin"].append(int(entries.slots[lo]))
                out["steps"].append(_packed_steps(step))
                out["counts"].append(count[lo:hi].tobytes())
            del entries, count, steps  # the next shard is opened without this one
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["shard"], pa.int64()), pa.array(out["origin"], pa.int64()),
                                              pa.array(out["steps"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    return run


def _frequent(least: int):
    """Adds up the counters of a range and tells each shard which of its own reach ``least``."""
    enough = min(least, 255)

    def run(table: pa.Table) -> pa.Table:
        slots, counts = [], []
        for origin, steps, count in zip(table["origin"].to_pylist(), table["steps"].to_pylist(), table["counts"].to_pylist()):
            slots.append(np.cumsum(_unpacked_steps(steps, len(count)), dtype=U64) + U64(origin))
            counts.append(np.frombuffer(count, np.uint8))
        sizes = [len(s) for s in slots]
        every, number = np.unique(np.concatenate(slots), return_inverse=True)
        reached = np.bincount(number, np.concatenate(counts), len(every)) >= enough
        told = np.split(reached[number], np.cumsum(sizes)[:-1])
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "size": pa.array(sizes, pa.int32()),
                         "bits": pa.array([np.packbits(t).tobytes() for t in told], pa.binary())})

    return run


def _phrases(depth: int, bits: int):
    def run(batches):
        for row in _rows(batches):
            entries = _opened(row, depth, bits)
            told = sorted(row["told"], key=lambda t: t["bucket"])
            chosen = np.concatenate([np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=t["size"]).astype(bool) for t in told])
            for phrase, count, k in entries.texts_of(chosen):
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(count)), phrase.cast(pa.string()), pa.array(np.full(len(count), k, np.int32)),
                                                  pa.array(count)], names=["lang", "phrase", "words", "f"])
            if twice := row["overlaps"]:
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(twice)), pa.array(twice), pa.array([p.count(" ") + 1 for p in twice], pa.int32()),
                                                  pa.array([-1] * len(twice), pa.int64())], names=["lang", "phrase", "words", "f"])
            del entries, chosen

    return run


def phrase_counts(
    documents: DataFrame, depth: int = 3, least: int = 10, text_column: str = "text", lang_column: str = "lang",
    shard_bytes: int = SHARD_BYTES, bucket_entries: int = BUCKET_ENTRIES,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``depth`` words that occur ``least`` times, and ``lang, n``, the words of each.

    A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into pieces and these at blanks into words; a phrase lies inside a
    piece. A null language counts as ``und``, null and empty texts have no words. Texts of any length are read whole: a long one is cut
    into parts that overlap by ``depth - 1`` words, whose n-grams are taken off again.
    """
    rows = documents.select(F.col(text_column).alias("text"), F.coalesce(F.col(lang_column), F.lit(UNKNOWN)).alias("lang"))
    shards = materialise(rows.mapInArrow(_shards(depth, shard_bytes), SHARD), "phrase-shards")
    # the number of ranges follows the input, so that one range of counters fits a task
    total = shards.agg(F.sum("entries")).first()[0] or 0
    buckets, bits = max(1, -(-total // bucket_entries)), min(63, max(LEAST_BITS, total.bit_length() + SPARE_BITS))
    counters = shards.drop("overlaps", "n", "entries").mapInArrow(_counters(depth, buckets, bits, least), "bucket int, shard long, origin long, steps binary, counts binary")
    told = counters.groupBy("bucket").applyInArrow(_frequent(least), "shard long, bucket int, size int, bits binary")
    told = told.groupBy("shard").agg(F.collect_list(F.struct("bucket", "size", "bits")).alias("told"))
    found = shards.join(told, "shard").select("lang", "symbols", "words", "sizes", "overlaps", "told")
    found = found.mapInArrow(_phrases(depth, bits), "lang string, phrase string, words int, f long")
    summed = found.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialise(summed, "phrase-counts"), shards.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(documents: DataFrame, most: int = 2000, least: int = 10, depth: int = 3, share: int = 50, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``depth`` words.

    A phrase that occurs ``a >= least`` times is scored by its weakest cut: ``floor(10**6 * a * a / (l * r))`` with the counts of the two
    parts, the lowest after flooring, ties to the earliest cut. A phrase inside a longer one that has at least ``share`` percent of its
    count is dropped, whether that one stays or not. Order: score, then count, both falling, then the phrase by its bytes. Without
    documents, or where nothing is frequent, the result is empty. Extra columns are ignored.
    """
    counts, totals = phrase_counts(documents, depth, least, **options)
    long = counts.where(F.col("words") >= 2)
    # a phrase inside a longer one that has enough of its count; the longest rival of each comes from one grouped sum
    word = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(F.col("word"), i, k), " "))))
    longer = long.where(F.col("words") > 2).withColumn("word", word)
    rivals = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.lit(None).cast("int").alias("words"), F.lit(None).cast("long").alias("a"), F.col("f").alias("rival"))
    both = long.select("lang", "phrase", "words", F.col("f").alias("a"), F.lit(None).cast("long").alias("rival")).unionByName(rivals)
    kept = both.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.max("rival").alias("rival"))
    kept = kept.where(F.col("a").isNotNull() & (F.coalesce(F.col("rival"), F.lit(0)) * 100 < F.col("a") * share))
    cuts = kept.withColumn("word", word).select("lang", "phrase", "a", "word", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("word", F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice("word", F.col("cut") + 1, F.size("word")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(part, ["lang", side])  # on a part that begins or ends very many phrases, adaptive execution splits the join
    cuts = cuts.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
