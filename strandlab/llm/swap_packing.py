"""Packing of tokenised documents into sequences of bounded length: best fit, then swap-based local search.

Pieces are dealt into groups of bounded size. A group is packed by best fit in decreasing order; then documents are moved, or exchanged
one for one and two for one, from emptier to fuller sequences, which raises the sum of squared fills until a sequence
runs empty. Sequences that stay underfull are dissolved and their pieces packed again with those of other groups.
"""

from __future__ import annotations

import array
import itertools
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import materialise

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 2048
FULL_ENOUGH = 0.98
ROUNDS = 4
TRIALS = 50_000
END_ID = 0
END_OF_TEXT = "<|endoftext|>"
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_pair_encoder(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """Encoder of a byte-level vocabulary file. The ids are those of the ``byte_bpe_50k.json`` tokenizer (tested).

    The ranks file of the same vocabulary is read by a library that is five times faster. As in that tokenizer,
    the string of the end-of-text token in a text is that token. That library's pattern matcher gives up on very long runs of
    white space, so these are cut out: by the pattern such a run is one piece, less its last character where a word follows.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    end = len(ranks)

    def encode_part(text: str) -> list[int]:
        ids, place = [], 0
        for run in LONG_BLANK.finditer(text) if len(text) >= 1000 else ():
            stop = run.end() - (run.end() < len(text))
            ids += encoding.encode_ordinary(text[place : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : stop])
            place = stop
        return ids + encoding.encode_ordinary(text[place:]) if place else encoding.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if END_OF_TEXT not in text:
            return encode_part(text)
        first, *others = (encode_part(x) for x in text.split(END_OF_TEXT))
        return [*first, *itertools.chain.from_iterable([end, *x] for x in others)]

    return encode


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: whole up to ``most``, else the rest first and full pieces after it."""
    if n <= most:
        return [(0, n)]
    head = n % most
    return [(0, head)] * (head > 0) + [(s, most) for s in range(head, n, most)]


def _piece_batches(vocabulary: str | None, most: int, with_ids: bool):
    def run(batches):
        encode = byte_pair_encoder(vocabulary)
        for batch in batches:
            doc, piece, start, length, crc, tokens = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = array.array("I", encode(text.as_py() or ""))
                ids.append(END_ID)
                for k, (s, n) in enumerate(cuts(len(ids), most)):
                    part = ids[s : s + n]
                    doc.append(doc_id.as_py())
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        tokens.append(part.tolist())
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Best fit in decreasing order: each length goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(most + 1)]  # bins by free space
    open_spaces = 0  # bit s is set if a bin has free space s
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_spaces >> n
        if fitting:
            space = n + ((fitting & -fitting).bit_length() - 1)
            b = free[space].pop()
            if not free[space]:
                open_spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            b, space = len(bins), most
            bins.append([i])
        free[space - n].append(b)
        open_spaces |= 1 << (space - n)
    return bins


def _options(members: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Sums that a bin can give: of one member and of two; the empty choice has sum 0."""
    one: dict[int, tuple[int, ...]] = {}
    for i in members:
        one.setdefault(int(lengths[i]), (i,))
    out = {0: (), **one}
    few = [i for k in sorted({int(lengths[i]) for i in members}) for i in [j for j in members if lengths[j] == k][:2]]
    for a, b in itertools.combinations(few, 2):
        out.setdefault(int(lengths[a] + lengths[b]), (a, b))
    return out


def _exchange(fuller: list[int], emptier: list[int], lengths: np.ndarray, space: int):
    """Members to exchange so that the fuller bin gains most, at most ``space``: one for one, two for one, one for two, or moves."""
    give, take = _options(fuller, lengths), _options(emptier, lengths)
    out, into = np.array(list(give)), np.array(list(take))
    gain = into[None, :] - out[:, None]
    sizes_out, sizes_in = np.array([len(v) for v in give.values()]), np.array([len(v) for v in take.values()])
    allowed = (gain > 0) & (gain <= space) & ((sizes_out[:, None] + sizes_in[None, :]) <= 3)
    if not allowed.any():
        return None
    g, t = np.unravel_index(np.argmax(np.where(allowed, gain, 0)), gain.shape)
    return give[int(out[g])], take[int(into[t])], int(gain[g, t])


def swap_search(bins: list[list[int]], lengths: np.ndarray, most: int, trials: int = TRIALS) -> list[list[int]]:
    """Empty bins by exchanges from the emptiest bin to fuller ones, as long as fewer bins are possible."""
    bins = [list(b) for b in bins]
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-int(lengths.sum()) // most)
    alive = {b for b in range(len(bins)) if fill[b] < most}
    count, given_up, hopeless = len(bins), set(), set()
    while count > least and trials > 0:
        left = alive - given_up
        if not left:
            break
        target = min(left, key=lambda b: (fill[b], b))
        others = sorted((b for b in alive if b != target and fill[b] >= fill[target]), key=lambda b: (-fill[b], b))
        if sum(most - fill[b] for b in others) < fill[target]:
            break
        moved = False
        shape_t = tuple(sorted(lengths[bins[target]].tolist()))
        for b in others:
            shape = (shape_t, tuple(sorted(lengths[bins[b]].tolist())))
            if shape in hopeless:
                continue
            trials -= 1
            found = _exchange(bins[b], bins[target], lengths, most - fill[b])
            if found is None:
                hopeless.add(shape)
                if trials <= 0:
                    break
                continue
            give, take, gain = found
            bins[b] = [i for i in bins[b] if i not in give] + list(take)
            bins[target] = [i for i in bins[target] if i not in take] + list(give)
            fill[b] += gain
            fill[target] -= gain
            moved = True
            if fill[b] == most:
                alive.discard(b)
            break
        if not bins[target]:
            alive.discard(target)
            count -= 1
        elif not moved:
            given_up.add(target)
    return [b for b in bins if b]


def pack(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of places of ``lengths``, none over ``most``."""
    return swap_search(best_fit(lengths, most), lengths, most) if len(lengths) else []


def _packer(most: int, turn: int, final: bool, full_enough: float):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = pieces["length"].to_numpy()
        sequence, offset, done = (np.zeros(len(pieces), np.int64) for _ in range(3))
        base = (turn << 56) | (int(pieces["group"].iloc[0]) << 32)
        for k, members in enumerate(pack(lengths, most)):
            ends = np.cumsum(lengths[members])
            sequence[members] = base + k
            offset[members] = ends - lengths[members]
            done[members] = final or ends[-1] >= full_enough * most
        return pieces.assign(sequence_id=sequence, offset=offset, done=done > 0).drop(columns="group")

    return run


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_pieces: int = GROUP_PIECES,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row (and ``ids``).

    A document is its token ids and one end id, so a null or empty text is one token. Only longer documents are cut, into
    full pieces; the first piece may be shorter. Offsets of a sequence have no gaps. Rows that repeat an id are packed once
    each; null ids are allowed and extra columns ignored. An empty table gives an empty table.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(
        _piece_batches(vocabulary, sequence_tokens, with_ids), kind
    )
    pieces = materialise(pieces, "pieces")
    packed, left = [], pieces
    for turn in range(ROUNDS):
        n = left.count()
        if turn and not n:
            break
        groups = max(1, -(-n // group_pieces))
        final = turn == ROUNDS - 1 or groups == 1
        # equal rows are told apart by their place in the written table
        key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn))
        dealt = left.withColumn("group", F.pmod(key, F.lit(groups)))
        run = _packer(sequence_tokens, turn, final, FULL_ENOUGH)
        done = materialise(
            dealt.groupBy("group").applyInPandas(run, kind + ", sequence_id long, offset long, done boolean"), "packed"
        )
        packed.append(done.where("done").drop("done"))
        if final:
            break
        left = done.where("not done").drop("sequence_id", "offset", "done")
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out
