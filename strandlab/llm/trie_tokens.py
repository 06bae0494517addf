"""Token counts of documents under a unigram model, with scores shared along a trie of pre-tokens.

The distinct pre-tokens of a run of documents are put in a trie. The forward score of a node, the best sum of log probabilities over
ways to cut its prefix into pieces, is worked out once for all pre-tokens that share the prefix, level after level; the number of
pieces at the last node of a pre-token is its token count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.words import WordReader, chunks_of, mix

CHUNK_BYTES = 4 << 20
KNOWN_WORDS = 1 << 20
TRIE_CHARS = 64
ZIPF_SHIFT = 2.7
WORD_MARK = "▁"
FILTER_BITS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


class Unigram:
    """Pieces of a vocabulary file with log probabilities by Zipf's rule on their ranks; bytes for characters it lacks."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in normal]
        weight = 1 / (np.arange(len(self.pieces) + 1) + 1 + ZIPF_SHIFT)
        log_p = np.log(weight / weight.sum())
        self.byte_log_p = float(log_p[-1])
        self.log_p = dict(zip(self.pieces, log_p.tolist()))
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self.hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], log_p[:-1][order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(mix(hashes) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Log probabilities, -inf for what is no piece."""
        out = np.full(len(hashes), -np.inf)
        maybe = np.flatnonzero(self.filter[(mix(hashes) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == hashes[maybe]
            out[maybe[right]] = self.scores[at[right]]
        return out

    def one_by_one(self, word: str) -> tuple[int, float]:
        """Token count and score of one pre-token, by the same recurrence without sharing."""
        score, count = [0.0], [0]
        for d in range(1, len(word) + 1):
            width = len(word[d - 1].encode())
            best, n = -np.inf, 0
            for k in range(min(self.longest, d), 0, -1):
                p = self.log_p.get(word[d - k : d])
                if p is not None and score[d - k] + p > best:
                    best, n = score[d - k] + p, count[d - k] + 1
            if best == -np.inf or word[d - 1] not in self.log_p:
                spelt = score[d - 1] + width * self.byte_log_p
                if spelt > best:
                    best, n = spelt, count[d - 1] + width
            score.append(best)
            count.append(n)
        return count[-1], score[-1]

    def by_trie(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and scores of distinct pre-tokens in sorted order."""
        n = len(words)
        counts, scores = np.zeros(n, np.int64), np.zeros(n)
        if not n:
            return counts, scores
        size = np.array([len(w) for w in words])
        first = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        # nodes: number, parent, hash of the prefix, best score and count; node 0 is the root
        all_parent, all_pieces = np.zeros((2, 1), np.int64)
        all_hash, all_best = np.zeros(1, np.uint64), np.zeros(1)
        node = np.zeros(n, np.int64)  # of each pre-token's prefix
        total = 1
        power = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(self.longest, BASE))])
        for d in range(int(size.max())):
            alive = np.flatnonzero(size > d)
            char = code[first[:-1][alive] + d]
            # a pre-token that ended above lies between no two others with a common longer prefix
            new = np.ones(len(alive), bool)
            new[1:] = (char[1:] != char[:-1]) | (node[alive][1:] != node[alive][:-1])
            head = alive[new]
            up = node[head]
            c = char[new]
            h = all_hash[up] * BASE + c + np.uint64(1)
            top = np.full(len(head), -np.inf)
            n_pieces = np.zeros(len(head), np.int64)
            lone = np.zeros(len(head), bool)
            chain = [up]
            for _ in range(1, min(self.longest, d + 1)):
                chain.append(all_parent[chain[-1]])
            for k in range(len(chain), 0, -1):
                start = chain[k - 1]
                p = self.lookup(h - all_hash[start] * power[k])
                if k == 1:
                    lone = p > -np.inf
                way = all_best[start] + p
                better = way > top
                top[better] = way[better]
                n_pieces[better] = all_pieces[start[better]] + 1
            width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
            spelt = np.where(lone & (top > -np.inf), -np.inf, all_best[up] + width * self.byte_log_p)
            better = spelt > top
            top[better] = spelt[better]
            n_pieces[better] = (all_pieces[up] + width)[better]
            number = total + np.cumsum(new) - 1
            node[alive] = number
            total += len(head)
            all_parent, all_hash = np.concatenate([all_parent, up]), np.concatenate([all_hash, h])
            all_best, all_pieces = np.concatenate([all_best, top]), np.concatenate([all_pieces, n_pieces])
        counts[:], scores[:] = all_pieces[node], all_best[node]
        counts[size == 0] = 0
        return counts, scores

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and scores of pre-tokens in any order; very long ones share nothing and go one by one."""
        order = sorted(range(len(words)), key=words.__getitem__)
        short = [i for i in order if len(words[i]) <= TRIE_CHARS]
        counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        counts[short], scores[short] = self.by_trie([words[i] for i in short])
        for i in order:
            if len(words[i]) > TRIE_CHARS:
                counts[i], scores[i] = self.one_by_one(words[i])
        return counts, scores


def _count_batches(vocabulary: str | None):
    def run(batches):
        model, reader = Unigram(vocabulary), WordReader(lower=False)
        known, known_count, known_score = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        for batch, data, offsets in chunks_of(batches, limit=CHUNK_BYTES):
            begin, end, first = reader.places(data, offsets)
            unique, where, inverse = np.unique(reader.hashes(data, begin, end), return_index=True, return_inverse=True)
            if len(known) > KNOWN_WORDS:
                known, known_count, known_score = known[:0], known_count[:0], known_score[:0]
            at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
            fresh = np.flatnonzero(known[at] != unique) if len(known) else np.arange(len(unique))
            raw = data.tobytes()
            words = [WORD_MARK + raw[a:b].decode() for a, b in zip(begin[where[fresh]].tolist(), end[where[fresh]].tolist())]
            counts, scores = model.count(words)
            known = np.concatenate([known, unique[fresh]])
            order = np.argsort(known)
            known = known[order]
            known_count = np.concatenate([known_count, counts])[order]
            known_score = np.concatenate([known_score, scores])[order]
            at = np.searchsorted(known, unique)[inverse] if len(known) else inverse
            # sums per row: each row is added up alone, so the result does not depend on its neighbours
            token, score = known_count[at], known_score[at]
            sums = [(int(token[a:b].sum()), float(score[a:b].sum())) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array([s[0] for s in sums], pa.int64()),
                    pa.array([s[1] for s in sums], pa.float64()),
                ],
                names=["doc_id", "n_pretokens", "n_tokens", "log_probability"],
            )

    return run


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, log_probability`` for every row of ``docs``.

    Pre-tokens are what white space separates, each with a word mark in front. A piece's probability falls with its rank in the
    vocabulary file by Zipf's rule; a character that is no piece is spelt in bytes. Of equally good cuts the one whose last piece is
    longer wins. A null, empty or blank text has no tokens; rows that repeat an id are counted once each; null ids are allowed
    and extra columns ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_count_batches(vocabulary), "doc_id long, n_pretokens long, n_tokens long, log_probability double")
