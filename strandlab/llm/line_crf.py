"""Document quality from lines: a linear-chain conditional random field labels every line good or bad.

A line is seen through shares of its bytes and words and through those of the lines beside it. The chain's forward-backward
marginals, weighted by line length, give the score of a document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.words import WordReader, chunks_of, mix
from strandlab.session import materialise

SAMPLE_DOCUMENTS = 2000
SAMPLE_BYTES = 1 << 16
SAMPLE_LINES = 500
STEPS = 150
PENALTY = 2e-4
CHAIN_PENALTY = 3e-2
THRESHOLD = 0.7
SHARES = 11
FEATURES = 2 * SHARES + 3


class Model(NamedTuple):
    weights: np.ndarray  # of a line and of the lines before and after it
    chain: np.ndarray  # 2 x 2 scores of steps between labels, bad first


def _byte_kinds() -> np.ndarray:
    """0 white space, 1 lower case, 2 upper case, 3 digit, 4 ordinary punctuation, 5 other symbol, 6 beyond ASCII."""
    kind = np.full(256, 5, np.uint8)
    kind[:33] = 0
    kind[list(b".,;:?-'\"()")] = 4
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 3, 2, 1, 6
    return kind


class LineReader:
    """Lines of a run of rows and their features."""

    def __init__(self):
        self.reader = WordReader(lower=True)
        self.kind = _byte_kinds()

    def lines(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, byte length and row of each line. Rows without bytes have no line."""
        if not len(data):
            return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, np.int64)
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
        length = np.diff(starts, append=len(data))
        row = np.searchsorted(offsets, starts, "right") - 1
        kind = self.kind[data]

        def total(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask, starts, dtype=np.float64)

        seen = total(kind > 0)
        symbol = kind == 5
        runs = np.zeros_like(symbol)
        runs[1:] = symbol[1:] & symbol[:-1]
        upper, lower = total(kind == 2), total(kind == 1)
        bounds = np.append(starts, len(data))
        begin, end, first = self.reader.places(data, bounds)
        words = np.diff(first).astype(np.float64)
        hashed = self.reader.hashes(data, begin, end)
        owner = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(first))
        same, distinct, often, edge, tail = np.zeros((5, len(starts)))
        if len(hashed):
            next_same = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
            same = np.bincount(owner[1:][next_same].astype(np.int64), minlength=len(starts)).astype(np.float64)
            keys = np.sort((owner << np.uint64(40)) | (hashed >> np.uint64(24)))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts)).astype(np.float64)
            edge = np.bincount(owner.astype(np.int64), symbol[begin], len(starts))
            tail = np.bincount(owner.astype(np.int64), symbol[end - 1], len(starts))
            full = np.flatnonzero(words)
            place = np.arange(len(hashed), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
            print_ = np.zeros(len(starts), np.uint64)
            print_[full] = np.add.reduceat(mix(hashed + place), first[:-1][full])
            line_key = (row.astype(np.uint64) << np.uint64(40)) | (mix(print_) >> np.uint64(24))
            _, which, count = np.unique(line_key, return_inverse=True, return_counts=True)
            often = np.where(words > 0, 1 - 1 / count[which], 0.0)
        seen1, words1 = np.maximum(seen, 1), np.maximum(words, 1)
        long_text = np.clip(words / 30, 0, 1)
        shares = np.stack(
            [
                total(symbol) / seen1,
                total(runs) / seen1,
                upper / np.maximum(upper + lower, 1) * np.clip(words / 6, 0, 1),
                total(kind == 3) / seen1,
                total(kind == 4) / seen1,
                edge / words1,
                tail / words1,
                same / words1,
                np.where(words > 0, 1 - distinct / words1, 0.0) * long_text,
                often,
                np.clip((seen / words1 - 5) / 20, 0, 1),
            ],
            axis=1,
        )
        more = np.stack([np.ones(len(starts)), np.log1p(words) / 5, (words == 0).astype(np.float64)], axis=1)
        return np.concatenate([shares, np.minimum(4 * shares, 1), more], axis=1), length.astype(np.float64), row


def with_neighbours(lines: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after in its row (0 where there is none)."""
    before, after = np.zeros_like(lines), np.zeros_like(lines)
    same = (row[1:] == row[:-1])[:, None]
    before[1:] = lines[:-1] * same
    after[:-1] = lines[1:] * same
    return np.concatenate([lines, before, after], axis=1)


def _batches(sizes: np.ndarray, cells: int = 1 << 17):
    """Sequences of similar length together: their numbers."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] * (hi + 1 - lo) <= cells and sizes[order[hi]] <= 2 * sizes[order[lo]] + 8:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _padded(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = starts[rows + 1] - starts[rows]
    inside = np.arange(sizes.max())[:, None] < sizes[None, :]
    return np.where(inside, starts[rows][None, :] + np.arange(len(inside))[:, None], 0), inside


def _chain(score: np.ndarray, inside: np.ndarray, chain: np.ndarray):
    """Forward and backward messages; ``score``: (steps, rows), how much a line looks good."""
    half = np.clip(score, -30, 30) / 2
    local = np.stack([np.exp(-half), np.exp(half)], axis=2)
    step = np.exp(chain)
    steps, rows = score.shape
    forth = np.empty((steps, rows, 2))
    back = np.ones((steps, rows, 2))
    now = local[0] / local[0].sum(1, keepdims=True)
    log_z = np.log(local[0].sum(1))
    forth[0] = now
    for t in range(1, steps):
        new = (now @ step) * local[t]
        z = new.sum(1, keepdims=True)
        m = inside[t]
        now = np.where(m[:, None], new / z, now)
        log_z += np.where(m, np.log(z[:, 0]), 0.0)
        forth[t] = now
    now = np.ones((rows, 2))
    for t in range(steps - 2, -1, -1):
        new = (local[t + 1] * now) @ step.T
        now = np.where(inside[t + 1][:, None], new / new.sum(1, keepdims=True), now)
        back[t] = now
    return local, step, forth, back, log_z


def marginals(score: np.ndarray, starts: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Chance that each line is good. ``starts``: first line of each document, one more than documents."""
    out = np.zeros(len(score))
    for rows in _batches(np.diff(starts)):
        at, inside = _padded(rows, starts)
        _, _, forth, back, _ = _chain(score[at], inside, chain)
        both = forth * back
        out[at[inside]] = (both[..., 1] / both.sum(2))[inside]
    return out


def loss_and_gradient(model: Model, x: np.ndarray, starts: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, Model]:
    """Weighted mean negative log-likelihood per document, whose lines all carry its label, plus penalties."""
    score = x @ model.weights
    loss, d_score, d_chain = 0.0, np.zeros(len(x)), np.zeros((2, 2))
    for rows in _batches(np.diff(starts)):
        at, inside = _padded(rows, starts)
        local, step, forth, back, log_z = _chain(score[at], inside, model.chain)
        y, w = good[rows], weight[rows]
        sign = np.where(y == 1, 0.5, -0.5)
        pairs = inside.sum(0) - 1
        truth = (np.clip(score[at], -30, 30) * inside).sum(0) * sign + pairs * np.where(y == 1, model.chain[1, 1], model.chain[0, 0])
        loss += (w * (log_z - truth)).sum()
        both = forth * back
        p = both[..., 1] / both.sum(2)
        d_score[at[inside]] = ((p - y) * w)[inside]
        joint = forth[:-1, :, :, None] * step * (local[1:] * back[1:])[:, :, None, :]
        joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
        d_chain += (joint * (inside[1:] * w)[:, :, None, None]).sum((0, 1))
        d_chain[1, 1] -= (w * pairs * (y == 1)).sum()
        d_chain[0, 0] -= (w * pairs * (y == 0)).sum()
    n = max(weight.sum(), 1e-9)
    loss = loss / n + PENALTY / 2 * (model.weights**2).sum() + CHAIN_PENALTY / 2 * (model.chain**2).sum()
    return loss, Model(x.T @ d_score / n + PENALTY * model.weights, d_chain / n + CHAIN_PENALTY * model.chain)


def fit(x: np.ndarray, starts: np.ndarray, good: np.ndarray, steps: int = STEPS, rate: float = 0.15) -> Model:
    """Model of documents given as lines; a long document weighs no more than a short one."""
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(good):
        return model
    weight = 1 / np.maximum(np.diff(starts), 1)
    m, v = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(model, x, starts, good, weight)
        parts = []
        for k, (p, d) in enumerate(zip(model, g)):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d**2
            parts.append(p - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9))
        model = Model(*parts)
    return model


def document_scores(model: Model, lines: np.ndarray, length: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Length-weighted chance of good lines per row; a row without bytes counts as one blank line."""
    blank = np.zeros((1, FEATURES))
    blank[0, -3] = blank[0, -1] = 1.0
    empty = np.setdiff1d(np.arange(n_rows), row)
    if len(empty):
        lines = np.concatenate([lines, np.repeat(blank, len(empty), 0)])
        length, row = np.concatenate([length, np.ones(len(empty))]), np.concatenate([row, empty])
        order = np.argsort(row, kind="stable")
        lines, length, row = lines[order], length[order], row[order]
    starts = np.searchsorted(row, np.arange(n_rows + 1))
    chance = marginals(with_neighbours(lines, row) @ model.weights, starts, model.chain)
    return np.clip(np.bincount(row, chance * length, n_rows) / np.bincount(row, length, n_rows), 0.0, 1.0)


def _sample_batches(batches):
    reader = LineReader()
    for batch, data, offsets in chunks_of(batches):
        lines, length, row = reader.lines(data, offsets)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        flat = pa.ListArray.from_arrays(pa.array(first * FEATURES, pa.int32()), pa.array(lines.reshape(-1), pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], names=["doc_id", "quality", "lines"])


def _score_batches(model: Model):
    def run(batches):
        reader = LineReader()
        for batch, data, offsets in chunks_of(batches, limit=2 << 20):
            scores = document_scores(model, *reader.lines(data, offsets), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return run


def held_out(id_column: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_documents: int = SAMPLE_DOCUMENTS,
    sample_bytes: int = SAMPLE_BYTES,
    sample_lines: int = SAMPLE_LINES,
) -> Model:
    """Model fitted on at most ``sample_documents`` labelled documents of each quality that are not held out and whose text has at
    most ``sample_bytes`` bytes and ``sample_lines`` line breaks: those with the smallest hash of their id. Labels of ids without
    such a text are not drawn; of rows that repeat an id the smallest text teaches. Rows with a null or contradictory label teach
    nothing. Without any labelled document, every line is as likely good as bad."""
    known = (
        labels.where("quality in (0, 1)")
        .groupBy(F.col(id_column).alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_h"))
        .where("quality = _h and doc_id is not null")
        .where(~held_out("doc_id"))
        .drop("_h")
    )
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = rows.where(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) <= sample_lines)
    # only ids move here; the texts of the drawn ones are read afterwards
    usable = materialise(known.join(rows.select("doc_id").distinct(), "doc_id"), "labelled-ids")
    drawn = [
        usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(q)), "doc_id").limit(sample_documents) for q in (0, 1)
    ]
    chosen = drawn[0].unionByName(drawn[1])
    taught = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    taught = taught.select("doc_id", "text", "quality")
    found = taught.mapInArrow(_sample_batches, "doc_id long, quality int, lines array<float>").toArrow().sort_by("doc_id")
    lines = [np.asarray(x.values, np.float64).reshape(-1, FEATURES) if len(x.values or ()) else np.zeros((0, FEATURES)) for x in found["lines"]]
    good = found["quality"].to_numpy().astype(np.float64)
    full = [i for i, x in enumerate(lines) if len(x)]
    if not full:
        return fit(np.zeros((0, 3 * FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    starts = np.concatenate([[0], np.cumsum([len(lines[i]) for i in full])])
    row = np.repeat(np.arange(len(full)), np.diff(starts))
    return fit(with_neighbours(np.concatenate([lines[i] for i in full]), row), starts, good[full])


def score_documents(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text counts as one blank line. Rows that repeat an id are scored once each; null ids are allowed; extra
    columns are ignored. Equal texts get equal scores.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scored = rows.mapInArrow(_score_only(model), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _score_only(model: Model):
    run = _score_batches(model)

    def only(batches):
        for batch in run(batches):
            yield batch.select(["doc_id", "score"])

    return only


def keep_good(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` scored at least ``threshold``, with their columns. A column named ``score`` may be among them.
    A model that has learned nothing tells no row from another and keeps them all."""
    if not any(np.any(x) for x in model):
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index(text_column)}"
    kinds = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes))

    def run(batches):
        reader = LineReader()
        for batch, data, offsets in chunks_of(batches, text, limit=2 << 20):
            scores = document_scores(model, *reader.lines(data, offsets), batch.num_rows)
            yield batch.filter(pa.array(scores >= threshold))

    return plain.mapInArrow(run, kinds).toDF(*names)
