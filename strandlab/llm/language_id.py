"""Language of a text from averaged embeddings of hashed subwords and a linear softmax, trained by gradient descent in numpy.

Words are runs of letters (and of bytes beyond ASCII), lower-cased and marked at both ends; their byte n-grams are hashed to rows of an
embedding table. A text is the mean of the rows of all its subwords, and a linear layer with a softmax names the language. A part of the
sample that is not trained on sets the temperature of the softmax and the score from which a prediction is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.words import U64, WordReader, chunks_of, mix, odd_numbers

NOTHING = "und"
BUCKET_BITS = 16
GRAMS = (1, 2, 3, 4, 5)
DIM = 16
SAMPLE_DOCUMENTS = 8000  # in all, dealt evenly to the languages
MOST_LANGUAGES = 256
SPANS, SPAN_WORDS, SPAN_SUBWORDS = 2, 60, 1500
CALIBRATION_SHARE = 5  # every fifth document of the sample
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 800, 32, 10.0
ACCEPTED_ERROR = 0.01

LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
_TABLES = {n: odd_numbers(100 + n, n * 256).reshape(n, 256) for n in GRAMS}


class Subwords:
    """Words of texts and the buckets of their subwords."""

    def __init__(self):
        self.reader = WordReader(lower=False, separators=[b for b in range(256) if b not in LETTERS])

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all subwords, and the word that each belongs to (in order)."""
        size = ends - starts + 2
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) - begin[owner]
        marked = np.full(len(owner), ord("<"), np.uint8)
        inside = (place > 0) & (place < size[owner] - 1)
        marked[inside] = data[(starts[owner] + place - 1)[inside]]
        marked[place == size[owner] - 1] = ord(">")
        left = size[owner] - place
        buckets, words = [], []
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            total = np.full(len(at), n, U64)
            for j in range(n):
                total += _TABLES[n][j][marked[at + j]]
            buckets.append((mix(total) >> U64(64 - BUCKET_BITS)).astype(np.int32))
            words.append(owner[at])
        buckets, words = np.concatenate(buckets), np.concatenate(words)
        order = np.argsort(words, kind="stable")
        return buckets[order], words[order]


@dataclass
class Model:
    """Languages, embeddings of buckets, linear layer, temperature and the least accepted score."""

    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accepted: float = 0.0

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return softmax((mean @ self.weights + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def means(embedding: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
    starts = np.cumsum([0, *(len(s) for s in spans)])
    return np.add.reduceat(embedding[np.concatenate(spans)], starts[:-1], axis=0) / np.diff(starts)[:, None]


def fit(languages: list[str], spans: list[np.ndarray], label: np.ndarray, calibrate: np.ndarray, seed: int = 3) -> Model:
    """Stochastic gradient descent on the spans outside ``calibrate``; temperature and least score from those inside."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    model = Model(languages, rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)), np.zeros((DIM, k)), np.zeros(k))
    if k < 2 or not spans:
        return model
    taught = np.flatnonzero(~calibrate) if (~calibrate).any() else np.arange(len(spans))
    rounds = -(-len(taught) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // rounds))
    steps, step = epochs * rounds, 0
    for _ in range(epochs):
        order = rng.permutation(taught)
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            batch = [spans[i] for i in chosen]
            mean = means(model.embedding, batch)
            error = softmax(mean @ model.weights + model.bias)
            error[np.arange(len(chosen)), label[chosen]] -= 1
            error /= len(chosen)
            back = (error @ model.weights.T) * (rate / np.array([len(b) for b in batch]))[:, None]
            model.weights -= rate * mean.T @ error
            model.bias -= rate * error.sum(0)
            # one sum per bucket and span, then one per bucket
            number = np.repeat(np.arange(len(batch)), [len(b) for b in batch])
            key, count = np.unique(np.concatenate(batch).astype(np.int64) * len(batch) + number, return_counts=True)
            bucket, of = np.divmod(key, len(batch))
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            model.embedding[bucket[first]] -= np.add.reduceat(back[of] * count[:, None], first, axis=0)
    held = np.flatnonzero(calibrate) if calibrate.any() else taught
    mean = np.concatenate([means(model.embedding, [spans[i] for i in held[lo : lo + 256]]) for lo in range(0, len(held), 256)])
    true = label[held]
    scale = np.geomspace(0.05, 20, 121)
    losses = []
    for t in scale:
        model.temperature = float(t)
        losses.append(-np.log(np.maximum(model.probabilities(mean)[np.arange(len(true)), true], 1e-12)).mean())
    model.temperature = float(scale[int(np.argmin(losses))])
    p = model.probabilities(mean)
    best = p.max(1)
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(p.argmax(1)[order] != true[order])
    good = np.flatnonzero(wrong <= ACCEPTED_ERROR * np.arange(1, len(order) + 1))
    model.accepted = float(best[order[good[-1]]]) if len(good) else 1.0
    return model


def held_out(id_column: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _span_batches(seed: int):
    def run(batches):
        subwords = Subwords()
        for batch, data, offsets in chunks_of(batches):
            starts, ends, first = subwords.reader.places(data, offsets)
            rows, found = [], []
            for r in range(batch.num_rows):
                lo, hi = int(first[r]), int(first[r + 1])
                if lo == hi:
                    continue
                rng = np.random.default_rng([seed, batch.column(0)[r].as_py() % (1 << 62)])
                for _ in range(SPANS):
                    most = int(rng.integers(2, SPAN_WORDS + 1))
                    at = lo + int(rng.integers(0, max(1, hi - lo - most + 1)))
                    end = min(at + most, hi)
                    rows.append(r)
                    found.append(subwords.of_words(data, starts[at:end], ends[at:end])[0][:SPAN_SUBWORDS])
            taken = batch.take(pa.array(rows, pa.int64()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([f.tolist() for f in found], kind)], names=["h", "lang", "buckets"])

    return run


def train_on(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_documents: int = SAMPLE_DOCUMENTS, seed: int = 3
) -> Model:
    """Model fitted on at most ``sample_documents`` documents that are not held out and have a language, the same number of each language.

    Of a document two spans of 2 to 60 words (at most 1500 subwords) at places drawn by its hash are used. Only the 256 most frequent
    languages are learned. Documents without a letter teach nothing. With one language all is predicted as that, with none nothing is.
    """
    known = docs.where(F.col(lang_column).isNotNull() & ~held_out(id_column))
    sizes = known.groupBy(F.col(lang_column).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return fit([], [], np.zeros(0, np.int64), np.zeros(0, bool))
    each = max(1, sample_documents // len(sizes))
    # a hash threshold per language draws a little more than wanted in the pass that reads the texts
    share = {r["lang"]: min(1.0, (1.2 * each + 50) / r["count"]) for r in sizes}
    limits = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30)))])
    rows = known.select(F.xxhash64(F.col(id_column).cast("string"), F.lit(seed)).alias("h"), F.col(lang_column).alias("lang"), F.lower(text_column).alias("text"))
    drawn = rows.where(F.col("text").isNotNull() & (F.pmod(F.col("h"), F.lit(1 << 30)) < F.coalesce(F.element_at(limits, F.col("lang")), F.lit(0))))
    found = drawn.mapInArrow(_span_batches(seed), "h long, lang string, buckets array<int>")
    order = Window.partitionBy("lang").orderBy("h", "buckets")
    taken = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each * SPANS).select("h", "lang", "buckets").toArrow()
    taken = taken.sort_by([("lang", "ascending"), ("h", "ascending")])
    languages = sorted(set(taken["lang"].to_pylist()))
    spans = [np.asarray(b.values, np.int64) for b in taken["buckets"]]
    label = np.searchsorted(np.array(languages, object), np.array(taken["lang"].to_pylist(), object)) if languages else np.zeros(0, np.int64)
    hashes = taken["h"].to_numpy().view(U64) if len(taken) else np.zeros(0, U64)
    return fit(languages, spans, label.astype(np.int64), (mix(hashes) % U64(CALIBRATION_SHARE)) == 0, seed)


def _predict_batches(model: Model):
    k = len(model.languages)
    # with few languages the linear layer is applied to the table, since it commutes with the mean
    folded = k < model.embedding.shape[1]
    table = (model.embedding @ model.weights if folded else model.embedding).astype(np.float32)
    weights = np.eye(k) if folded else model.weights
    bias, temperature, accepted, names = model.bias, model.temperature, model.accepted, np.array([*model.languages, NOTHING], object)

    def run(batches):
        subwords = Subwords()
        for batch, data, offsets in chunks_of(batches, limit=4 << 20):
            starts, ends, first = subwords.reader.places(data, offsets)
            total, count = np.zeros((batch.num_rows, table.shape[1])), np.zeros(batch.num_rows)
            if len(starts) and k:
                _, at, number = np.unique(subwords.reader.hashes(data, starts, ends), return_index=True, return_inverse=True)
                buckets, owner = subwords.of_words(data, starts[at], ends[at])
                begin = np.searchsorted(owner, np.arange(len(at)))
                of_word, size = np.add.reduceat(table[buckets], begin, axis=0, dtype=np.float64), np.bincount(owner, minlength=len(at))
                row = np.repeat(np.arange(batch.num_rows), np.diff(first))
                count = np.bincount(row, size[number], batch.num_rows)
                for j in range(table.shape[1]):
                    total[:, j] = np.bincount(row, of_word[number, j], batch.num_rows)
            best, score = np.full(batch.num_rows, k), np.zeros(batch.num_rows)
            some = np.flatnonzero((count > 0) & batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            if len(some) and k:
                p = softmax((total[some] / count[some, None] @ weights + bias) / temperature)
                best[some], score[some] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array((best < k) & (score >= accepted))],
                                             names=["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row of ``docs``, from its whole text.

    ``score`` is the calibrated probability of the predicted language. A text that is null or has no letter is ``und`` with score 0, as is
    every text where no language was learned. ``accepted`` is false for these and for scores under the calibrated limit. Null ids and
    rows that repeat an id are kept; extra columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.lower(text_column).alias("text"),
                       F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    found = rows.mapInArrow(_predict_batches(model), "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
