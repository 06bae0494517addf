"""Collocations, hard negatives and languages against plain loops, and their odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlab.llm import language_id, lemp_negatives, phrase_index

# ---------------------------------------------------------------- collocations


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_counts(rows, depth):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, " ".join(words[i : i + k])] += 1
    return counts, totals


def plain_collocations(rows, depth, least, most, share):
    counts, totals = plain_counts(rows, depth)
    out = {}
    for (lang, phrase), a in counts.items():
        w = phrase.split(" ")
        if len(w) < 2 or a < least:
            continue
        if any(g == lang and f >= least and f * 100 >= share * a and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " for (g, q), f in counts.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, l, r))
    found = []
    for lang, rows_ in out.items():
        for rank, (score, a, _, phrase, l, r) in enumerate(sorted(rows_)[:most], 1):
            found.append((lang, rank, phrase, -a, l, r, totals[lang], -score))
    return sorted(found)


def random_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "the", "éa", "É", "x y", "日本", "a\x00b", "-", "'s", "q" * 90]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.choice([3, 6, 12])]) for _ in range(rng.choice([0, 1, 2, 3, 10, 60]))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for w in words)
        out.append((i, text if rng.random() > 0.05 else None, rng.choice(["en", "fr", None])))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_index_enumerates_all_grams(depth):
    rows = random_texts(60, depth)
    text = "\n".join(t or "" for _, t, _ in rows).encode()
    symbols, words = phrase_index.encode(np.frombuffer(text, np.uint8))
    names = [None, *(w.decode() for w in words.to_pylist())]
    found = Counter()
    for g in phrase_index.ShardIndex(symbols, depth).enumerate():
        for j, n in enumerate(g.count.tolist()):
            found["", " ".join(names[w[j]] for w in g.words)] += n
    want = plain_counts([(0, text.decode(), "")], depth)[0]
    assert found == want and symbols[0] == symbols[-1] == 0


def test_intervals_stay_in_step():
    """Each n-gram's rows hold its suffixes in the forward index and its prefixes in the reverse one."""
    rng = np.random.default_rng(1)
    symbols = np.concatenate([[0], rng.integers(0, 4, 400), [0]])
    index = phrase_index.ShardIndex(symbols, 5)
    n = len(symbols)
    forward = sorted(range(n), key=lambda i: (list(symbols[i : i + 4]) + [0] * 4)[:4])
    reverse = sorted(range(n), key=lambda i: (list(symbols[::-1][i : i + 4]) + [0] * 4)[:4])
    for grams in index.enumerate():
        for low, back, count, *words in zip(grams.low, grams.reverse_low, grams.count, *grams.words):
            k = len(words)
            if k <= 4 and k % 2 == 0:
                assert all(list(symbols[forward[i] : forward[i] + k]) == words for i in range(low, low + count))
            if k <= 3 and k % 2 == 1:
                assert all(list(symbols[::-1][reverse[i] : reverse[i] + k]) == words[::-1] for i in range(back, back + count))


@pytest.mark.parametrize("shard_bytes, entries", [(1 << 20, 1 << 20), (50, 64), (7, 40)])
def test_counts_do_not_depend_on_shards(spark, shard_bytes, entries):
    rows = random_texts(80)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts, totals = phrase_index.phrase_counts(df, 3, 4, shard_bytes=shard_bytes, bucket_entries=entries)
    want, sizes = plain_counts(rows, 3)
    got = {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()}
    assert got == {k: f for k, f in want.items() if f >= 4}
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(sizes)


@pytest.mark.parametrize("least, most, share, depth", [(10, 2000, 50, 3), (2, 7, 50, 3), (3, 100, 80, 4)])
def test_collocations_by_plain_loops(spark, least, most, share, depth):
    rows = random_texts(120, least)
    rows += [(1000, "tie one tie one, tie two tie two", "de")] * 10  # ties and repeated rows
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, n int, phrase string, words int")
    got = phrase_index.collocations(df, most, least, depth, share, shard_bytes=300)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, depth, least, most, share)


def test_collocations_of_nothing(spark):
    schema = "doc_id long, text string, lang string"
    for rows in ([], [(1, None, None), (None, "", "en"), (2, " \t .,", "en")], [(1, "a b", "en")]):
        assert phrase_index.collocations(spark.createDataFrame(rows, schema)).collect() == []


def test_long_text_without_piece_ends(spark):
    """Twelve million bytes in one piece, cut into parts that overlap; memory is that of a part."""
    text = "one two three four " * 640_000
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    counts, totals = phrase_index.phrase_counts(df)
    n = 640_000
    got = {r["phrase"]: r["f"] for r in counts.collect()}
    assert got["one"] == got["four"] == got["one two three"] == got["two three four"] == n and got["four one"] == got["three four one"] == got["four one two"] == n - 1
    assert len(got) == 12 and totals.first()["n"] == 4 * n


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) or abs(x) > 1e9 for x in v):
            continue
        row = (i, tuple(int(np.floor(256 * x)) for x in v), label)
        if row not in usable:
            usable.append(row)
    out = []
    for i, v, label in usable:
        if i % 50:
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, l) for j, w, l in usable if j != i and len(w) == len(v)]
        for p, j, _ in sorted(m for m in met if m[2] == label)[:positives]:
            fit = sorted((s, k) for s, k, l in met if l != label and -low * p <= -100 * s <= -high * p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim))
    return [(int(i), [float(x) for x in centres[i % 4] + spread * rng.standard_normal(dim) * rng.choice([0.1, 1, 3])], int(rng.integers(0, 3))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("dim, spread, shelf_rows", [(1, 1.0, 8192), (3, 0.5, 64), (16, 0.3, 100)])
def test_negatives_by_plain_loops(spark, dim, spread, shelf_rows):
    rows = vectors(600, dim, dim, spread)
    rows += rows[:3] + [(50, rows[50][1], rows[50][2])] * 2  # repeated rows
    rows += [(700, [0.0] * dim, 1), (701, None, 1), (702, [], 1), (703, [None] * dim, 1), (704, [float("nan")] * dim, 0), (None, [1.0] * dim, 1), (750, [1.0] * dim, None), (800, [1.0] * (dim + 1), 1), (801, [2.0] * (dim + 1), 2), (802, [1.5] * (dim + 1), 1)]
    rows += [(900 + k, [1.0] * dim, k % 2) for k in range(20)]  # ties
    rows += [(850, [1e300] * dim, 1), (851, [-1e12] * dim, 1)]  # too long to take part
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA + ", id string, part int, length double").repartition(3)
    got = lemp_negatives.hard_negatives(df, df.vec_id % 50 == 0, shelf_rows=shelf_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    for rows in ([], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert lemp_negatives.hard_negatives(df, df.vec_id % 50 == 0).collect() == []


def test_same_id_with_other_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.0], 2), (3, [0.0, 0.8], 2), (4, [0.1, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in lemp_negatives.hard_negatives(df, df.vec_id % 50 == 0).collect()) == plain_negatives(rows)


def test_pruning_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 12))
    x = np.floor(256 * (centres[rng.integers(0, 20, 6000)] + 0.05 * rng.standard_normal((6000, 12)))).astype(np.int64)
    ids = rng.permutation(6000)
    shelf = lemp_negatives.Shelf(ids, x, 512)
    for a in range(0, 200, 10):
        anchor, own = x[a], int(ids[a])
        every = sorted(((-int(s), int(i)) for s, i in zip(x @ anchor, ids) if i != own))
        s, i = shelf.highest(anchor, own, 5)
        assert [(-int(p), int(q)) for p, q in zip(s, i)] == every[:5]
        bounds = [(-(-50 * int(v) // 100), 95 * int(v) // 100) for v in s]
        for (lo, hi), (s2, i2) in zip(bounds, shelf.highest_between(anchor, own, bounds, 3)):
            assert [(-int(p), int(q)) for p, q in zip(s2, i2)] == [e for e in every if lo <= -e[0] <= hi][:3]
    assert shelf.tried < 0.5 * 40 * 6000


def test_large_numbers_are_exact():
    x = np.array([[2**30, 1], [2**30, 2], [2**30 - 1, 3]], np.int64)
    shelf = lemp_negatives.Shelf(np.array([1, 2, 3]), x)
    scores, ids = shelf.highest(x[0], 1, 5)
    assert ids.tolist() == [2, 3] and scores.tolist() == [2**60 + 2, 2**60 - 2**30 + 3]


# ---------------------------------------------------------------- languages

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language_id.train_on(documents)


def taught(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


def test_held_out_accuracy(documents, model):
    rows = language_id.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count() and all(r["held_out"] != taught(r["doc_id"]) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.985 * len(held)
    accepted = [r for r in held if r["accepted"]]
    assert len(accepted) >= 0.9 * len(held) and sum(r["lang"] == r["lang_pred"] for r in accepted) >= 0.985 * len(accepted)


def test_held_out_rows_teach_nothing(spark, documents, model):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.train_on(other.withColumn("source", F.lit("?")))
    assert again.languages == model.languages and np.array_equal(again.embedding, model.embedding) and again.temperature == model.temperature


def plain_score(model, text):
    """A text's mean over the subwords of its words, one by one."""
    subwords = language_id.Subwords()
    total, n = np.zeros(language_id.DIM), 0
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.lower().encode()):
        data = np.frombuffer(w, np.uint8)
        for b in subwords.of_words(data, np.array([0]), np.array([len(w)]))[0]:
            total += model.embedding[b]
            n += 1
    p = model.probabilities((total / n)[None, :])[0]
    return model.languages[int(p.argmax())], float(p.max())


def test_subwords_of_a_word():
    data = np.frombuffer(b"xx abc", np.uint8)
    buckets, words = language_id.Subwords().of_words(data, np.array([0, 3]), np.array([2, 6]))
    # <xx>: 4 + 3 + 2 + 1, <abc>: 5 + 4 + 3 + 2 + 1
    assert words.tolist() == [0] * 10 + [1] * 15
    alone = language_id.Subwords().of_words(data, np.array([3]), np.array([6]))[0]
    assert sorted(alone.tolist()) == sorted(buckets[10:].tolist())


def test_odd_texts(spark, documents, model):
    some = [r["text"] for r in documents.orderBy("doc_id").limit(4).collect()]
    texts = [None, "", " \n", "12 + 3 = 15!", "…—«»", "ÉÈ", "日本語", "q", "q" * 100_000, (some[0] + " ") * 2000, *some, some[0]]
    rows = [(None if k == 7 else k % 12, t, 1.0, "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, lang_pred string")
    got = language_id.identify(df, model).collect()
    assert len(got) == len(texts) and [r["doc_id"] for r in got] == [r[0] for r in rows]
    for t, r in zip(texts, got):
        if not t or not re.search(r"[^\W\d_]", t):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
        elif len(t) <= 100_000:
            lang, score = plain_score(model, t)
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5)
        assert 0 <= r["score"] <= 1
    assert got[10][2:4] == got[14][2:4]


def test_few_languages(spark):
    schema = "doc_id long, text string, lang string"
    none = language_id.train_on(spark.createDataFrame([], schema))
    unlabelled = language_id.train_on(spark.createDataFrame([(i, "text", None) for i in range(9)], schema))
    one = language_id.train_on(spark.createDataFrame([(i, "text", "en") for i in range(9)] + [(20, "1", "fr"), (21, None, "de")], schema))
    df = spark.createDataFrame([(1, "word", "en"), (2, "", None)], schema)
    for m in (none, unlabelled):
        assert [(r["lang_pred"], r["score"]) for r in language_id.identify(df, m).collect()] == [("und", 0.0)] * 2
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(df, one).collect()] == [("en", 1.0), ("und", 0.0)]
    assert language_id.identify(df.limit(0), one).collect() == []


def test_gradient_steps_learn():
    rng = np.random.default_rng(0)
    spans = [rng.integers(0, 50, 30) + 50 * (i % 2) for i in range(200)]
    model = language_id.fit(["a", "b"], spans, np.arange(200) % 2, np.arange(200) % 5 == 0)
    assert (model.probabilities(language_id.means(model.embedding, spans)).argmax(1) == np.arange(200) % 2).all()
    mixed = language_id.fit(["a", "b"], spans, rng.integers(0, 2, 200), np.arange(200) % 5 == 0)
    assert mixed.accepted > 0.5 and mixed.temperature > model.temperature


@pytest.mark.parametrize("most", [0, 255, 256, 2**16, 2**24 - 1, 2**32 - 1, 2**32, 2**62])
def test_packed_steps(most):
    steps = np.array([0, most, most // 3, 1 if most else 0], np.uint64)
    packed = phrase_index._packed_steps(steps)
    assert phrase_index._unpacked_steps(packed, 4).tolist() == steps.tolist() and len(packed) <= 4 * max(8 if most >= 2**32 else 4, 1)
