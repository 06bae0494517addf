"""Operators on documents against brute force, with nulls, empties, repeats, ties and clashing column names."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from strandlab.llm import license_scan, line_crf, minmax_dedup, pii_semicrf, superkmer, swap_packing, template_decon, trie_tokens
from strandlab.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


def documents(spark, rows):
    """Rows of (id, text) with extra columns, two of which carry names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    long = "word " * 3000
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (None, "null id here with words enough"), (6, long), (7, long), (8, "one")]


# ---------------------------------------------------------------- near duplicates


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= percent * len(x | y) and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    return {i: (len(sets[i]), name[i], name[i] == i) for i in sets}


def near_copies(rng, groups=6, size=7):
    rows, i = [], 10
    for _ in range(groups):
        base = words(rng, 120)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy).title() if rng.random() < 0.3 else " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_like_brute_force(spark, monkeypatch, percent):
    rows = near_copies(random.Random(1)) + [(i, t) for i, t in odd_rows() if i is not None]
    monkeypatch.setattr(minmax_dedup, "TILE_DOCUMENTS", 3)  # several tiles per bucket
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(documents(spark, rows), similarity=percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, ""), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)], key=str)
    kept = minmax_dedup.drop_near_duplicates(documents(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, None, None]


def test_near_duplicates_empty(spark):
    assert minmax_dedup.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_tile_links_tie_all_together():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 10**9, 100)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(10**9, 2 * 10**9, k)])) for k in (0, 2, 4, 30, 31)]
    sizes = np.array([len(s) for s in sets])
    found = minmax_dedup.tile_links(sets, sizes, np.arange(5), 85)
    assert {i for link in found for i in link} == {0, 1, 2} and len(found) == 2


def test_components_like_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    name = {}

    def find(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            name[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in name}


# ---------------------------------------------------------------- repeated passages


def brute_clean(rows, k):
    lists = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, lists):
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s : s + k])] > 1:
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_strings", [1, 256])
@pytest.mark.parametrize("window,group", [(35, 8), (6, 2), (5, 5)])
def test_repeated_passages_like_brute_force(spark, bucket_strings, window, group):
    rng = random.Random(3)
    passages = [words(rng, 60) for _ in range(3)]
    rows = odd_rows()
    for i in range(40):
        w = words(rng, rng.randrange(0, 120), 5000)
        for _ in range(rng.randrange(0, 3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(passages)
            cut = rng.randrange(0, 20)
            w[at:at] = p[cut:]
        rows.append((100 + i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(300, rows[-1][1]), (300, rows[-1][1]), (301, "é è " * 50)]
    got = superkmer.drop_repeated_passages(documents(spark, rows), window=window, group=group, bucket_strings=bucket_strings)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clean(rows, window)


def test_repeated_passages_text_and_empty(spark):
    rows = [(1, "a b c d e f x"), (2, "y  a b c d e f"), (3, "z\nz2")]
    got = superkmer.drop_repeated_passages(documents(spark, rows), window=5, group=2, with_text=True)
    assert sorted((r.doc_id, r.kept_text) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z\nz2")]
    assert superkmer.drop_repeated_passages(documents(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_pieces_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = swap_packing.byte_pair_encoder()
    rng = random.Random(4)
    texts = ["", " ", "It's  a\n\ttest", "a<|endoftext|>b", "<|endoftext|>", "é漢😀 x", "don't I'LL 12345", "a" * 700, " x y"]
    texts += ["".join(rng.choice("abc  '\n1.é漢") for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, t
    runs = [" " * 1000, "\n" * 1500, " \n\t\u3000\xa0" * 300, "\u2028" * 999 + "\x85\u200a"]
    texts = [f"{a}{run}{b}" for run in runs for a in ("", "x", "x.", "<|endoftext|>") for b in ("", "y", "'s", "<|endoftext|>z", "\x1cq")]
    texts += [f"a{' ' * 1200} b\n{chr(10) * 1100}c  {' ' * 2000}", "x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "ab" * 1_000_000]
    for t in texts:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, t[:9]
    rows = odd_rows() + [(50 + i, " ".join(words(rng, rng.randrange(0, 900)))) for i in range(60)]
    got = swap_packing.pack_documents(documents(spark, rows), group_pieces=16, with_ids=True).collect()
    wanted = collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(swap_packing.cuts(len(ids), 2048)):
            wanted[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), tuple(ids[s : s + n])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == wanted
    check_sequences(got, 2048)


def check_sequences(rows, most):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= most
    return len(sequences)


def test_cuts():
    assert swap_packing.cuts(1, 4) == [(0, 1)] and swap_packing.cuts(4, 4) == [(0, 4)]
    assert swap_packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and swap_packing.cuts(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_swaps_never_lose_and_never_hurt(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [30, 60, 101, 70, 50, 101][seed], 300)
    fitted = swap_packing.best_fit(lengths, 100)
    packed = swap_packing.swap_search(fitted, lengths, 100)
    assert sorted(i for b in packed for i in b) == list(range(300))
    assert all(lengths[b].sum() <= 100 for b in packed) and len(packed) <= len(fitted)
    assert len(packed) >= -(-lengths.sum() // 100)


def test_swap_empties_a_bin():
    # best fit leaves three bins, exchanges need only two
    lengths = np.array([6, 6, 4, 4])
    bins = swap_packing.swap_search([[0], [1], [2, 3]], lengths, 10)
    assert len(bins) == 2 and all(lengths[b].sum() == 10 for b in bins)
    lengths = np.array([5, 5, 3, 3, 4])
    assert len(swap_packing.swap_search([[0, 2], [1, 3], [4]], lengths, 10)) <= 3


def test_packing_empty_and_equal_lengths(spark):
    assert swap_packing.pack_documents(documents(spark, []).limit(0)).count() == 0
    rows = [(i, "a b c") for i in range(50)]
    got = swap_packing.pack_documents(documents(spark, rows), sequence_tokens=9, group_pieces=8).collect()
    assert check_sequences(got, 9) == 25 or check_sequences(got, 9) <= 28


# ---------------------------------------------------------------- licences


def test_licence_places_like_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "under the MIT license Apache version 2 cc by nc a, B. é (x) The CC-BY-NC gnu".split()
    rows = odd_rows() + [(50 + i, rng.choice([" ", "-", " \n "]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(80)]
    rows += [(200, "Under the MIT License. under-the mit license CC BY-NC 4.0")]
    got = {r.doc_id: r for r in license_scan.license_labels(license_scan.scan_licenses(documents(spark, rows))).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [
            (k, label)
            for phrase, label in license_scan.BASE_PHRASES.items()
            for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[200].n_base == 3


def test_places_in_a_text_of_many_notices():
    """Word numbers stay right where phrases overlap, and the time grows with the text (two million words)."""
    machine = license_scan.automaton({"b c": ("base", "x"), "a b c d": ("base", "y"), "c": ("base", "z")})
    text = "a b c d q c  B c\n" * 250_000
    n, places, _ = license_scan.scan_text(text, machine)
    wanted = [(8 * k + w, "base", x) for k in range(3) for w, x in ((0, "y"), (1, "x"), (2, "z"), (5, "z"), (6, "x"), (7, "z"))]
    assert n == 2_000_000 and len(places) == 1_500_000 and sorted(places[:18]) == sorted(wanted)
    assert max(w for w, _, _ in places) == n - 1


def test_licence_expressions(spark):
    parse = license_scan.to_postfix
    assert parse("MIT OR Apache-2.0 AND ISC") == ["MIT", "Apache-2.0", "ISC", "and", "or"]
    assert parse("(MIT or Apache-2.0) and GPL-2.0 with Classpath-exception-2.0") == ["MIT", "Apache-2.0", "or", "GPL-2.0", "Classpath-exception-2.0", "with", "and"]
    for bad in ("", "MIT OR", "(MIT", "MIT)", "OR MIT", "MIT ISC", "MIT & ISC", "()"):
        assert parse(bad) is None
    assert license_scan.evaluate(parse("GPL-3.0 OR MIT")) == (["gpl-3.0", "mit"], license_scan.PERMISSIVE)
    assert license_scan.evaluate(parse("GPL-3.0 AND MIT"))[1] == license_scan.WHOLE
    assert license_scan.evaluate(parse("GPL-2.0 WITH Classpath-exception-2.0")) == (["gpl-2.0"], license_scan.FILES)
    rows = [(1, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC\ncode"), (2, "// spdx-license-identifier: MIT OR\n"), (3, "/* SPDX-License-Identifier: Zlib */")]
    got = {r.doc_id: r for r in license_scan.license_labels(license_scan.scan_licenses(documents(spark, rows))).collect()}
    assert got[1].labels == "gpl-2.0-only,isc,mit" and got[1].score > 0.9
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == "zlib"


# ---------------------------------------------------------------- token counts


def brute_tokens(model, word):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        ways = [(best[k][0] + model.log_p[word[k:d]], best[k][1] + 1) for k in range(max(0, d - model.longest), d) if word[k:d] in model.log_p]
        if not ways or word[d - 1] not in model.log_p:
            n = len(word[d - 1].encode())
            ways.append((best[d - 1][0] + n * model.byte_log_p, best[d - 1][1] + n))
        best.append(max(ways, key=lambda x: x[0]))
    return best[-1]


def test_token_counts_like_brute_force(spark):
    model = trie_tokens.Unigram()
    rng = random.Random(6)
    rows = odd_rows() + [(50 + i, " ".join("".join(rng.choice("theaningé漢😀Q-") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows.append((200, "x" * 500 + " " + "the" * 200))
    got = collections.defaultdict(list)
    for r in trie_tokens.count_tokens(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        found = [brute_tokens(model, "▁" + w.decode()) for w in (t or "").encode().split()]
        r = got[i][0]
        assert (r.n_pretokens, r.n_tokens) == (len(found), sum(n for _, n in found))
        assert r.log_probability == pytest.approx(sum(s for s, _ in found))


# ---------------------------------------------------------------- benchmark items


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    item = "a train leaves the station at 9 km per hour and after 12 minutes Anna counts 9 cars and 12 red lights on the long track"
    other = " ".join(rng.choices(vocabulary, k=30))
    short = "who painted that old bridge"
    bench = spark.createDataFrame([(1, item), (2, other), (3, short), (4, None), (5, ""), (6, "too few")], "item_id long, text string")

    def around(text):
        return " ".join(rng.choices(vocabulary, k=20)) + ".\n" + text + ". " + " ".join(rng.choices(vocabulary, k=20))

    changed = item.replace("9", "30").replace("12", "7").replace("Anna", "Peter").replace("km", "miles")
    uneven = item.replace("9 km", "30 km").replace("12 minutes", "9 minutes")  # one number of the item stands for two
    rows = odd_rows() + [
        (100, around(item)), (101, around(item.upper())), (102, around(changed)), (103, around(uneven)), (104, around(other)), (105, around(short)),
        (106, " ".join(rng.choices(vocabulary, k=200))), (107, around(" ".join(item.split()[:6]))), (108, around(item) + " " + other), (108, around(short)),
    ]
    got = {(r.doc_id, r.item_id): r for r in template_decon.find_leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (102, 1), (104, 2), (105, 3), (108, 1), (108, 2), (108, 3)}
    assert got[100, 1].exact and not got[102, 1].exact
    numbers = spark.createDataFrame([(1, " ".join(str(7 * i) for i in range(40)))], "item_id long, text string")
    tables = [(1, " ".join(str(5 * i) for i in range(300))), (2, "x " + " ".join(str(7 * i) for i in range(40)) + " y")]
    assert {r.doc_id for r in template_decon.find_leaks(documents(spark, tables), numbers).collect()} == {2}
    kept = template_decon.drop_leaks(documents(spark, rows), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([i for i, _ in odd_rows()] + [103, 106, 107], key=str)
    assert template_decon.find_leaks(documents(spark, rows), bench.limit(0)).count() == 0
    assert template_decon.find_leaks(documents(spark, []).limit(0), bench).count() == 0


def leaks(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in template_decon.find_leaks(documents(spark, rows), bench).collect()}


def test_leaks_of_parts_and_short_items(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    item, prose = rng.choices(vocabulary, k=500), " ".join(rng.choices(vocabulary, k=60))
    rows = [(k, f"{prose}. {' '.join(item[90 : 90 + n])}. {prose}") for k, n in ((1, 200), (2, 14), (3, 13), (4, 499))]
    rows += [(5, f"{prose}\n- Yes, it is!\r\n{prose}"), (6, "yes\nIT is"), (7, f"{prose} yes it is {prose}"), (8, "it is\n"), (9, "?"), (10, "yes it is it")]
    got = leaks(spark, rows, [(1, " ".join(item)), (2, "Yes it is"), (3, "!"), (4, "IT is.")])
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 2), (6, 4), (8, 4)}
    assert (got[1, 1].n_windows, got[1, 1].first_word, got[1, 1].exact) == (193, 60, True)
    assert (got[5, 2].n_windows, got[5, 2].first_word, got[5, 2].covered) == (1, 60, 1.0)


def test_leaks_with_one_place_changed(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    parts = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(6)]
    item = " Anna 2019 ".join(parts)
    other = item.replace("Anna", "Maria").replace("2019", "1987")
    rows = [
        (1, item.replace("Anna", "Ana", 1)), (2, item.replace("2019", "2018", 1)), (3, other.replace("Maria", "Mraia", 1)), (4, other),
        (5, "".join(f"{a} {n} " for a, n in zip(parts, ("Anna 1", "Bea 2", "Cleo 3", "Dora 4", "Eve 5", "")))),
    ]
    got = leaks(spark, rows, [(1, item)])
    assert {i for i, _ in got} == {1, 2, 3, 4}
    assert not any(r.exact for r in got.values()) and got[4, 1].covered == 1.0 and got[1, 1].covered > 0.8 and got[3, 1].covered > 0.8


def test_leaks_in_other_capitals_and_lines(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    item = " ".join(w.capitalize() if k % 4 == 2 else w for k, w in enumerate(rng.choices(vocabulary, k=40)))
    short = "was it Anna or Peter Müller"
    rows = [(1, item.lower()), (2, item.upper()), (3, re.sub(" (?=[A-Z])", "\n", item)), (4, re.sub(" (?=[A-Z])", "  ", item)), (5, short.lower()), (6, item)]
    got = leaks(spark, rows, [(1, item), (2, short)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 1)}
    assert all(r.exact and r.covered == 1.0 for r in got.values())


def test_filter_is_added_up_on_executors(spark):
    values = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 30_000)
    table = template_decon.bit_set(spark.createDataFrame([(int(v),) for v in values], "window long").repartition(5), bits=12)
    assert table.nbytes == 512 and len(template_decon.in_bit_set(table, values.view(np.uint64), 12)) == len(values)
    few = template_decon.bit_set(spark.createDataFrame([(int(v),) for v in values[:50]], "window long"), bits=12)
    places = np.unique(np.concatenate(template_decon._filter_places(values[:50].view(np.uint64), 12)))
    assert np.flatnonzero(np.unpackbits(few, bitorder="little")).tolist() == places.tolist()
    assert not template_decon.bit_set(spark.createDataFrame([], "window long")).any()


# ---------------------------------------------------------------- quality


def test_crf_gradient():
    rng = np.random.default_rng(1)
    x, starts, good = rng.normal(size=(9, 4)), np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    weight = np.array([1.0, 2.0, 0.5])
    model = line_crf.Model(rng.normal(size=4), rng.normal(size=(2, 2)))
    _, g = line_crf.loss_and_gradient(model, x, starts, good, weight)
    for part, place in ((0, (1,)), (0, (3,)), (1, (0, 0)), (1, (0, 1)), (1, (1, 1))):
        values = []
        for step in (1e-5, -1e-5):
            moved = [p.copy() for p in model]
            moved[part][place] += step
            values.append(line_crf.loss_and_gradient(line_crf.Model(*moved), x, starts, good, weight)[0])
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[part][place], abs=1e-6)


def test_crf_marginals_like_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    score, chain = rng.normal(size=5), rng.normal(size=(2, 2))
    total = np.zeros(5)
    z = 0.0
    for labels in itertools.product((0, 1), repeat=5):
        p = np.exp(sum(s * (y - 0.5) for s, y in zip(score, labels)) + sum(chain[a, b] for a, b in zip(labels, labels[1:])))
        z += p
        total += p * np.array(labels)
    assert line_crf.marginals(score, np.array([0, 5]), chain) == pytest.approx(total / z)


def test_quality_on_planted_junk(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        good = [" ".join(words(rng, 12)).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            good = [" ".join(w.upper() + "!!" for w in words(rng, 12)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(good)))
        labels.append((i, int(i % 3 != 0), 0))
    labels += [(1, 0, 0), (2, None, 0), (None, 1, 0), (9999, 1, 0)]
    more = [(1000, None), (1001, ""), (1002, "\n\n"), (None, "A plain text with no id.")]
    docs = documents(spark, rows + more)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = line_crf.train_on(docs, marks, sample_documents=100)
    got = {r.doc_id: r for r in line_crf.score_documents(docs, model).collect()}
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(240) if got[i].held_out]
    assert held == [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].predicted == int(i % 3 != 0) for i in held)
    assert got[1000].score == got[1001].score
    kept = line_crf.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    nothing = line_crf.train_on(docs, marks.limit(0))
    assert {r.score for r in line_crf.score_documents(docs, nothing).collect()} == {0.5}
    assert line_crf.keep_good(docs, nothing).count() == 244  # nothing is known against any of them
    assert line_crf.train_on(docs.limit(0), marks).weights.any() == False  # noqa: E712
    assert line_crf.score_documents(docs.limit(0), model).count() == 0


def test_quality_labels_of_other_documents(spark):
    """Labels of ids that are not among the documents, and rows that repeat an id, leave the sample whole and bounded."""
    rows = [(i, f"Line {i} is plain.\nAnd one more." if i % 2 else f"BUY {i} NOW!!!\nCLICK $$$") for i in range(120)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(i, i % 2) for i in range(10_000, 14_000)], "doc_id long, quality int")
    plain = line_crf.train_on(documents(spark, rows), marks.where("doc_id < 120"), sample_documents=100)
    other = line_crf.train_on(documents(spark, rows + rows[:40] * 5), marks, sample_documents=100)
    assert plain.weights.any() and all(np.array_equal(a, b) for a, b in zip(plain, other))
    assert {r.doc_id % 2 for r in line_crf.keep_good(documents(spark, rows), other).collect()} == {1}
    assert not line_crf.train_on(documents(spark, rows), marks, sample_lines=0).weights.any()


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def count(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        d = [int(c) for c in d[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in NUMBER.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(count(m[0])) <= 19 and luhn(count(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(count(m[0])) <= 15]


def test_base_spans_like_the_patterns():
    rng = random.Random(9)
    for alphabet in ("a1.@+- ()%9\n:é\"=x", "0123456789 -.", "a@.b-1", "+1 ()-.0"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 45)))
            assert sorted(plain_spans(text)) == sorted(pii_semicrf.base_spans(text)), text


@pytest.fixture(scope="module")
def weights():
    return pii_semicrf.train(["some plain words to talk about"], lines=700, steps=80)


def test_field_gradient():
    rng = random.Random(10)
    lines = [pii_semicrf.made_up(rng, ["a", "bc"])[0] for _ in range(6)]
    tokens = pii_semicrf.Tokens([(t, a, b) for t in lines for a, b in pii_semicrf.regions(t)])
    a, b = tokens.segments()
    x = pii_semicrf.span_features(tokens, a, b)
    assert x.shape[1] == pii_semicrf.N_FEATURES
    gold = np.full(len(a), -1)
    gold[0] = 2
    w = np.random.default_rng(0).normal(0, 0.1, (len(pii_semicrf.KINDS), x.shape[1]))
    _, g = pii_semicrf.loss_and_gradient(w, tokens, a, b, x, gold)
    for place in ((0, 0), (2, 9), (3, 24)):
        values = []
        for step in (1e-5, -1e-5):
            moved = w.copy()
            moved[place] += step
            values.append(pii_semicrf.loss_and_gradient(moved, tokens, a, b, x, gold)[0])
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[place], abs=1e-6)


def test_best_segmentation_like_enumeration(weights):
    tokens = pii_semicrf.Tokens([("call +1 (706) 555-3138 x", 5, 22)])
    a, b = tokens.segments()
    top = (pii_semicrf.span_features(tokens, a, b) @ weights.T).max(1)
    ways = {(i, j): s for i, j, s in zip(a.tolist(), b.tolist(), top.tolist())}

    def best(t):
        if t == len(tokens.start):
            return 0.0, ()
        options = [best(t + 1)]
        for (i, j), s in ways.items():
            if i == t:
                v, rest = best(j + 1)
                options.append((v + s, ((int(tokens.start[i]), int(tokens.end[j])), *rest)))
        return max(options)

    shift = tokens.shift[0]
    assert [(s, e) for _, s, e in pii_semicrf.best_spans(weights, tokens)[0]] == [(s + shift, e + shift) for s, e in best(0)[1]]


def test_long_regions_in_bounded_memory(weights):
    """A region is walked a few tokens at a time: the stride changes nothing, and a table of numbers stays small."""
    rng = random.Random(13)
    texts = [" ".join(pii_semicrf.made_up(rng, ["alpha"])[0] for _ in range(n)) for n in (1, 1, 2, 9, 40)] + ["12 345 6789 0.5 " * 90]
    tokens = pii_semicrf.Tokens([(t, a, b) for t in texts for a, b in pii_semicrf.regions(t)])
    whole = pii_semicrf.best_spans(weights, tokens, 1 << 20)
    assert any(whole) and all(pii_semicrf.best_spans(weights, tokens, cells) == whole for cells in (9, 32, 500))
    tracemalloc.start()
    pii_semicrf.find_spans(["12 345 6789 0.5 " * 4000], weights)
    small = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pii_semicrf.find_spans(["12 345 6789 0.5 " * 12000], weights)
    large = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert large < 100e6 and large - small < 128_000 * 150  # under 150 bytes a character, where all candidates took 2700


def test_personal_data_on_made_up_lines(spark, weights):
    rng = random.Random(11)
    right = found = wanted = 0
    for _ in range(300):
        text, spans = pii_semicrf.made_up(rng, ["alpha", "beta"])
        base, extra = pii_semicrf.find_spans([text], weights)[0]
        assert sorted(base) == sorted(plain_spans(text))
        field = {s for r in pii_semicrf.best_spans(weights, pii_semicrf.Tokens([(text, a, b) for a, b in pii_semicrf.regions(text)])) for s in r}
        right, found, wanted = right + len(field & set(spans)), found + len(field), wanted + len(spans)
    assert right / found > 0.95 and right / wanted > 0.95
    rows = odd_rows() + [(100, "mail a.b@c.example.com now"), (101, "from 10.0.0.1 or 300.1.1.1"), (102, 'token = "0123456789abcdef0123456789abcdef01234567" x'), (103, "é 4111 1111 1111 1111."), (104, "1 " * 400)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in pii_semicrf.find_personal_data(docs, weights).collect()}
    assert got[100].base_spans == "email:5:22" and got[101].base_spans == "ip:5:13" and got[103].base_spans == "card:2:21"
    assert got[102].spans == "secret:9:49" and got[102].base_spans == "" and got[1].spans == got[2].spans == ""
    masked = pii_semicrf.redact_documents(docs, weights)
    assert masked.columns == docs.columns
    after = {r.doc_id: r for r in masked.collect()}
    assert after[100].text == "mail [EMAIL] now" and after[100].n_chars == 16 and after[1].text is None and after[6].text == "word " * 3000
    assert pii_semicrf.find_personal_data(docs.limit(0), weights).count() == 0


def test_added_spans_overlap_no_base_span(weights):
    rng = random.Random(12)
    for _ in range(60):
        text = " ".join(pii_semicrf.made_up(rng, ["alpha"])[0] for _ in range(3))
        base, extra = pii_semicrf.find_spans([text], weights)[0]
        assert not any(s < e2 and s2 < e for _, s, e in base for _, s2, e2 in extra)
    assert pii_semicrf.joined_ranges([("ip", 4, 6), ("card", 0, 2), ("phone", 1, 3)]) == ([0, 4], [3, 6])


def test_redact_overlaps():
    assert pii_semicrf.redact("abcdefgh", [("ip", 1, 3), ("card", 2, 5), ("phone", 5, 6)]) == "a[IP][PHONE]gh"
    assert pii_semicrf.redact("abc", []) == "abc"


def test_spans_are_joined_by_kind():
    assert pii_semicrf.joined([("phone", 3, 4), ("email", 9, 10)]) == "email:9:10,phone:3:4"
