"""Main text of pages and nearest neighbours against known answers, and the pipeline as a whole."""

import random

import numpy as np
import pytest

import corpus_pipeline
from strandlab.llm import collision_ann, html_extract, line_crf, queries, recurrent, swap_packing

# ---------------------------------------------------------------- pages


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    w = recurrent.new_weights(5, 2, 4, 3, 1)
    counts, numbers = rng.random((4, 2, 5)), rng.random((4, 2, 2))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    labels = rng.integers(0, 2, (4, 2)).astype(float)
    _, g = recurrent.gradients(w, counts, numbers, mask, labels)
    for name in w:
        place = tuple(int(rng.integers(0, n)) for n in w[name].shape)
        values = []
        for step in (1e-6, -1e-6):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][place] += step
            values.append(recurrent.gradients(moved, counts, numbers, mask, labels)[0])
        assert (values[0] - values[1]) / 2e-6 == pytest.approx(g[name][place], abs=1e-6)


def test_blocks():
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><!-- <p>no</p> --><nav><ul><li><a href='/x'>One</a><li>Two</ul></nav>"
        "<article class='post big'><p><b>bold</b> a&amp;b &lt;i&gt;<br>next<p>un  closed\n <div>x < y</div><style>p{}</style>tail</article><p"
    )
    blocks = html_extract.Blocks(page)
    assert blocks.texts == ["One", "Two", "bold a&b <i> next", "un closed", "x < y", "tail"]
    assert blocks.paths[0] == ("<html", "<body", "<nav", "<ul", "<li") and blocks.linked[0] == 1.0
    assert blocks.paths[3] == ("<html", "<body", "<article", "post", "big", "<p")
    for odd in ("", "<", "a < b", "<p", "</", "<!--", "&am", "<a href='", "plain"):
        html_extract.Blocks(odd)


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>t</title><meta charset=x><body><p>one</p>", ["one"]),
        ("<head><title>a <p> b</title><article><p>one</p></article>", ["one"]),
        ("<head><script>'<body>'</script><noscript><img><p>n</noscript><title>t</title></head><p>one", ["one"]),
        ("<svg class='i'/><p>one</p><svg><path/></svg><p>two", ["one", "two"]),
        ("<svg><style/><circle/><text>t</text></svg>one", ["one"]),
        ("<div><svg><path></div>one<svg></svg>", ["one"]),
        ("<body><svg><path><p>one<svg></svg>", ["one"]),
        ("<head-line>one</head-line><select-box>two</select-box><script-x>three", ["one", "two", "three"]),
        ("<div><select><option>o</div>one<select><option>o</select>two<select><option>o<p>three", ["one", "two", "three"]),
        ("<p>one<object><p>f</p></object>two<noscript>n</noscript><template>t</template>three", ["one", "two", "three"]),
        ("<object data=x><p>one</p><p>two", ["one", "two"]),
        ("one<script/>s<p>s", ["one"]),
        ("one<textarea>t</textarea>two<!-- <p>c", ["one", "two"]),
    ],
)
def test_skipped_elements(page, texts):
    assert html_extract.Blocks(page).texts == texts


@pytest.fixture(scope="module")
def weights():
    return html_extract.train([], template_pages=500, epochs=8)


def test_held_out_templates(weights):
    rng = random.Random(123)
    right = total = 0
    for _ in range(200):
        page, labels = html_extract.template_page(rng, ["foo", "bar", "baz", "qux"])
        blocks = html_extract.Blocks(page)
        if len(blocks.texts) != len(labels):
            continue
        counts, numbers, starts = html_extract.features([blocks])
        chance = recurrent.probabilities(weights, recurrent.embed(weights, counts, numbers), starts)
        right += int(((chance >= 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_extract_pages(spark, weights):
    article = "<article><h1>Title here</h1><p>First &amp; long\n sentence of the text.</p><p>Second one.</p></article>"
    rows = [
        (1, "u", f"<html><body><nav><a href='/'>Home</a></nav>{article}<footer>&copy; us</footer></body></html>", "t", 5),
        (2, None, None, None, None),
        (3, "v", "", "", 0),
        (4, "w", "<html><body><nav><a>Menu</a></nav></body></html>", "", 0),
        (None, "x", f"<body>{article}", "", 0),
        (1, "u", "<body><article><p>Cut off in the mid", "", 0),
        (6, "y", "<body><article>" + "<p>Long part of a page.</p>" * 2000 + "</article></body>", "", 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = [r.asDict() for r in html_extract.extract_pages(pages, weights).collect()]
    texts = {(r["page_id"], r["url"]): r["text"] for r in got if r["page_id"] != 1}
    whole = "Title here\nFirst & long sentence of the text.\nSecond one."
    assert sorted(r["text"] for r in got if r["page_id"] == 1) == ["Cut off in the mid", whole]
    assert texts == {(2, None): "", (3, "v"): "", (4, "w"): "", (None, "x"): whole, (6, "y"): "\n".join(["Long part of a page."] * 2000)}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract_pages(pages.limit(0), weights).count() == 0


def test_batches_of_sequences_do_not_matter(weights):
    rng = random.Random(5)
    pages = [html_extract.Blocks(html_extract.template_page(rng, ["a", "b"])[0]) for _ in range(12)]
    counts, numbers, starts = html_extract.features(pages)
    x = recurrent.embed(weights, counts, numbers)
    assert recurrent.probabilities(weights, x, starts, cells=8) == pytest.approx(recurrent.probabilities(weights, x, starts))


# ---------------------------------------------------------------- neighbours


def exact(rows, queries_, k):
    out = {}
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in usable:
        if q in queries_:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in usable if i != q and len(y) == len(x))
            out[q] = near[:k]
    return out


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)]  # many copies of one vector
    rows += [(3000, None), (3100, []), (3200, [0.0] * 16), (3300, [float("nan")] * 16), (3400, [None] * 16), (3500, [float("inf")] * 16), (None, [1.0] * 16), (3600, [1.0, 2.0]), (3700, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    got = {}
    for r in collision_ann.nearest(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    wanted = exact(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 10)
    wanted = {q: near for q, near in wanted.items() if near}
    assert set(got) == set(wanted)
    hits = 0
    for q, near in wanted.items():
        assert sorted(got[q]) == list(range(1, len(near) + 1))
        assert [got[q][k] for k in sorted(got[q])] == sorted(got[q].values())
        hits += len({i for _, i in near} & {i for _, i in got[q].values()})
    assert hits / sum(map(len, wanted.values())) >= 0.9
    assert [got[0][k] for k in range(1, 11)] == [(0.0, 2000 + k) for k in range(10)]  # ties to smaller ids
    assert got[3600] == {1: (0.0, 3700)}
    assert collision_ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_queries_are_not_copied_per_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1200)] + [(2000 + i, [float(i), 1.0]) for i in range(30)]
    rows += [(0, rows[0][1]), (100, rng.normal(size=16).tolist())]  # repeated ids of queries
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    chosen = vectors.where("vec_id % 10 = 0")

    def answers(**settings):
        return sorted(map(tuple, collision_ann.nearest(vectors, chosen, **settings).collect()))

    whole = answers()
    monkeypatch.setattr(collision_ann, "BLOCK_VECTORS", 8)
    spark.conf.set("spark.sql.maxBroadcastTableSize", 256 << 10)  # the queries are 16 KB, with a copy for each block some MB
    try:
        got = answers(neighbours=5)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) == 5 * len({q for q, *_ in got}) == 5 * 123
    by_query = {}
    for q, rank, v, score in whole:
        by_query.setdefault(q, {})[rank] = score
    near = [(score, by_query[q][rank]) for q, rank, _, score in got]
    assert sum(a <= b + 1e-9 for a, b in near) / len(near) >= 0.9
    monkeypatch.setattr(collision_ann, "TASK_PAIRS", 50)
    for size in (1 << 16, 1 << 12):  # a few turns, and many
        assert answers(neighbours=5, state_bytes=size) == got


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)

    def prose(n=80):
        return " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."

    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    item = prose(30)
    rows = [(i, prose()) for i in range(100)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=60))) for i in range(60)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more"), (202, prose() + "\n" + item), (203, prose() + " mail x.y@mail.example.com now."), (204, None), (205, "")]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == documents.columns
    clean = set(range(100))
    assert set(seen["quality"]) - {204, 205} == clean | {200, 201, 202, 203}
    assert set(seen["near_dedup"]) - {204, 205} == clean | {202, 203}
    assert set(seen["decontamination"]) - {204, 205} == clean | {203}
    assert "[EMAIL]" in seen["personal_data"][203].text and seen["personal_data"][7].text == rows[7][1]
    assert set(seen["packing"]) == set(seen["personal_data"])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in final) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect())


def test_registered():
    assert sorted({int(q[2:].split("_")[0]) for q in queries.QUERIES}) == list(range(1, 11))
    assert line_crf.THRESHOLD == 0.7 and swap_packing.SEQUENCE_TOKENS == 2048
