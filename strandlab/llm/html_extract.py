"""Main text of web pages: a recurrent labeller reads all blocks of a page and keeps those of the article.

A page becomes a sequence of leaf blocks. A block is described by its hashed tag path (element names, class and id words), by
its hashed words and by a few numbers. A bidirectional recurrent net reads the whole sequence and labels every block. It is
trained on pages made from templates, whose labels are known, and on a bounded sample of the given pages, labelled
by the elements that enclose a block.
"""

from __future__ import annotations

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm import recurrent
from strandlab.llm.words import WordReader

PATH_BINS, WORD_BINS, NUMBERS, WIDTH, HIDDEN = 512, 64, 6, 24, 16
SAMPLE_PAGES = 200
TEMPLATE_PAGES = 800
EPOCHS = 10
PAGES_AT_ONCE = 200

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*(?:>|\Z)",
    re.S | re.I,
)
# only these run to the page end where their end tag is missing
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "iframe")}
TITLE_END = re.compile(r"</title\s*>|(?=</?(?:head|body|title|svg)[\s/>])", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SKIPPED = frozenset("head svg select object template noscript".split())  # their text is no text of the page
FALLBACK = frozenset("object template noscript".split())  # of these, only where the end tag is there
HEAD_PARTS = frozenset("html head title base basefont bgsound link meta noframes noscript template".split())
SCOPES = frozenset("ul ol dl table tbody thead body html div section article".split()) | SKIPPED
BREAKS = frozenset(  # start tags that end an unclosed svg or select
    "body article section main nav header footer aside form address blockquote dl dd dt figure h1 h2 h3 h4 h5 h6 li menu ol p pre table ul".split()
)

ARTICLE_NAMES = "article main content post story entry body text page".split()
OTHER_ELEMENTS = "nav header footer aside form button".split()
OTHER_NAMES = (
    "ad ads advert advertisement sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead topbar footer bottom legal copyright cookie cookies consent notice banner alert popup modal comment comments reply replies "
    "respond discussion disqus share sharing social related recommended newsletter subscribe signup login search widget pagination pager "
    "tags toolbar form contact"
).split()


class Blocks:
    """Blocks of a page: text, path words and share of linked characters."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.paths: list[tuple[str, ...]] = []
        self.linked: list[float] = []
        self._stack: list[tuple[str, tuple[str, ...], int]] = []  # name, path words, blocks before it
        self._parts: list[str] = []
        self._size = self._links = 0
        self._headed = False
        place = 0
        while m := MARKUP.search(page, place):
            if m.start() > place:
                self._text(page[place : m.start()])
            place = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            closed = m[3].endswith("/")
            if name in RAW_END and not (closed and self._inside("svg")):
                self._flush()
                end = RAW_END[name].search(page, m.start())
                place = end.end() if end else len(page)
            elif name == "title" and self._headed and (end := TITLE_END.search(page, place)) and end[0]:
                place = end.end()
            elif closed and (name == "svg" or name not in BREAKS and self._inside("svg")):
                self._flush()
            else:
                self._open(name, m[3])
        if place < len(page):
            self._text(page[place:])
        self._pop_to(0)

    def _inside(self, name: str) -> bool:
        return any(entry[0] == name for entry in self._stack)

    def _text(self, raw: str) -> None:
        if self._stack and self._stack[-1][0] == "head" and raw.strip():
            self._pop_to(len(self._stack) - 1)
        self._parts.append(html.unescape(raw) if "&" in raw else raw)
        self._size += len(raw)
        if self._inside("a"):
            self._links += len(raw)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.texts.append(text)
            self.paths.append(tuple(w for _, words, _ in self._stack for w in words))
            self.linked.append(self._links / max(self._size, 1))
        self._parts, self._size, self._links = [], 0, 0

    def _pop_to(self, k: int, ended: bool = False) -> None:
        """Leaves the elements from ``k`` on; ``ended``: element ``k`` has its end tag."""
        self._flush()
        drop = [entry[2] for entry in self._stack[k:] if entry[0] in SKIPPED - FALLBACK]
        if ended and self._stack[k][0] in SKIPPED:
            drop.append(self._stack[k][2])
        if drop:
            for part in (self.texts, self.paths, self.linked):
                del part[min(drop) :]
        del self._stack[k:]

    def _end_unclosed(self, name: str) -> None:
        """Ends a head, svg or select whose end tag is missing, when a start tag comes that cannot lie in it."""
        for k in range(len(self._stack) - 1, -1, -1):
            inner = self._stack[k][0]
            if inner in FALLBACK or inner == "foreignobject":
                if name != "body":
                    return
            elif (name not in HEAD_PARTS) if inner == "head" else (inner in ("svg", "select") and name in BREAKS):
                self._pop_to(k)
                return

    def _open(self, name: str, attributes: str) -> None:
        self._end_unclosed(name)
        if name in INLINE:
            if name == "br":
                self._parts.append(" ")
            elif name not in VOID:
                self._stack.append((name, (), 0))
            return
        self._flush()
        if name in SKIPPED:
            self._headed |= name == "head"
            self._stack.append((name, (), len(self.texts)))
            return
        if name not in ("html", "body"):
            self._leave("p")
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in CLOSES.get(name, ()):
                self._pop_to(k)
                break
            if self._stack[k][0] in SCOPES:
                break
        if name in VOID:
            return
        words = ["<" + name]
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                words += NAME_WORD.findall((m[2] or m[3] or m[4] or "").lower())
        self._stack.append((name, tuple(words), 0))

    def _leave(self, name: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                self._pop_to(k)
                break
            if self._stack[k][0] in SCOPES:
                break

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                if name in INLINE:
                    del self._stack[k:]
                else:
                    self._pop_to(k, ended=True)
                break
            if name in INLINE and self._stack[k][0] not in INLINE:
                break


def features(pages: list[Blocks]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed path and word shares, numbers, and the first block of each page (one more than pages)."""
    starts = np.concatenate([[0], np.cumsum([len(p.texts) for p in pages], dtype=np.int64)])
    texts = [t for p in pages for t in p.texts]
    n = len(texts)
    counts = np.zeros((n, PATH_BINS + WORD_BINS))
    numbers = np.zeros((n, NUMBERS))
    if not n:
        return counts, numbers, starts
    bins: dict[str, int] = {}
    row = 0
    for p in pages:
        for path, linked, text in zip(p.paths, p.linked, p.texts):
            for w in path:
                if w not in bins:
                    bins[w] = zlib.crc32(w.encode()) % PATH_BINS
                counts[row, bins[w]] = 1.0
            numbers[row] = 1.0, linked, np.log1p(len(text)) / 8, text[-1] in ".!?:\"", len(path) / 10, text.count(" ") / len(text)
            row += 1
    data = "\n".join(texts).encode()
    reader = WordReader(lower=True)
    sizes = np.array([len(t.encode()) + 1 for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    offsets[-1] = len(data)
    begin, end, first = reader.places(np.frombuffer(data, np.uint8), offsets)
    hashed = reader.hashes(np.frombuffer(data, np.uint8), begin, end)
    owner = np.repeat(np.arange(n), np.diff(first))
    np.add.at(counts, (owner, PATH_BINS + (hashed % np.uint64(WORD_BINS)).astype(np.int64)), 1.0)
    counts[:, PATH_BINS:] /= np.maximum(np.diff(first), 1)[:, None]
    return counts, numbers, starts


def labels_by_element(page: Blocks) -> np.ndarray:
    """1 for blocks inside an article or main element and in none that is not article text, else 0."""
    other = {"<" + e for e in OTHER_ELEMENTS} | set(OTHER_NAMES)
    return np.array([float(("<article" in p or "<main" in p) and not other & set(p)) for p in page.paths])


def template_page(rng: random.Random, words: list[str]) -> tuple[str, list[float]]:
    """A made-up page and the label of each of its blocks."""
    out: list[str] = []
    labels: list[float] = []

    def sentence(lo: int, hi: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(lo, hi))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def block(tag: str, label: float, lo: int, hi: int, link: bool = False) -> None:
        text = sentence(lo, hi)
        out.append(f"<{tag}><a href='x'>{text}</a></{tag}>" if link else f"<{tag}>{text}</{tag}>")
        labels.append(label)

    def named(tag: str, names: list[str]) -> str:
        name = rng.choice(names)
        if rng.random() < 0.3:
            name += rng.choice(["-box", "-wrap", " col", "-1", "_inner"])
        return f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{name}\">"

    def other(inside: bool) -> None:
        kind = rng.random()
        if kind < 0.4:
            tag = rng.choice(["nav", "header", "footer", "aside", "form"] if not inside else ["aside", "form", "nav", "footer"])
            out.append(named(tag, OTHER_NAMES) if rng.random() < 0.3 else f"<{tag}>")
        else:
            tag = rng.choice(["div", "section", "ul", "div"])
            out.append(named(tag, OTHER_NAMES))
        listed = tag == "ul" or rng.random() < 0.3
        for _ in range(rng.randint(1, 5)):
            if listed:
                block("li", 0, 1, 4, rng.random() < 0.7)
            else:
                block(rng.choice(["p", "p", "div", "h3", "span"]) if rng.random() < 0.7 else "p", 0, 2, 40, rng.random() < 0.2)
                if out[-1].startswith("<span"):
                    out.append("<hr>")
        out.append(f"</{tag}>")

    for _ in range(rng.randint(0, 3)):
        other(False)
    wraps = []
    if rng.random() < 0.3:
        out.append("<div class='wrapper'>")
        wraps.append("div")
    if rng.random() < 0.85:
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        out.append(named(tag, ARTICLE_NAMES) if tag in ("div", "section") or rng.random() < 0.3 else f"<{tag}>")
        wraps.append(tag)
    block(rng.choice(["h1", "h1", "h2"]), 1, 2, 12)
    for _ in range(rng.randint(0, 12)):
        if rng.random() < 0.1:
            other(True)
        elif rng.random() < 0.1:
            out.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                block("li", 1, 1, 12)
            out.append("</ul>")
        else:
            block(rng.choice(["p", "p", "p", "p", "p", "h2", "blockquote", "pre"]), 1, 1, 80, rng.random() < 0.03)
    for _ in range(rng.randint(0, 1)):
        other(True)
    out += [f"</{t}>" for t in reversed(wraps)]
    for _ in range(rng.randint(0, 3)):
        other(False)
    return "<html><body>" + "".join(out) + "</body></html>", labels


def train(pages: list[str], template_pages: int = TEMPLATE_PAGES, epochs: int = EPOCHS, seed: int = 7) -> recurrent.Weights:
    """Weights of the labeller, from made-up pages and the given sample."""
    rng = random.Random(seed)
    words = sorted({w.lower() for p in pages for w in re.findall(r"[^\W\d_]+", p)})[:5000] or ["text", "word", "line"]
    parsed, labels = [], []
    for _ in range(template_pages):
        page, marks = template_page(rng, words)
        blocks = Blocks(page)
        if len(blocks.texts) == len(marks):
            parsed.append(blocks)
            labels.append(np.array(marks))
    for page in pages:
        blocks = Blocks(page)
        marks = labels_by_element(blocks)
        if marks.any():
            parsed.append(blocks)
            labels.append(marks)
    counts, numbers, starts = features(parsed)
    sequences = [(counts[a:b], numbers[a:b], y) for a, b, y in zip(starts, starts[1:], labels)]
    weights = recurrent.new_weights(PATH_BINS + WORD_BINS, NUMBERS, WIDTH, HIDDEN, seed)
    return recurrent.fit(weights, sequences, epochs)[0]


def main_texts(pages: list[str], weights: recurrent.Weights) -> list[str]:
    """Main text of each page: its article blocks, one per line."""
    parsed = [Blocks(p) for p in pages]
    counts, numbers, starts = features(parsed)
    chance = recurrent.probabilities(weights, recurrent.embed(weights, counts, numbers), starts)
    return [
        "\n".join(t for t, c in zip(p.texts, chance[a:b]) if c >= 0.5) for p, a, b in zip(parsed, starts, starts[1:])
    ]


def _extract_batches(weights: recurrent.Weights):
    def run(batches):
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), PAGES_AT_ONCE):
                part = batch.slice(lo, PAGES_AT_ONCE)
                found = main_texts([x or "" for x in part.column(2).to_pylist()], weights)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def train_on(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", sample_pages: int = SAMPLE_PAGES) -> recurrent.Weights:
    """Weights fitted on made-up pages and on at most ``sample_pages`` of the given ones, those with the smallest hash of their id."""
    some = pages.select(id_column, html_column).where(F.col(html_column).isNotNull())
    ids = some.select(id_column).orderBy(F.xxhash64(id_column), id_column).limit(sample_pages)
    rows = some.join(F.broadcast(ids), id_column, "left_semi").limit(2 * sample_pages).collect()
    return train(sorted(r[html_column] for r in rows))


def extract_pages(
    pages: DataFrame, weights: recurrent.Weights, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null or empty html, or a page without article blocks, gives an empty text. Character references are decoded, white space inside a
    block becomes one space, blocks keep the page's order and are joined by a line break. A page cut off in the
    middle keeps what came before. Rows that repeat an id are read once each; extra columns are ignored.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract_batches(weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
