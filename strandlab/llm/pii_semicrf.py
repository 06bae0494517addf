"""Personal data in documents: exact patterns, plus spans found by a semi-Markov conditional random field.

The field scores whole candidate spans: what a span is made of, how long it is, what stands around it. Dynamic programming over
the tokens of a region, with a bounded number of tokens per entity, picks boundaries and kinds together. Words that hold neither a digit nor an
at sign cannot begin or end an entity, so a text falls apart into regions that are solved alone without loss.
"""

from __future__ import annotations

import bisect
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MOST_TOKENS = 16
SAMPLE_DOCUMENTS = 600
SAMPLE_CHARS = 1 << 16
MADE_UP = 2500
STEPS = 120
PENALTY = 1e-4
LEFT_CONTEXT = 24

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit only: later starts in the same run end alike
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
BREAK = re.compile(r"[\x20\x09-\x0D]")
KEY = re.compile(r"(?:token|passw(?:or)?d|pwd|secret|api[_ -]?key|access[_ -]?key|key|bearer)[\"']?\s*[:=]?\s*[\"']?\Z", re.I)
SEED_SECRET = re.compile(r"(?:token\s*=\s*\"|password=|secret\s*[:=]\s*|key\s*[:=]\s*)([A-Za-z0-9]{12,64})|\b(AKIA[A-Z0-9]{16})\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, at sign and dotted domain; every at sign is looked at once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, kind after kind, each from left to right."""
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of words with a digit or an at sign; at most one other word stands between two words of a run."""
    out: list[tuple[int, int]] = []
    m = SIGN.search(text)
    while m:
        start = m.start()
        while start and not BREAK.match(text, start - 1):
            start -= 1
        stop = BREAK.search(text, m.end())
        end = stop.start() if stop else len(text)
        if out and len(text[out[-1][1] : start].split()) <= 1 and start - out[-1][1] < 40:
            start = out.pop()[0]
        out.append((start, end))
        m = SIGN.search(text, end)
    return out


class Tokens:
    """Tokens of many regions, one after the other. Letters and digits group together, any other character stands alone."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        """``pieces``: text, start and end of a region."""
        parts, self.region_first, char_first, self.shift = [], [0], 0, []
        lefts, begins = [], []
        for text, start, end in pieces:
            left = max(0, start - LEFT_CONTEXT)
            part = text[left:end] + "\n"
            parts.append(part)
            lefts.append(char_first)
            begins.append(char_first + start - left)
            self.shift.append(left - char_first)
            char_first += len(part)
        self.text = "".join(parts)
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.full(len(code), 9, np.int8)  # 9: any other sign
        kind[(code == 32) | ((code >= 9) & (code <= 13))] = 0
        kind[(code >= 48) & (code <= 57)] = 1
        kind[(code >= 97) & (code <= 122)] = 2
        kind[(code >= 65) & (code <= 90)] = 3
        kind[code >= 128] = 4
        for k, c in enumerate("@.-+"):
            kind[code == ord(c)] = 5 + k
        self.code, self.kind = code, kind
        self.digits, self.ats = (np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (1, 5))
        word = (kind >= 1) & (kind <= 4)
        new = np.ones(len(code), bool)
        new[1:] = ~(word[1:] & word[:-1])
        marks = np.zeros(len(code), bool)
        marks[lefts] = marks[begins] = True
        starts = np.flatnonzero(new | marks)
        ends = np.append(starts[1:], len(code))
        owner = np.searchsorted(np.array(lefts), starts, "right") - 1
        # the context on the left and the line end after a region are seen, but not labelled
        inside = (starts >= np.array(begins)[owner]) & (code[starts] != 10 if len(starts) else starts >= 0)
        self.start, self.end, self.region = starts[inside], ends[inside], owner[inside]
        self.first = np.searchsorted(self.region, np.arange(len(pieces) + 1))

    def segments(self, most: int = MOST_TOKENS, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of the candidates: they begin with a letter, digit, plus or opening bracket, end with a letter or digit,
        and hold an at sign or at least four digits. ``among``: the tokens, in order, they may begin with (all, if None)."""
        n = len(self.start)
        lead = np.arange(n) if among is None else among
        if not len(lead):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, sign = self.kind[self.start[lead]], self.code[self.start[lead]]
        lead = lead[((first >= 1) & (first <= 3)) | (first == 8) | (sign == ord("("))]
        a, b = [lead[:0]], [lead[:0]]
        for size in range(1, min(most, n) + 1):
            i = lead[lead + size <= n]
            j = i + size - 1
            s, e = self.start[i], self.end[j]
            tail = self.kind[e - 1]
            good = (tail >= 1) & (tail <= 3) & (self.region[i] == self.region[j]) & (e - s <= 128)
            good &= (self.digits[e] - self.digits[s] >= 4) | (self.ats[e] > self.ats[s])
            a.append(i[good])
            b.append(j[good])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        return a[order], b[order]


def span_features(tokens: Tokens, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Features of whole spans: make-up, length, shape, checks and surroundings."""
    s, e = tokens.start[a], tokens.end[b]
    # only the characters around the spans are looked at
    low, high = (max(0, int(s.min()) - LEFT_CONTEXT), int(e.max()) + 1) if len(a) else (0, 0)
    s, e = s - low, e - low
    kind, code = tokens.kind[low:high], tokens.code[low:high]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[e] - total[s]

    digit, lower, upper, other, at, dot, dash, plus = (count(kind == k) for k in range(1, 9))
    space = count(kind == 0)
    bracket = count((code == 40) | (code == 41))
    odd = count(kind == 9) - bracket
    hexes = count(((code >= 97) & (code <= 102)) | ((code >= 65) & (code <= 70)))
    letters = lower + upper
    size, parts = e - s, b - a + 1
    padded = np.concatenate([[0], kind, [0, 0]])
    before, after = padded[s], padded[e + 1]
    code_before = np.concatenate([[10], code])[s]
    code_after = np.concatenate([code, [10]])[np.minimum(e, len(code))]
    key, valid_card, valid_ip, group3, dotted = np.zeros((5, len(a)))
    text = tokens.text[low:high]
    for k in np.flatnonzero((digit >= 13) & (digit <= 19) & (letters + at + plus + odd + dot + bracket + other == 0)):
        valid_card[k] = luhn(_digits(text[s[k] : e[k]]))
    for k in np.flatnonzero((dot == 3) & (digit + dot == size)):
        valid_ip[k] = all(p and len(p) <= 3 and int(p) <= 255 for p in text[s[k] : e[k]].split("."))
    for k in np.flatnonzero((letters == 0) & (digit >= 7) & (digit <= 15) & (at + odd + other == 0)):
        group3[k] = [len(x) for x in re.findall("[0-9]+", text[s[k] : e[k]])][-2:] == [3, 4]
    for k in np.flatnonzero(at == 1):
        local, _, domain = text[s[k] : e[k]].partition("@")
        dotted[k] = bool(local) and bool(DOMAIN.fullmatch(domain)) and all(c in LOCAL for c in local)
    for k in np.flatnonzero((letters + digit == size) & (size >= 8)):
        key[k] = bool(KEY.search(text[max(0, s[k] - LEFT_CONTEXT) : s[k]]))
    first_plus = kind[s] == 8
    cols = [
        np.ones(len(a)), at == 0, at == 1, at > 1, dotted, valid_ip, valid_card, group3, key,
        letters == 0, digit == 0, digit < 7, (digit >= 7) & (digit <= 8), (digit >= 9) & (digit <= 12), (digit >= 13) & (digit <= 16), digit > 16,
        dot == 0, dot == 1, dot == 2, dot == 3, dot > 3, dash > 0, space > 0, space > 3, plus == 0, first_plus, (plus > 0) & ~first_plus, bracket == 2, bracket == 1, odd > 0, other > 0,
        (letters + digit == size) & (letters > 0), (hexes + digit == size) & (letters > 0), (upper + digit == size) & (upper > 0), (upper > 0) & (lower > 0),
        (size >= 12) & (letters + digit == size) & (letters > 0) & (digit > 0), size < 5, (size >= 5) & (size < 10), (size >= 10) & (size < 16), (size >= 16) & (size < 24), size >= 24,
        before == 0, (before >= 1) & (before <= 4), before == 6, before == 7, before == 8, code_before == ord("="), np.isin(code_before, [34, 39]), code_before == ord("("), before == 9,
        after == 0, (after >= 1) & (after <= 4), after == 5, after == 6, after == 7, np.isin(code_after, [34, 39]), after == 9, parts == 1, parts > 8,
    ]
    return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)


N_FEATURES = 59


def _alike(sizes: np.ndarray, cells: int):
    """Numbers of regions of similar size, at most ``cells`` tokens together or one region."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] * (hi + 1 - lo) <= cells:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _grids(tokens: Tokens, a: np.ndarray, b: np.ndarray, cells: int = 1 << 15):
    """Regions of similar size together: region numbers, and (region, token, size) places of candidates with their numbers."""
    sizes = np.diff(tokens.first)
    seg_first = np.searchsorted(tokens.region[a], np.arange(len(sizes) + 1))
    for rows in _alike(sizes, cells):
        where = np.concatenate([np.arange(seg_first[r], seg_first[r + 1]) for r in rows])
        place = np.repeat(np.arange(len(rows)), seg_first[rows + 1] - seg_first[rows])
        yield rows, sizes[rows], place, a[where] - tokens.first[rows][place], b[where] - a[where], where


NEVER = -1e9


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(weights: np.ndarray, tokens: Tokens, a, b, x, gold: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood per region and its gradient. ``gold``: kind of each candidate, or -1."""
    score = x @ weights.T
    loss, moved = 0.0, np.zeros_like(score)
    n = max(len(tokens.first) - 1, 1)
    for rows, sizes, place, at, size, where in _grids(tokens, a, b):
        steps = int(sizes.max())
        grid = np.full((len(rows), steps, MOST_TOKENS), NEVER)
        grid[place, at, size] = _lse(score[where], 1)
        alpha = np.full((len(rows), steps + 1), NEVER)
        alpha[:, 0] = 0.0
        for t in range(1, steps + 1):
            k = min(t, MOST_TOKENS)
            back = np.arange(k)
            ways = alpha[:, t - 1 - back] + grid[:, t - 1 - back, back]
            alpha[:, t] = _lse(np.concatenate([alpha[:, t - 1 : t], ways], axis=1), 1)
        beta = np.full((len(rows), steps + 1), NEVER)
        for t in range(steps, -1, -1):
            here = np.where(sizes == t, 0.0, NEVER)
            if t < steps:
                k = min(steps - t, MOST_TOKENS)
                ways = beta[:, t + 1 : t + 1 + k] + grid[:, t, :k]
                here = _lse(np.concatenate([here[:, None], beta[:, t + 1 : t + 2], ways], axis=1), 1)
            beta[:, t] = here
        z = alpha[np.arange(len(rows)), sizes]
        p = np.exp(alpha[place, at][:, None] + score[where] + beta[place, at + size + 1][:, None] - z[place][:, None])
        loss += z.sum()
        moved[where] += p
    true = np.flatnonzero(gold >= 0)
    loss -= score[true, gold[true]].sum()
    moved[true, gold[true]] -= 1.0
    return loss / n + PENALTY / 2 * (weights**2).sum(), moved.T @ x / n + PENALTY * weights


def best_spans(weights: np.ndarray, tokens: Tokens, cells: int = 1 << 13) -> list[list[Span]]:
    """Best segmentation of each region, as spans of its text.

    Regions of similar size are walked side by side, a few tokens at a time: candidates and their features are held for the ``cells``
    tokens at hand only, the scores of the last ``MOST_TOKENS`` ones are carried on, and what stays is one size and kind per token.
    """
    out: list[list[Span]] = [[] for _ in range(len(tokens.first) - 1)]
    carry = MOST_TOKENS - 1
    for rows in _alike(np.diff(tokens.first), cells):
        sizes, first = tokens.first[rows + 1] - tokens.first[rows], tokens.first[rows]
        steps, stride = int(sizes.max()), max(1, cells // len(rows))
        grid = np.full((len(rows), carry + stride, MOST_TOKENS), NEVER)  # scores by first token, the carried ones before the new
        sort = np.zeros(grid.shape, np.int8)
        best = np.zeros((len(rows), carry + stride + 1))
        taken, kinds = np.zeros((2, len(rows), steps + 1), np.int8)
        for low in range(0, steps, stride):
            n = min(stride, steps - low)
            if low:
                for x, end in ((grid, carry + stride), (sort, carry + stride), (best, carry + stride + 1)):
                    x[:, : x.shape[1] - stride] = x[:, stride:end].copy()
                grid[:, carry:] = NEVER
            place = np.repeat(np.arange(len(rows)), np.clip(sizes - low, 0, n))
            at = np.arange(len(place)) - np.searchsorted(place, place)
            begin = first[place] + low + at
            order = np.argsort(begin)
            a, b = tokens.segments(among=begin[order])
            if len(a):
                score = span_features(tokens, a, b) @ weights.T
                kind = score.argmax(1)
                k = order[np.searchsorted(begin[order], a)]
                grid[place[k], carry + at[k], b - a] = score[np.arange(len(a)), kind]
                sort[place[k], carry + at[k], b - a] = kind
            for t in range(1, n + 1):
                back = np.arange(min(low + t, MOST_TOKENS))
                since = carry + t - 1 - back
                ways = np.concatenate([best[:, carry + t - 1 : carry + t], best[:, since] + grid[:, since, back]], axis=1)
                size = ways.argmax(1)
                best[:, carry + t] = ways.max(1)
                taken[:, low + t] = size
                kinds[:, low + t] = sort[np.arange(len(rows)), carry + t - np.maximum(size, 1), np.maximum(size, 1) - 1]
        for r, region in enumerate(rows):
            t, found = int(sizes[r]), []
            while t > 0:
                k = int(taken[r, t])
                if k:
                    s, e = tokens.start[first[r] + t - k], tokens.end[first[r] + t - 1]
                    found.append((KINDS[kinds[r, t]], int(s) + tokens.shift[region], int(e) + tokens.shift[region]))
                t -= max(k, 1)
            out[region] = found[::-1]
    return out


def made_up(rng: random.Random, words: list[str]) -> tuple[str, list[Span]]:
    """A made-up line with personal data and with numbers that are none, and its spans."""
    text, spans = "", []

    def add(piece: str, kind: str | None = None) -> None:
        nonlocal text
        if kind:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        while True:
            d = digits(rng.choice([13, 15, 16, 16, 16, 16, 19]))
            if luhn(d):
                break
        joint = rng.choice(["", "", " ", "-"])
        return joint.join(d[k : k + 4] for k in range(0, len(d), 4)) if joint else d

    def entity() -> None:
        kind = rng.choice(KINDS)
        if kind == "email":
            name = rng.choice([".", "_", "", "-"]).join([rng.choice(words), *([digits(2)] if rng.random() < 0.5 else [])])
            add(f"{re.sub('[^a-z0-9._-]', 'x', name.lower()) or 'x'}@{rng.choice(['mail', 'mail2', 'host', 'a-b'])}.{rng.choice(['example.com', 'example.org', 'net', 'co.uk'])}", kind)
        elif kind == "ip":
            add(".".join(str(rng.randint(0, 255)) for _ in range(4)), kind)
        elif kind == "card":
            add(card(), kind)
        elif kind == "phone":
            form = rng.random()
            if form < 0.5:
                add(f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", kind)
            elif form < 0.7:
                add(f"+{rng.randint(1, 99)}{rng.choice(['-', ' ', '.'])}{digits(3)}{rng.choice(['-', ' ', '.'])}{digits(3)}{rng.choice(['-', '.'])}{digits(4)}", kind)
            elif form < 0.85:
                add(f"({digits(3)}) {digits(3)}-{digits(4)}", kind)
            else:
                add(f"{digits(3)}-{digits(3)}-{digits(4)}", kind)
        else:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40])))
            form = rng.random()
            if form < 0.4:
                add('token = "')
                add(value, kind)
                add('"')
            elif form < 0.7:
                add(rng.choice(["password=", "secret=", "api_key: ", "key="]))
                add(value, kind)
            else:
                add("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), kind)

    def plain() -> None:
        d = rng.choice
        add(d([
            f"{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
            f"{digits(3)}.{digits(2)}", f"{digits(2)}%", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(6)}", f"{digits(4)}-{digits(4)}", f"{digits(8)}", f"{digits(9)}", f"{digits(12)}", f"{digits(21)}",
            f"{d(words)}{digits(2)}", f"@{d(words)}", f"{d(words)}@{d(words)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{rng.randint(256, 999)}.{digits(2)}.{digits(2)}.{digits(2)}",
            f"{digits(4)} {digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"#{digits(5)}", f"1.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
            f"{digits(5)} {digits(5)} {digits(5)}", f"{digits(3)} {digits(3)}",
        ]))

    for k in range(rng.randint(1, 5)):
        add(" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4]))))
        add(" " if text else "")
        entity() if rng.random() < 0.6 else plain()
        add(rng.choice([" ", " ", " ", ", ", ". ", "; ", "\n"]))
    return text, spans


def taught(text: str) -> list[Span]:
    """Spans of a given document that the field learns from: the base patterns and plain assignments of secrets."""
    secrets = [("secret", m.start(m.lastindex), m.end(m.lastindex)) for m in SEED_SECRET.finditer(text)]
    found = sorted(base_spans(text) + secrets, key=lambda s: (s[1], -s[2]))
    out, last = [], -1
    for s in found:
        if s[1] >= last:
            out.append(s)
            last = s[2]
    return out


def train(texts: list[str], lines: int = MADE_UP, steps: int = STEPS, rate: float = 0.15, seed: int = 11) -> np.ndarray:
    """Weights (kinds, features) from made-up lines and from regions of the given texts."""
    rng = random.Random(seed)
    words = sorted({w for t in texts for w in re.findall(r"[^\W\d_]+", t[:2000])})[:5000] or ["word", "line", "text"]
    samples = [made_up(rng, words) for _ in range(lines)] + [(t, taught(t)) for t in texts]
    pieces, wanted = [], []
    for text, spans in samples:
        for s, e in regions(text):
            if e - s <= 400:
                pieces.append((text, s, e))
                wanted.append({(x, y): KINDS.index(k) for k, x, y in spans if s <= x and y <= e})
    tokens = Tokens(pieces)
    a, b = tokens.segments()
    x = span_features(tokens, a, b)
    region = tokens.region[a]
    shift = np.array(tokens.shift)[region] if len(a) else np.zeros(0, np.int64)
    begin, end = tokens.start[a] + shift, tokens.end[b] + shift
    gold = np.array([wanted[r].get((s, e), -1) for r, s, e in zip(region.tolist(), begin.tolist(), end.tolist())], np.int64)
    weights = np.zeros((len(KINDS), N_FEATURES))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(weights, tokens, a, b, x, gold)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return weights


def find_spans(texts: list[str], weights: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text. An added span overlaps no base span."""
    base, pieces, owner = [], [], []
    for k, text in enumerate(texts):
        if not SIGN.search(text):
            base.append([])
            continue
        base.append(base_spans(text))
        for s, e in regions(text):
            pieces.append((text, s, e))
            owner.append(k)
    more: list[list[Span]] = [[] for _ in texts]
    for lo in range(0, len(pieces), 512):
        tokens = Tokens(pieces[lo : lo + 512])
        for k, spans in zip(owner[lo : lo + 512], best_spans(weights, tokens)):
            more[k] += spans
    out = []
    for found, extra in zip(base, more):
        starts, ends = joined_ranges(found)
        # the last range that starts before the span's end must end at or before its start
        free = [x for x in extra if not (k := bisect.bisect_left(starts, x[2])) or ends[k - 1] <= x[1]]
        out.append((found, free))
    return out


def joined_ranges(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, overlapping ones as one, in order."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def ordered(spans: list[Span]) -> list[Span]:
    """Spans by kind as listed, then by start."""
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Text with every span, overlapping ones as one, replaced by the kind of its first span."""
    out, place, group = [], 0, None
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if group and s < group[2]:
            group = (group[0], group[1], max(group[2], e))
            continue
        if group:
            out += [text[place : group[1]], f"[{group[0].upper()}]"]
            place = group[2]
        group = (kind, s, e)
    if group:
        out += [text[place : group[1]], f"[{group[0].upper()}]"]
        place = group[2]
    return "".join([*out, text[place:]])


def _span_batches(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            ids, counts, base, spans = batch.column(0), {k: [] for k in BASE_KINDS}, [], []
            for found, extra in find_spans([t or "" for t in batch.column(1).to_pylist()], weights):
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in found))
                base.append(joined(found))
                spans.append(joined(found + extra))
            columns = [ids, *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"])

    return run


def train_on(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS
) -> np.ndarray:
    """Weights fitted on made-up lines and on at most ``sample_documents`` rows with a digit or an at sign and at most
    ``sample_chars`` characters: those with the smallest hash of their id."""
    some = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    some = some.where(F.octet_length("text") <= sample_chars).where(F.col("text").rlike("[0-9@]"))
    ids = some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    rows = some.join(F.broadcast(ids), "doc_id", "left_semi").limit(2 * sample_documents).collect()
    return train(sorted(r["text"] for r in rows))


def find_personal_data(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans`` for every row of ``docs``.

    Counts are those of the exact patterns. Spans are ``kind:start:end`` in code points, end exclusive, by kind and start, joined by
    commas. A null or empty text has none. Rows that repeat an id are read once each; null ids are allowed; extra columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return rows.mapInArrow(_span_batches(weights), f"doc_id long, {counts}, base_spans string, spans string")


def redact_documents(docs: DataFrame, weights: np.ndarray, text_column: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """Rows of ``docs`` with personal data replaced by its kind in brackets. Texts without personal data, null ones included,
    stay as they are; ``size_column``, if there is one, counts the characters of a changed text anew."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = names.index(text_column)
    size = names.index(size_column) if size_column in names else None
    kinds = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = find_spans([t or "" for t in texts], weights)
            clean = [redact(t, found + extra) if found or extra else t for t, (found, extra) in zip(texts, spans)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))
            if size is not None:
                old = batch.column(size).to_pylist()
                new = [len(c) if c != t else n for c, t, n in zip(clean, texts, old)]
                batch = batch.set_column(size, batch.schema.field(size), pa.array(new, batch.schema.field(size).type))
            yield batch

    return plain.mapInArrow(run, kinds).toDF(*names)
