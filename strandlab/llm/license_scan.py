"""Licence notices and identifier tags in documents, found by one Aho-Corasick pass over the words of a text.

Phrases of words are matched on a text whose letters are lower case and whose words are joined by single spaces. Where the words of
an identifier tag stand, the expression behind the tag is read by a shunting-yard parser and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl-3.0",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0-1.0",
    "all rights reserved": "all-rights-reserved",
}
TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")

# how much a licence asks for: 0 notice only, 1 share changes of its files, 2 share the whole work, 3 unknown
PERMISSIVE, FILES, WHOLE, UNKNOWN = range(4)
OBLIGATIONS = (("mit", PERMISSIVE), ("apache", PERMISSIVE), ("bsd", PERMISSIVE), ("isc", PERMISSIVE), ("zlib", PERMISSIVE), ("cc0", PERMISSIVE),
               ("unlicense", PERMISSIVE), ("bsl", PERMISSIVE), ("lgpl", FILES), ("mpl", FILES), ("epl", FILES), ("agpl", WHOLE), ("gpl", WHOLE))
STRENGTH = {"and": 2, "or": 1, "with": 3}
TAG_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.99, 0.9, 0.7

# lower case of A-Z; every byte outside words becomes a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def obligation(identifier: str) -> int:
    name = identifier.lower()
    return next((level for start, level in OBLIGATIONS if name.startswith(start)), UNKNOWN)


def to_postfix(expression: str) -> list[str] | None:
    """Operands and operators (``and``, ``or``, ``with``) in postfix order, by shunting-yard; None if it is not well formed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    place, text = 0, expression.strip().rstrip("*/->#;,. \t")
    while place < len(text):
        m = TOKEN.match(text, place)
        if not m:
            return None
        place = m.end()
        word = m[1] or m[2]
        low = word.lower()
        if operand:
            if word == "(":
                stack.append(word)
            elif word == ")" or low in STRENGTH:
                return None
            else:
                out.append(word)
                operand = False
        elif low in STRENGTH:
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif word == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            return None
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[list[str], int]:
    """Licence names of an expression and what the whole asks for: ``or`` takes the lighter side, ``and`` the heavier one,
    ``with`` an exception lightens the licence before it by one step."""
    names: list[str] = []
    stack: list[tuple[int, str]] = []
    for word in postfix:
        if word not in STRENGTH:
            names.append(word.lower())
            stack.append((obligation(word), word.lower()))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if word == "with":
            if right in names:
                names.remove(right)
            stack.append((a if a == UNKNOWN else max(a - 1, PERMISSIVE), left))
        else:
            stack.append((min(a, b) if word == "or" else max(a, b), left))
    return names, stack[0][0]


def automaton(phrases: Mapping[str, tuple[str, str]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, *value))
    found.make_automaton()
    return found


def scan_text(text: str, machine) -> tuple[int, list[tuple[int, str, str]], list[tuple[str, list[str], int]]]:
    """Number of words, places (word number, kind, label) and expressions (text, names, obligation; -1 if not well formed)."""
    words = text.encode().translate(_FOLD).split()
    joined = f" {b' '.join(words).decode()} "
    places = []
    tagged = False
    seen = word = 0  # blanks are counted on from the last place; a longer phrase may begin before it
    for end, (size, kind, label) in machine.iter(joined):
        start = end - size
        word += joined.count(" ", seen, start) - joined.count(" ", start, seen)
        seen = start
        places.append((word, kind, label))
        tagged |= kind == "tag"
    expressions = []
    if tagged:
        for m in TAG.finditer(text):
            postfix = to_postfix(m[1])
            expressions.append((m[1].strip(), *(evaluate(postfix) if postfix else ([], -1))))
    return len(words), places, expressions


SCAN = (
    "n_words long, places array<struct<word:long,kind:string,label:string>>, "
    "expressions array<struct<expression:string,names:array<string>,obligation:int>>"
)


def _scan_batches(base: Mapping[str, str], notices: Mapping[str, str]):
    def run(batches):
        machine = automaton(
            {p: ("notice", x) for p, x in notices.items()} | {p: ("base", x) for p, x in base.items()} | {TAG_WORDS: ("tag", "")}
        )
        place = pa.list_(pa.struct([("word", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))
        expression = pa.list_(pa.struct([("expression", pa.string()), ("names", pa.list_(pa.string())), ("obligation", pa.int32())]))
        for batch in batches:
            counts, places, expressions = [], [], []
            for text in batch.column(batch.num_columns - 1):
                n, p, e = scan_text(text.as_py() or "", machine)
                counts.append(n)
                places.append([dict(zip(("word", "kind", "label"), x)) for x in p])
                expressions.append([dict(zip(("expression", "names", "obligation"), x)) for x in e])
            more = [pa.array(counts, pa.int64()), pa.array(places, place), pa.array(expressions, expression)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["doc_id", "n_words", "places", "expressions"])

    return run


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    base: Mapping[str, str] = BASE_PHRASES,
    notices: Mapping[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """``doc_id, n_words, places, expressions`` for every row of ``docs``.

    ``places``: word number, kind (``base``, ``notice`` or ``tag``) and label of every phrase, overlapping ones included, in
    text order. ``expressions``: what stands behind an identifier tag up to the end of its line, its licence names and
    how much it asks for (-1: not well formed). A null or empty text has no words and no places; rows that repeat an id
    are scanned once each; null ids are allowed and extra columns ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return docs.mapInArrow(_scan_batches(base, notices), f"doc_id long, {SCAN}")


def license_labels(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of scanned documents.

    ``labels`` are the base labels, those of notices and the names in well-formed expressions. The score is the chance
    that at least one sign is right: an expression counts 0.99, a base phrase 0.9, a notice 0.7; no sign gives 0.
    """
    base = F.filter("places", lambda p: p["kind"] == "base")
    notice = F.filter("places", lambda p: p["kind"] == "notice")
    names = F.filter("expressions", lambda e: e["obligation"] >= 0)
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda p: p["label"])))
    labels = F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform("_base", lambda p: p["label"]),
                F.transform("_notice", lambda p: p["label"]),
                F.flatten(F.transform("_names", lambda e: e["names"])),
            )
        )
    )
    doubt = (
        F.when(F.size("_names") > 0, F.lit(1 - TAG_WEIGHT)).otherwise(1.0)
        * F.when(F.size("_base") > 0, F.lit(1 - BASE_WEIGHT)).otherwise(1.0)
        * F.when(F.size("_notice") > 0, F.lit(1 - NOTICE_WEIGHT)).otherwise(1.0)
    )
    split = scanned.withColumns({"_base": base, "_notice": notice, "_names": names})
    word = F.transform("_base", lambda p: p["word"])
    return split.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1.0 - doubt).alias("score"),
    )
