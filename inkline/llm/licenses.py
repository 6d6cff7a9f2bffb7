"""License notices and identifier tags in documents: Aho-Corasick over words, and a shunting-yard reader of licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import WORD, as_bytes, few, split_words

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and the labels they add.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: How far a licence binds those who reuse the text, from 0 (free) to 1 (reserved); other known families by prefix.
BINDING = {"cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.2, "cc-by": 0.3, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "gfdl": 0.6, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "reserved": 1.0}
UNKNOWN = 0.9
EXPRESSION = re.compile(rb"[\n()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}
JOIN = {"or": min, "and": max, "with": lambda licence, exception: 0.8 * licence}


@lru_cache(maxsize=4096)
def binding(label: str) -> float:
    """Of the longest known family that the label begins with."""
    known = [k for k in BINDING if label == k or re.match(rf"{re.escape(k)}[-.\d+]", label)]
    return BINDING[max(known, key=len)] if known else UNKNOWN


def read_expression(text: bytes, start: int = 0, stop: int | None = None) -> tuple[list[str], float | None]:
    """Licences named by the longest well-formed expression from ``start`` on, within its line and before ``stop``, and how far it binds.

    Shunting-yard: ``or`` takes the freer side, ``and`` the stricter one, ``with`` grants an exception
    that eases its licence by a fifth; parentheses group. The line is read once, up to its end or the first
    token that nothing can follow; each place where the expression may end is remembered with its value.
    No expression: no licences and None.
    """
    values: list[float] = []
    operators: list[str] = []
    names: list[str] = []
    operand, excepts, depth = True, False, 0  # what must come next; whether it is an exception's name; open parentheses
    found: tuple[int, float | None] = 0, None

    def apply() -> None:
        right, left = values.pop(), values.pop()
        values.append(JOIN[operators.pop()](left, right))

    for match in EXPRESSION.finditer(text, start, len(text) if stop is None else stop):
        token = match.group().decode().lower()
        opens = token not in RANK and token not in (")", "\n")  # begins an operand
        if token == "\n" or token[-1] == ":" or operand != opens or token == "(" and excepts or token == ")" and not depth:
            break
        if token == "(":
            operators.append(token)
            depth += 1
            continue
        if token == ")":
            while operators[-1] != "(":
                apply()
            operators.pop()
            depth -= 1
        elif token in RANK:
            while operators and RANK.get(operators[-1], 0) >= RANK[token]:
                apply()
            operators.append(token)
            operand, excepts = True, token == "with"
            continue
        else:
            values.append(0.0 if excepts else binding(token))
            if not excepts:
                names.append(token)
            operand, excepts = False, False
        if not depth:  # the operators that wait are of rising rank: three at most
            value = values[-1]
            for op, left in zip(reversed(operators), reversed(values[:-1][-3:]), strict=False):
                value = JOIN[op](left, value)
            found = len(names), value
    return names[: found[0]], found[1]


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None) -> dict:
    """All that is found in one text."""
    words = split_words(text)
    line = f" {b' '.join(words).decode(errors='replace')} "
    places: list[tuple[int, str]] = []
    base: list[int] = []
    labels: set[str] = set()
    base_labels: set[str] = set()
    score, tags, at, word = 0.0, [], 0, 0
    for end, phrase in automaton().iter(line):  # ends never fall
        word += line.count(" ", at, end)
        at = end
        start = word - 1 - phrase.count(" ")
        places.append((start, phrase))
        if phrase in BASE:
            base.append(start)
            base_labels.add(BASE[phrase])
        if phrase == TAG:
            tags.append(start + 2)
        else:
            labels.add(label := BASE.get(phrase) or NOTICES[phrase])
            score = max(score, binding(label))
    if tags:
        spots = [m.span() for m in WORD.finditer(text)]
        # an expression ends where the next tag begins, so that each byte is read once
        stops = [spots[tag - 2][0] for tag in tags[1:]]
        for tag, stop in zip(tags, [*stops, len(text)], strict=True):
            names, value = read_expression(text, spots[tag][1], stop)
            labels.update(names)
            score = max(score, value or 0.0)
    return {"n_words": len(words), "places": [{"word": w, "phrase": p} for w, p in places], "base": base, "base_labels": sorted(base_labels), "labels": sorted(labels), "score": score}


KIND = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))), ("base", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and what a whole text says of its licence, a row for every row.

    ``n_words``; ``places`` (word number and phrase, as they end); ``base`` (starts of the counted phrases);
    ``base_labels``, ``labels`` (sorted); ``score``: how far the strictest notice binds, 0 without any.
    Null and empty texts have no words and no labels. An expression ends with its line, or where the next
    tag begins; lines of any length and with any number of tags are read in time in proportion to them. Rows stay where they are: nothing is joined or
    shuffled, repeated rows stay, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = pa.array([scan(t) for t in as_bytes(batch.column(1))], type=KIND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], names=[id_col, *(f.name for f in KIND)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, places array<struct<word:long,phrase:string>>, base array<long>, base_labels array<string>, labels array<string>, score double")
