"""Licence scan: Aho-Corasick over the words of a text, and licence expressions.

All notice phrases and the identifier tag are one automaton that reads each whole
text once.  An expression after an identifier tag (``MIT OR (GPL-2.0-only WITH
Classpath-exception-2.0)``) is brought into postfix order by the shunting-yard
method and evaluated: ``and`` takes the stricter side, ``or`` the freer one,
``with`` eases the licence it stands by.

The score is how far the strictest finding limits re-use: 0 where nothing is
found, 1 for all rights reserved.  Null and empty texts have no words and no
findings.  Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import text_blocks

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: More notices; a phrase may have several labels.
NOTICE_PHRASES = {
    "mit license": "mit",
    "mit licence": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache licence": "apache",
    "bsd license": "bsd",
    "bsd licence": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public licence": "gpl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}
TAG_PHRASES = ("spdx license identifier", "spdx licence identifier")

#: How far a label limits re-use.
LIMITS = {
    "public-domain": 0.05, "cc0": 0.05, "unlicense": 0.05, "isc": 0.1, "mit": 0.1, "bsd": 0.1, "zlib": 0.1,
    "apache": 0.15, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.45, "cc-by-sa": 0.5, "gpl": 0.6, "agpl": 0.7,
    "cc-by-nd": 0.75, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.85, "cc-by-nc-nd": 0.9, "proprietary": 0.95, "reserved": 1.0,
}
UNKNOWN_LIMIT = 0.5
WITH_EASES = 0.75

#: What is no word: ASCII other than digits and letters.  A-Z become a-z.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TAG = re.compile(r"spdx[^a-z0-9\n]+licen[sc]e[^a-z0-9\n]+identifier[ \t]*:?([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a licence identifier: ``Apache-2.0`` is ``apache``, ``GPL-3.0-or-later`` is ``gpl``."""
    name = re.sub(r"-?v?\d[\d.]*", "", identifier.lower()).rstrip("+")
    for end in ("-only", "-or-later", "-clause", "-license"):
        name = name.removesuffix(end)
    return name.strip("-") or identifier.lower()


def _names_licence(token: str) -> bool:
    """Whether a word behind an operator in small letters is meant as a licence."""
    return token == "" or token == "(" or any(c.isdigit() for c in token) or family(token) in LIMITS


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None if the expression is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    tokens = _TOKEN.findall(expression)
    for token, following in zip(tokens, [*tokens[1:], ""], strict=False):
        word = token.lower()
        if token == "(":
            # An exception is one name, no expression.
            if not operand_next or (waiting and waiting[-1] == "with"):
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif word in _RANK:
            if operand_next:
                return None
            if token == word and word != "with" and not _names_licence(following):
                break  # a sentence goes on after the expression
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            if not operand_next:
                break  # a comment after the expression
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels of all licences of an expression, and how far it limits re-use; None if malformed."""
    order = postfix(expression)
    if order is None:
        return None
    labels: set[str] = set()
    values: list[float] = []
    names: list[str] = []
    for token in order:
        if token not in _RANK:
            names.append(token)
            values.append(LIMITS.get(family(token), UNKNOWN_LIMIT))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            names.pop()  # the exception is no licence
            values.append(left * WITH_EASES)
        else:
            # The top name stays: only the names right before a `with` are taken back.
            values.append(max(left, right) if token == "and" else min(left, right))
    labels.update(family(name) for name in names)
    return labels, values[0]


def automaton():
    import ahocorasick

    found: dict[str, list[tuple[str, bool]]] = {}
    for phrases, base in ((BASE_PHRASES, True), (NOTICE_PHRASES, False), (dict.fromkeys(TAG_PHRASES, ""), False)):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((label, base))
    machine = ahocorasick.Automaton()
    for phrase, meanings in found.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, meanings))
    machine.make_automaton()
    return machine


def scan(text: str | None, machine) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one text."""
    words = (text or "").encode().translate(_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    line = f" {b' '.join(words).decode()} "
    base_labels: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    tagged = False
    for end, (length, meanings) in machine.iter(line):
        for label, base in meanings:
            if base:
                base_labels.add(label)
                starts.append(end - length)
            elif label:
                labels.add(label)
            else:
                tagged = True
    labels |= base_labels
    score = max((LIMITS[label] for label in labels), default=0.0)
    if tagged:
        for match in _TAG.finditer(text):
            read = evaluate(match.group(1))
            if read is None:
                labels.add("unparsed")
                score = max(score, UNKNOWN_LIMIT)
            else:
                labels |= read[0]
                score = max(score, read[1])
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    return len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the findings of :func:`scan` for every row."""
    rows = docs.select(*keep, docs[text].alias("_text"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in FOUND.split(", ")]
        for block in text_blocks(batches, "_text"):
            found = list(zip(*(scan(text, machine) for text in block.column("_text").to_pylist()), strict=True))
            columns = [pa.array(values, kind) for values, kind in zip(found, kinds, strict=True)]
            kept = [block.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *names])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(read, f"{kept}, {FOUND}")
