"""License scans: an Aho-Corasick automaton finds the places of identifier tags and notice phrases; the licence
expression behind a tag's place is read by a shunting-yard parser and evaluated to labels and a score.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, text_buffers

#: Phrases whose places count, and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases: label and weight of the evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "all rights reserved": ("proprietary", 0.4),
    "public domain": ("public-domain", 0.5),
    "the unlicense": ("unlicense", 0.8),
}
TAGS = ("license identifier",)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_FOLD = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)}
_WORD = re.compile("[^ ]+")
_END = re.compile(r"[\r\n*/#;,]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+_-]+")
_FAMILY = re.compile(r"(?i)^(agpl|lgpl|gpl|apache|mit|bsd|mpl|epl|isc|unlicense|cc-by(?:-nc)?(?:-sa|-nd)?|cc0)")


def parse(expression: str) -> list[str]:
    """Postfix order of an expression of identifiers, and/or/with and brackets; [] if malformed."""
    out, ops, operand = [], [], False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if not operand:
                return []
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append(token)
        elif token == ")":
            if not operand:
                return []
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return []
            ops.pop()
        elif operand:
            break  # prose goes on behind the expression
        else:
            out.append(token)
            operand = True
    while ops:
        op = ops.pop()
        if op == "(":
            return []
        out.append(op)
    return out if operand else []


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named, and how far the expression settles the licence: the mean of both sides of an operator, 1 for a known licence."""
    stack: list[tuple[set[str], float]] = []
    for x in postfix:
        if x not in PRECEDENCE:
            m = _FAMILY.match(x)
            stack.append(({m[1].lower()} if m else {"other"}, 1.0 if m else 0.6))
            continue
        (b, q), (a, p) = stack.pop(), stack.pop()
        stack.append((a, p) if x == "with" else (a | b, min(p, q) if x == "and" else (p + q) / 2))
    return stack[0] if stack else (set(), 0.0)


@lru_cache(1)
def automaton():
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def _behind(text: str, at: int) -> str:
    """The expression behind a colon at `at`, as far as its line or comment goes."""
    while at < len(text) and text[at] == " ":
        at += 1
    if text[at : at + 1] != ":":
        return ""
    end = _END.search(text, at + 1)
    return text[at + 1 : end.start() if end else len(text)]


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    folded = text.translate(_FOLD)
    words = [w for w in folded.split(" ") if w]
    plain = f" {' '.join(words)} "
    places, base, labels, score, tags = [], set(), set(), 0.0, []
    for end, phrase in automaton().iter(plain):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            score = max(score, 0.9)
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            score = max(score, weight)
        if phrase in TAGS:
            tags.append(end)
    if tags:
        ends = [m.end() for m in _WORD.finditer(folded)]  # folding keeps places
        seen = before = 0
        for end in tags:
            seen, before = seen + plain.count(" ", before, end), end
            found, sure = evaluate(parse(_behind(text, ends[seen - 1])))
            labels |= found
            score = max(score, sure)
    first = last = None
    if places:
        first = plain.count(" ", 0, min(places) + 1) - 1
        last = plain.count(" ", 0, max(places) + 1) - 1
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _run(batches):
    for batch in batches:
        offsets, _ = text_buffers(batch.column(1))
        texts = pc.fill_null(batch.column(1), "")
        for i, j in slices(offsets):
            found = list(zip(*map(scan, texts.slice(i, j - i).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(found, _TYPES))], names=["doc_id", *_NAMES])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`, repeated ones too; no rows: no rows. Null counts as empty; no words: no places, no
    labels, score 0. Texts are read whole, some MB of them at a time. No shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
