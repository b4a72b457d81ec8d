"""Set-oriented phrase mining against counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from meterlake.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, word string, f string"


def brute(rows, longest=3, least=10, within=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in candidates.items():
        if inside[lang, w] and 100 * inside[lang, w] >= within * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if top is None or rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i % 7, t, lang, "s", 1, "a", "b", "c") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    out = c.collocations(docs, **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "city", "é", "中", "x-1", "don't", "\x00", "a b"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!?", ":", "\x0b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    out = [(rng.choice(["en", "en", "de", None, "und", ""]), text(rng.randrange(80))) for _ in range(120)]
    out += [("en", None), ("en", ""), (None, None), ("en", " \t\n.,"), ("fr", "new york city " * 30), ("fr", "new york new york new york " * 5), ("aa", "aa aa aa aa " * 6)]
    out += [("en", "one two three four. " * 20), ("en", "one two three four. " * 20), ("en", text(4000))]
    return out


def test_counting(spark, rows, monkeypatch):
    want = brute(rows)
    assert len(want) > 50 and {r[0] for r in want} > {"en", "und", ""}
    assert run(spark, rows) == want
    monkeypatch.setattr(c, "CHUNK", 700)
    monkeypatch.setattr(c, "PART", 16)
    assert run(spark, rows) == want


def test_a_full_bitmap_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(c, "BITS", 4)
    monkeypatch.setattr(c, "PAGE", 3)
    assert run(spark, rows) == brute(rows)


def test_other_parameters(spark, rows):
    some = rows[:60]
    assert run(spark, some, longest=4, least=3, within=90, top=None) == brute(some, 4, 3, 90, None)
    assert run(spark, some, longest=2, least=2, top=3) == brute(some, 2, 2, 50, 3)
    assert run(spark, some, least=10**6) == []
    assert run(spark, []) == run(spark, [("en", None)]) == []


def test_words_of():
    long = "w" * 5000
    text = f"A b,c\n\n{long} d\te. .f"
    for part in (1, 3, 64, 1 << 20):
        c.PART = part
        words, codes = c.words_of(text.encode())
        assert [words[k].as_py() if k >= 0 else None for k in codes] == ["a", "b", None, "c", None, long, "d", "e", None, "f"]


def test_relation_of_frequent_phrases():
    codes = np.array([0, 1, 2, 3, -1, 0, 1, 2, 3], np.int32)
    at, group, first = c.groups(codes, 2, 4)
    assert at.tolist() == [0, 1, 2, 5, 6, 7] and group.tolist() == [0, 1, 2, 0, 1, 2] and first.tolist() == [0, 1, 2]
    kept = c.restricted(codes, 2, at[group != 1])
    assert kept.tolist() == [0, 1, -1, 2, 3, -1, 0, 1, -1, 2, 3, -1]
    assert c.restricted(codes, 2, at).tolist() == [0, 1, 2, 3, -1, 0, 1, 2, 3, -1]
    assert c.groups(kept, 3, 4)[0].tolist() == []
