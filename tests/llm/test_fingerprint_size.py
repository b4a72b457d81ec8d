"""Fingerprints are small, and their likeness follows that of the trees and of the texts."""

from __future__ import annotations

import difflib
import random
from collections import Counter

from meterlake.llm import fingerprints
from meterlake.llm.fingerprints import Fingerprint


def multiset_share(a: str, b: str) -> float:
    """Share of text in equal pieces, counted from whole trees."""
    counts = [Counter(piece for _, ps in Fingerprint.of(t).sections for _, found in ps for piece in found) for t in (a, b)]
    sizes = [sum(n * k for (_, n), k in c.items()) for c in counts]
    both = sum(n * k for (_, n), k in (counts[0] & counts[1]).items())
    return 2 * both / sum(sizes) if sum(sizes) else 0.0


def made(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


def edited(rng: random.Random, t: str) -> str:
    """Some stretches cut out, some put in."""
    for _ in range(rng.randrange(1, 6)):
        at, n = rng.randrange(len(t)), rng.randrange(len(t) // 8 + 2)
        t = t[:at] + (made(rng, n // 6) if rng.random() < 0.5 else "") + t[at + rng.choice([0, n]) :]
    return t


def test_likeness_of_choices_follows_trees_and_texts():
    rng = random.Random(21)
    whole, chosen, texts = [], [], []
    for n in [5, 20, 60, 120, 300, 800, 2500] * 6:
        a = made(rng, n)
        b = edited(rng, a)
        x, y = (Fingerprint.parse(str(Fingerprint.of(t))) for t in (a, b))
        got, want = x.likeness(y), multiset_share(a, b)
        assert got == y.likeness(x) == Fingerprint.of(a).likeness(Fingerprint.of(b))
        (whole if x.whole and y.whole else chosen).append(abs(got - want) if a != b else 0.0)
        if 300 <= n < 1000:
            texts.append(got - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
    assert len(whole) > 10 and max(whole) < 1e-9
    assert len(chosen) > 10 and sum(chosen) / len(chosen) < 0.04 and max(chosen) < 0.15
    assert abs(sum(texts) / len(texts)) < 0.08


def test_unlike_sizes_and_repeated_pieces():
    rng = random.Random(22)
    part, long = made(rng, 60), made(rng, 4000)
    for a, b in [(part, part + "\n" + long), (long, long * 2), ("x" * 90_000, "x" * 60_000), ("word " * 9000, "word " * 8000 + part), ("", long), ("\n" * 9, long)]:
        got = Fingerprint.of(a).likeness(Fingerprint.of(b))
        assert abs(got - multiset_share(a, b)) < 0.15
        assert got == Fingerprint.of(b).likeness(Fingerprint.of(a))


def test_fingerprints_are_small():
    rng = random.Random(23)
    for n in (0, 1, 30, 1000, 30_000):
        t = made(rng, n)
        s = str(Fingerprint.of(t))
        assert len(s) <= 33 + 6 * fingerprints.KEPT and (n < 1000 or 10 * len(s) < 1.5 * len(t))
        assert str(Fingerprint.parse(s)) == s
    t = made(rng, 30_000)
    assert 100 * len(str(Fingerprint.of(t))) < len(t) < 2 * len(Fingerprint.of(t).tree())


def test_trees_locate_edits(spark):
    lines = [f"line number {k} of the text." for k in range(60)]
    other = [*lines[:40], "changed", *lines[41:]]
    a, b = Fingerprint.of("\n".join(lines)), Fingerprint.of("\n".join(other))
    flat = [(i, j) for i, (_, ps) in enumerate(a.sections) for j in range(len(ps))]
    assert a.differing(b) == [flat[40]] and a.differing(a) == []
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    rows = {r.doc_id: r.tree for r in fingerprints.trees(docs).collect()}
    assert rows[1] == a.tree() and rows[2] == rows[3] == Fingerprint.of("").tree() and len(rows) == 4
    assert fingerprints.trees(docs.limit(0)).count() == 0


def test_trees_in_parts(monkeypatch):
    rng = random.Random(24)
    texts = [made(rng, n) for n in (0, 3, 200)] + ["x" * 500, "\n" * 9, "a\n\n" * 40]
    whole = [(Fingerprint.of(t).tree(), str(Fingerprint.of(t))) for t in texts]
    for part in (1, 5, 64):
        monkeypatch.setattr(fingerprints, "PART", part)
        assert [(Fingerprint.of(t).tree(), str(Fingerprint.of(t))) for t in texts] == whole


def test_held_nodes_are_a_level_of_the_tree():
    rng = random.Random(25)
    for n in (400, 1500, 6000):
        a = made(rng, n)
        f = Fingerprint.of(a)
        x, size, _ = fingerprints._pieces(a)
        level = list(zip(*(v.tolist() for v in fingerprints._level(x >> fingerprints.U64(1), size))))
        for q in range(1, f.level + 4):
            above, children = [], []
            for k, node in enumerate(level):
                children.append(node)
                if node[1] >= q or k == len(level) - 1:
                    sums = sum(int(fingerprints.mix(fingerprints.np.array([(i << 32) + (h << 6) + g], fingerprints.U64))[0]) for i, (h, g, _) in enumerate(children, 1))
                    top = int(fingerprints.mix(fingerprints.np.array([sums % 2**64], fingerprints.U64))[0]) >> 51
                    above.append((children[0][0] if len(children) == 1 else top, node[1], sum(m for *_, m in children)))
                    children = []
            level = above
            if q >= f.level:
                h, g, m = Fingerprint.parse(str(f)).nodes(q)
                assert [(int(x), int(y)) for x, y in zip(h, g)] == [x[:2] for x in level]
                assert q > f.level or len(h) <= fingerprints.NODES < 1.6 * len(h)
                assert sum(abs(x - y[2]) for x, y in zip(m, level)) < 0.1 * len(a)


def test_any_change_reaches_the_fingerprint():
    """Each piece lies below a held node, so no change goes unseen."""
    rng = random.Random(26)
    a = made(rng, 3000)
    f = Fingerprint.of(a)
    for _ in range(60):
        at = rng.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        got = Fingerprint.parse(str(Fingerprint.of(b))).likeness(f)
        assert 0.85 < got < 1.0
