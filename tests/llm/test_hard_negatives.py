"""Hard negatives by a vertical scan against all pairs in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label long, key string, score string, x string"


def brute(rows, step=10, positives=5, negatives=5, low=80):
    rows = {(i, tuple(math.floor(256 * a) for a in v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(a is not None and math.isfinite(a) for a in v)}
    out = []
    for i, q, lab in rows:
        if i % step:
            continue
        dot = lambda v: sum(a * b for a, b in zip(q, v))
        rest = [(-dot(v), j, k) for j, v, k in rows if len(v) == len(q)]
        near = sorted((s, j) for s, j, k in rest if k == lab and j != i)[:positives]
        for s, j in near:
            hit = sorted((t, m) for t, m, k in rest if k != lab and low * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m) in enumerate(hit)]
    return sorted(out)


def run(spark, rows, **more):
    v = spark.createDataFrame([(i, v, lab, "a", "b", "c") for i, v, lab in rows], SCHEMA).repartition(3)
    out = h.hard_negatives(v, "vec_id % 10 = 0", **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(n, dim, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    lab = rng.integers(0, labels, n)
    x = rng.normal(size=(n, dim)) + 0.7 * centres[rng.integers(0, labels, n)]
    return [(i, (x[i] / np.linalg.norm(x[i])).tolist(), int(lab[i])) for i in range(n)]


def test_all_pairs(spark, monkeypatch):
    rows = vectors(700, 19, 3, 1)
    assert len(want := brute(rows)) > 100
    assert run(spark, rows) == want
    monkeypatch.setattr(h, "ANCHORS", 7)
    assert run(spark, rows) == want
    assert run(spark, rows, positives=2, negatives=9, low=50) == brute(rows, positives=2, negatives=9, low=50)


def test_small_blocks_prune_the_same(spark, monkeypatch):
    rows = vectors(300, 24, 2, 2)
    blocks = h.quantised(spark.createDataFrame([(i, v, lab, "", "", "") for i, v, lab in rows], SCHEMA)).collect()
    ids, labels, x = (np.array([r[k] for r in blocks], np.int64) for k in ("vec_id", "label", "x"))
    q, order, left = x[0], [], []
    best = [h.Best(5)]
    for at in range(0, len(ids), 50):
        b = h.Block(24, ids[at : at + 50].tobytes(), labels[at : at + 50].tobytes(), np.ascontiguousarray(x[at : at + 50].T).tobytes())
        scan = b.scan
        b.scan = lambda q, alive, keep, scan=scan: (left.append((len(alive), len((r := scan(q, alive, keep))[0]))), r)[1]
        h._same_label(b, {"q": q, "label": int(labels[0]), "vec_id": int(ids[0])}, best, 5)
    same = np.flatnonzero((labels == labels[0]) & (ids != ids[0]))
    first = sorted((-int(x[m] @ q), int(ids[m])) for m in same)[:5]
    assert [(-s, i) for s, i in zip(best[0].scores.tolist(), best[0].ids.tolist())] == first
    assert sum(b for _, b in left) < sum(a for a, _ in left) / 2  # the bitmap shrinks before all dimensions are read


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(120)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(200, 260)]  # ties
    rows += rows[:30]  # rows that repeat
    rows += [(10, [0.5] * 4, 1), (10, [0.25] * 4, 2), (11, [0.5] * 4, 0)]  # ids that repeat
    rows += [(None, [1.0] * 4, 1), (500, None, 1), (510, [1.0] * 4, None), (520, [], 1), (530, [None, 1.0, 1.0, 1.0], 1), (540, [float("nan")] * 4, 1), (550, [float("inf")] * 4, 1)]
    rows += [(560, [0.0] * 4, 1), (570, [1.0] * 3, 1), (571, [0.9] * 3, 1), (572, [0.8] * 3, 2), (-10, [1.0, 0.0, 1.0, 1.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert run(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []  # no positive


def test_large_components(spark):
    """Scores past 2^53 are exact; components whose scores could pass 64 bits are left out."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0.5, 1) * 2**21 for _ in range(3)], i % 2) for i in range(60)]
    assert any(r[4] > 1 << 56 for r in brute(rows))
    assert run(spark, rows) == brute(rows)
    assert run(spark, [*rows, (70, [1e300, 1.0, 1.0], 1), (71, [-(2.0**40)] * 3, 0)]) == brute(rows)


def test_label_change(spark):
    rows = vectors(150, 6, 4, 5)
    changed = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert run(spark, rows, label=label) == brute(changed)


@pytest.mark.parametrize("seed", range(3))
def test_negative_scores(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (-rng.random(5) if i % 10 else rng.random(5)).tolist(), i % 2) for i in range(80)]
    assert run(spark, rows) == brute(rows)
