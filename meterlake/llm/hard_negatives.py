"""Hard negatives by a vertical scan of columnar vectors with branch and bound.

Vectors are packed into blocks that hold one array a dimension. An anchor reads the dimensions of a block in descending
magnitude of its own components; what the unread dimensions can still add lies between sums of their least and greatest
contributions in the block, and candidates whose bounds can't reach what is wanted leave the bitmap of the block. What is left when
all dimensions are read has exact scores. First each anchor finds its nearest rows of the same label, and every block
raises the bar for the next. Then each positive gives a window of scores, and all windows of an anchor are looked
for in one pass over the rows of other labels.

Blocks and anchors are dealt in a grid of ranges and parts whose sides grow with the square root of the rows, so each
anchor meets each block once, in a task that streams one block at a time. Scores are integers: float64 arithmetic
is used where it is exact, else 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows of a block, dimensions read between two looks at the bounds.
ROWS, STEP = 8192, 8
#: Anchors of a part at most.
ANCHORS = 32_768
BLOCK_SCHEMA = "block long, dim int, ids binary, labels binary, columns binary"
FOUND = "key long, slot int, vec_id long, score long"


def quantised(vectors: DataFrame, label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """Distinct (vec_id, label, x): x holds floor(scale * component).

    Rows that lack an id, a label or a vector, or whose vector is empty or holds null or non-finite components, are left out, and so are those whose
    inner products could pass 64 bits (components c with c * c * size >= 2^63).
    """
    v = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    v = v.where("vec_id is not null and label is not null and x is not null and size(x) > 0 and forall(x, a -> a is not null and not isnan(a) and abs(a) < double('infinity'))")
    v = v.where(F.forall("x", lambda a: F.abs(a * scale) < F.sqrt(F.lit(2.0**63) / F.size("x")) - 1))
    return v.withColumn("x", F.transform("x", lambda a: F.floor(a * scale))).distinct()


def _pack(batches):
    """Rows (vec_id, label, x) as blocks, of one length of vector each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    context = TaskContext.get()
    n = 0

    def block(dim: int) -> pa.RecordBatch:
        nonlocal n
        ids, labels, x = (np.concatenate(p) for p in zip(*held.pop(dim)))
        number = (context.partitionId() << 32 if context else 0) + n
        n += 1
        columns = [pa.array([number]), pa.array([dim], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, labels, np.ascontiguousarray(x.T))]]
        return pa.RecordBatch.from_arrays(columns, names=["block", "dim", "ids", "labels", "columns"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, labels = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = part.column(2)
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(width)
            for dim in np.unique(width).tolist():
                mine = np.flatnonzero(width == dim)
                x = flat[(ends[mine] - dim)[:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[mine], labels[mine], x))
                if sum(len(p[0]) for p in held[dim]) >= ROWS:
                    yield block(dim)
        while sum(len(p[0]) for h in held.values() for p in h) > 4 * ROWS:  # many lengths of vectors: the fullest goes
            yield block(max(held, key=lambda d: sum(len(p[0]) for p in held[d])))
    for dim in sorted(held):
        yield block(dim)


class Best:
    """The first k of what an anchor has found for one slot: score descending, then id."""

    __slots__ = ("scores", "ids", "k", "last")

    def __init__(self, k: int):
        self.scores, self.ids, self.k, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64), k, None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        s, i = np.r_[self.scores, scores], np.r_[self.ids, ids]
        first = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[first], i[first]
        self.last = int(self.scores[-1]) if len(first) == self.k else None


class Block:
    """A block's columns, in float64 if the anchor's scores are exact so, with the least and greatest value of each."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(columns, np.int64).reshape(dim, -1)
        self.least, self.most = self.whole.min(axis=1), self.whole.max(axis=1)
        self.largest = max(abs(int(self.least.min())), abs(int(self.most.max())))
        self.real = self.whole.astype(np.float64) if self.largest < 1 << 53 else None

    def scan(self, q: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are left of `alive` (places in the block) and their exact scores. `keep(low, high)` says which stay, given bounds of their scores."""
        dim = len(q)
        exact = self.real is not None and dim * int(np.abs(q).max()) * self.largest < 1 << 53
        x, w = (self.real, q.astype(np.float64)) if exact else (self.whole, q)
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = w[order] * self.least[order], w[order] * self.most[order]
        low = np.r_[np.cumsum(np.minimum(a, b)[::-1])[::-1], 0]
        high = np.r_[np.cumsum(np.maximum(a, b)[::-1])[::-1], 0]
        part = np.zeros(len(alive), x.dtype)
        for at in range(0, dim, STEP):
            if not len(alive):
                break
            dims = order[at : at + STEP]
            part = part + w[dims] @ x[dims[:, None], alive]
            to = min(at + STEP, dim)
            stay = keep(part + low[to], part + high[to])
            if not stay.all():
                alive, part = alive[stay], part[stay]
        return alive, part.astype(np.int64)


def _kth(scores: np.ndarray, k: int) -> float | None:
    """The k-th greatest, if there are so many."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def _same_label(block: Block, anchor: dict, best: list[Best], k: int) -> None:
    top = best[0]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        sure = _kth(low, k)
        bar = max((x for x in (sure, top.last) if x is not None), default=None)
        return np.ones(len(high), bool) if bar is None else high >= bar

    alive, scores = block.scan(anchor["q"], np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["vec_id"])), keep)
    top.add(scores, block.ids[alive])


def _other_label(block: Block, anchor: dict, best: list[Best], k: int) -> None:
    windows = anchor["windows"]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(high), bool)
        for (a, b), top in zip(windows, best):
            sure = _kth(low[(low >= a) & (high <= b)], k)
            bar = max(x for x in (a, sure, top.last) if x is not None)
            out |= (high >= bar) & (low <= b)
        return out

    alive, scores = block.scan(anchor["q"], np.flatnonzero(block.labels != anchor["label"]), keep)
    for (a, b), top in zip(windows, best):
        hit = (scores >= a) & (scores <= b)
        top.add(scores[hit], block.ids[alive[hit]])


def _sweep(k: int, look):
    """Rows of a range and a part: anchors (kind 0), then blocks (kind 1) one at a time; what each anchor has found, by slot."""

    def run(batches):
        here, anchors, best = None, [], []

        def found():
            rows = [(a["key"], s, i, v) for a, tops in zip(anchors, best) for s, t in enumerate(tops) for i, v in zip(t.ids.tolist(), t.scores.tolist())]
            for at in range(0, len(rows), 65_536):
                key, slot, ids, scores = zip(*rows[at : at + 65_536])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(slot, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["key", "slot", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                if (r["range"], r["part"]) != here:
                    yield from found()
                    here, anchors, best = (r["range"], r["part"]), [], []
                if r["kind"] == 0:
                    bounds = list(zip(r["lo"], r["hi"])) if r["lo"] is not None else [None]
                    anchors.append({"key": r["key"], "vec_id": r["vec_id"], "label": r["label"], "q": np.array(r["x"], np.int64), "windows": bounds})
                    best.append([Best(k) for _ in bounds])
                    continue
                block = Block(r["dim"], r["ids"], r["labels"], r["columns"])
                for a, tops in zip(anchors, best):
                    if len(a["q"]) == r["dim"]:
                        look(block, a, tops, k)
        yield from found()

    return run


def _met(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int, k: int, look) -> DataFrame:
    """Each anchor (key, vec_id, label, x, lo, hi) against all blocks: (key, slot, vec_id, score), the first k of each range of blocks."""
    ranges = max(1, math.isqrt(max(0, n_blocks - 1)) + 1)
    parts = max(1, math.isqrt(n_anchors // 64), -(-n_anchors // ANCHORS))
    dealt = anchors.withColumns({"kind": F.lit(0), "part": F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"), "range": F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))})
    held = blocks.withColumns({"kind": F.lit(1), "range": F.pmod(F.xxhash64("block"), F.lit(ranges)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    both = dealt.unionByName(held, allowMissingColumns=True).select("range", "part", "kind", "key", "vec_id", "label", "x", "lo", "hi", "dim", "ids", "labels", "columns")
    both = both.repartition(ranges * parts, "range", "part").sortWithinPartitions("range", "part", "kind")
    return both.mapInArrow(_sweep(k, look), FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, of components floor(scale * x). An anchor's positives are its first
    `positives` other rows of the same label; each gives the first `negatives` rows of other labels whose score lies from `low` to `high`
    percent of its own. Higher scores come first, ties by smaller vec_id. Fewer rows than asked for: all of them.
    `label` may change labels first. Rows that `quantised` leaves out take no part; rows that repeat wholly count once, rows that
    share an id are rows of their own, none of them its anchor's positive. Vectors of another length than the anchor's
    don't match it. No anchors, no positives or no rows in the window: no rows.
    """
    rows = materialize(quantised(vectors, label, scale), "quantised")
    blocks = materialize(rows.select("vec_id", "label", "x").mapInArrow(_pack, BLOCK_SCHEMA), "blocks")
    none = F.lit(None).cast("array<long>")
    anchors = materialize(rows.where(is_anchor).select(F.xxhash64("vec_id", "label", "x").alias("key"), "vec_id", "label", "x", none.alias("lo"), none.alias("hi")), "anchors")
    n_blocks, n_anchors = blocks.count(), anchors.count()
    first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    near = _met(blocks, anchors, n_blocks, n_anchors, positives, _same_label)
    near = materialize(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives), "positives")
    lo = F.ceil(F.col("score").cast("decimal(19,0)") * F.lit(low).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    hi = F.floor(F.col("score").cast("decimal(19,0)") * F.lit(high).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = near.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select("key", "lo", "hi").distinct()
    slots = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("w"))  # at most `positives`
    asked = anchors.drop("lo", "hi").join(slots, "key").select("key", "vec_id", "label", "x", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    asked = materialize(asked, "windows")
    found = _met(blocks, asked, n_blocks, n_anchors, negatives, _other_label)
    by_slot = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id")
    found = materialize(found.withColumn("rank", F.row_number().over(by_slot)).where(F.col("rank") <= negatives), "negatives")
    bounds = asked.select("key", F.posexplode(F.arrays_zip("lo", "hi")).alias("slot", "w")).select("key", "slot", "w.lo", "w.hi")
    pairs = near.select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")).join(bounds, ["key", "lo", "hi"])
    ids = asked.select("key", F.col("vec_id").alias("anchor_id"))
    out = pairs.join(found.select("key", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["key", "slot"]).join(ids, "key")
    out = materialize(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(rows, blocks, anchors, near, asked, found)
    return out


#: The same in DuckDB SQL, for vectors whose inner products are exact in double.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
"""
