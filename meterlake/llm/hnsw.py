"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node, kept with their least ids (as many as a query can return). Nodes are dealt
by hash into shards of about `SHARD` nodes. A shard's graph has levels drawn with odds of 1/16 each and is built by
search and insertion, top level first and within a level the nodes of higher levels first: a node descends the levels
above, a beam search of the level as it is so far gives its candidates, and it links to those that aren't nearer to
one chosen before (the usual diversity rule); links go both ways, and a node with too many keeps a diverse choice.
Nodes are inserted in blocks of at most a quarter of the level, and a block's nodes are candidates of each other.

Each graph is stored as one row of flat arrays. Its queries stream past it in batches, all of a batch at once: greedy
descent through the upper levels, then a beam on the lowest; a query that reaches fewer than k nodes of a
shard that has more is compared with all of them. Shard results are merged by exact inner products on the
original vectors. A task holds one graph and one batch, whatever the number of queries.

Inner products of vectors of different norms order like distances after one more component that fills
each vector up to the greatest norm, which the graph's construction uses.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast

SHARD = 16_384
LINKS = 24
BEAM, INSERT_BEAM = 160, 72
BLOCK = 512
#: Queries of a shard that one task answers.
QUERIES = 65_536


def _diverse(x: np.ndarray, near: np.ndarray, score: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those nearer to the row than to any chosen before; -1 fills."""
    n, c = near.shape
    chosen = np.full((n, links), -1, np.int32)
    count = np.zeros(n, np.int64)
    best = np.full((n, c), -np.inf, np.float32)
    for k in range(c):
        cand = near[:, k]
        ok = (cand >= 0) & (count < links) & (best[:, k] < score[:, k])
        rows = np.flatnonzero(ok)
        if not len(rows):
            continue
        chosen[rows, count[rows]] = cand[rows]
        count[rows] += 1
        if k + 1 < c:
            rest = near[rows, k + 1 :]
            sim = np.einsum("rcd,rd->rc", x[rest], x[cand[rows]])
            best[rows, k + 1 :] = np.maximum(best[rows, k + 1 :], sim)
    # Fill up with the nearest that were passed over.
    for k in range(c):
        cand = near[:, k]
        rows = np.flatnonzero((count < links) & (cand >= 0) & ~(chosen == cand[:, None]).any(axis=1))
        chosen[rows, count[rows]] = cand[rows]
        count[rows] += 1
    return chosen


def _beam(x: np.ndarray, g: np.ndarray, q: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of a level from `at`: ids and scores of each query's nearest, best first; -1 where fewer."""
    m = len(q)
    seen = np.zeros((m, len(x) + 1), bool)
    ids, score, done = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
    ids[:, 0], score[:, 0] = at, np.einsum("qd,qd->q", q, x[at])
    seen[np.arange(m), at] = True
    live = np.arange(m)
    while len(live):
        open_score = np.where(done[live] | (ids[live] < 0), -np.inf, score[live])
        pick = np.argpartition(-open_score, 1, axis=1)[:, :2]  # two nodes a step
        ok = np.take_along_axis(open_score, pick, 1) > -np.inf
        some = ok.any(axis=1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        done[live[:, None], pick] |= ok
        near = g[np.where(ok, ids[live[:, None], pick], 0)]
        near = np.where(ok[:, :, None], near, -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[live[:, None], near] = True
        seen[:, -1] = False
        s = np.where(near >= 0, np.einsum("qd,qcd->qc", q[live], x[near]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_s = np.concatenate([score[live], s], axis=1)
        all_d = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        score[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.where(score[live] > -np.inf, np.take_along_axis(all_ids, top, 1), -1)
        done[live] = np.take_along_axis(all_d, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _greedy(x: np.ndarray, g: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """From `at` to a node of the level none of whose neighbours is nearer."""
    rows, here = np.arange(len(q)), np.einsum("qd,qd->q", q, x[at])
    while True:
        near = g[at]
        s = np.where(near >= 0, np.einsum("qd,qcd->qc", q, x[near]), -np.inf)
        best = s.argmax(axis=1)
        top = s[rows, best]
        go = top > here
        if not go.any():
            return at
        at, here = np.where(go, near[rows, best], at), np.maximum(top, here)


def _insert(x: np.ndarray, above: list[np.ndarray], links: int) -> np.ndarray:
    """Neighbour array of a level whose nodes are the rows of `x`; those of the levels above come first."""
    n = len(x)
    g = np.full((n, 2 * links), -1, np.int32)
    at = 0
    while at < n:
        to = min(n, at + max(16, min(BLOCK, at // 4)))
        q = x[at:to]
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        k = min(links, to - at - 1)
        mates = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(q), 0), np.int64)
        near, score = (mates + at).astype(np.int32), np.take_along_axis(inner, mates, 1)
        if at:
            enter = np.zeros(len(q), np.int64)
            for upper in above:
                enter = _greedy(x, upper, q, enter) if len(upper) <= at else enter
            ids, s = _beam(x[:at], g[:at], q, enter, min(INSERT_BEAM, at) if at > 1 else 1)
            near, score = np.concatenate([ids, near], axis=1), np.concatenate([s, score], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        if near.shape[1]:
            g[at:to, :links] = _diverse(x, near, score, links)
        # Links back, appended where there is room, else a diverse choice of all.
        a = np.repeat(np.arange(at, to, dtype=np.int32), links)
        b = g[at:to, :links].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        who, first, many = np.unique(b, return_index=True, return_counts=True)
        room = (g[who] < 0).sum(axis=1)
        pos = np.arange(len(b)) - np.repeat(first, many)
        fits = np.repeat(many <= room, many)
        free = np.argsort(g[who] >= 0, axis=1, kind="stable")  # empty places first
        g[b[fits], free[np.repeat(np.arange(len(who)), many)[fits], pos[fits]]] = a[fits]
        full = np.flatnonzero(many > room)
        if len(full):
            new = np.full((len(full), many[full].max()), -1, np.int32)
            row = np.repeat(np.arange(len(full)), many[full])
            new[row, pos[~fits]] = a[~fits]
            cand = np.concatenate([g[who[full]], new], axis=1)
            s = np.where(cand >= 0, np.einsum("rd,rcd->rc", x[who[full]], x[cand]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")[:, : 3 * links]
            g[who[full]] = _diverse(x, np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1), 2 * links)
        at = to
    return g


class Graph:
    """Nodes in order of level, highest first; `levels[k]` is the neighbour array of those of level k and higher."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.x, self.levels = x, levels

    @staticmethod
    def build(x: np.ndarray, links: int = LINKS, seed: int = 7) -> tuple[np.ndarray, Graph]:
        """The order of the nodes, and the graph of the vectors in that order."""
        level = np.minimum(np.random.default_rng(seed).geometric(15 / 16, len(x)) - 1, 6)
        order = np.argsort(-level, kind="stable")
        x, level = x[order], level[order]
        norm = (x.astype(np.float64) ** 2).sum(axis=1)
        filled = np.c_[x, np.sqrt(np.maximum(norm.max() - norm, 0))].astype(np.float32)
        above: list[np.ndarray] = []
        for k in range(int(level.max()), -1, -1):
            above.append(_insert(filled[: int((level >= k).sum())], above, links))
        return order, Graph(x, above[::-1])

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """The k nearest of each query (rows of q), best first; all of a shard that has no more; -1 fills."""
        at = np.zeros(len(q), np.int64)
        for g in reversed(self.levels[1:]):
            at = _greedy(self.x, g, q, at)
        ids = _beam(self.x, self.levels[0], q, at, max(2, beam, k))[0][:, :k]
        want = min(k, len(self.x))
        few = np.flatnonzero((ids >= 0).sum(axis=1) < want)
        if len(few):  # what the graph doesn't reach
            ids[few, :want] = np.argsort(-(q[few] @ self.x.T), axis=1, kind="stable")[:, :want]
        return ids


def _graph_rows(key, part: pd.DataFrame) -> pd.DataFrame:
    """A row of flat arrays for each length of vector in a shard."""
    out = []
    for size, same in part.sort_values(["first", "node"]).groupby(part.x.map(len)):
        x = np.stack(same.x.to_numpy()).astype(np.float64)
        order, g = Graph.build(x.astype(np.float32))
        out.append((int(key[0]), int(size), same.node.to_numpy()[order].astype(np.int64).tobytes(), x[order].tobytes(), [len(v) for v in g.levels], np.concatenate([v.ravel() for v in g.levels]).tobytes()))
    return pd.DataFrame(out, columns=["shard", "dim", "nodes", "vectors", "sizes", "links"])


def _search_rows(k: int):
    """Rows (shard, part, kind, query_id, x, dim, nodes, vectors, sizes, links): graphs (kind 0), then the queries that pass them."""

    def run(batches):
        here, graphs = None, {}
        for batch in batches:
            rows = batch.to_pydict()
            kind = np.array(rows["kind"])
            place = list(zip(rows["shard"], rows["part"]))
            at = 0
            while at < len(kind):
                if place[at] != here:
                    here, graphs = place[at], {}
                if kind[at] == 0:
                    nodes, dim = np.frombuffer(rows["nodes"][at], np.int64), rows["dim"][at]
                    x = np.frombuffer(rows["vectors"][at], np.float64).reshape(-1, dim)
                    cut = np.cumsum([v * 2 * LINKS for v in rows["sizes"][at]])[:-1]
                    levels = [v.reshape(-1, 2 * LINKS) for v in np.split(np.frombuffer(rows["links"][at], np.int32), cut)]
                    graphs[dim] = nodes, x, Graph(x.astype(np.float32), levels)
                    at += 1
                    continue
                to = at
                while to < len(kind) and to - at < BLOCK and place[to] == here and kind[to] == 1:
                    to += 1
                ids = np.array(rows["query_id"][at:to])
                sizes = np.array([len(v) for v in rows["x"][at:to]])
                for dim in np.unique(sizes):
                    mine = np.flatnonzero(sizes == dim)
                    if dim in graphs:
                        nodes, x, g = graphs[dim]
                        q = np.array([rows["x"][at + m] for m in mine])
                        found = g.search(q.astype(np.float32), k)
                        r, c = np.nonzero(found >= 0)
                        hit = found[r, c]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[mine[r]]), pa.array(nodes[hit]), pa.array(np.einsum("rd,rd->r", q[r], x[hit]))], names=["query_id", "node", "score"])
                at = to

    return run


def nearest(vectors: DataFrame, is_query: str, k: int = 20, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by inner product in double.

    Nearest first, ties to the smaller vec_id; a query never finds itself. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor rows without a vec_id; vectors whose
    length differs from the query's don't match it. Rows that repeat a vec_id count once a vector.
    Fewer candidates than k: all of them. No rows: no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and x is not null and size(x) > 0 and forall(x, a -> a is not null and not isnan(a) and abs(a) < double('infinity')) and exists(x, a -> a <> 0)"
    )
    v = materialize(v.withColumn("node", F.xxhash64("x")).distinct(), "vectors")
    least = Window.partitionBy("node").orderBy("vec_id")
    members = materialize(v.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n"), "members")
    nodes = members.groupBy("node").agg(F.min("vec_id").alias("first"), F.first("x").alias("x"))
    count = members.select("node").distinct().count()
    shards = max(1, -(-count // shard))
    queries = materialize(v.where(is_query).select(F.col("vec_id").alias("query_id"), "x"), "queries")

    dealt = nodes.withColumn("shard", F.pmod("node", F.lit(shards)).cast("int"))
    shape = "shard int, dim int, nodes binary, vectors binary, sizes array<int>, links binary"
    graphs = materialize(dealt.groupBy("shard").applyInPandas(_graph_rows, shape), "graphs")
    parts = max(1, -(-queries.count() // QUERIES))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "query_id", "x")
    held = graphs.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "kind": F.lit(0)})
    both = held.unionByName(asked, allowMissingColumns=True).select("shard", "part", "kind", "query_id", "x", "dim", "nodes", "vectors", "sizes", "links")
    both = both.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = materialize(both.mapInArrow(_search_rows(k + 1), "query_id long, node long, score double"), "found")
    discard(graphs, queries)
    # Members of the nodes found, then the k best of all shards.
    rows = found.join(maybe_broadcast(members.select("node", "vec_id")), "node").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
