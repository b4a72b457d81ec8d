"""Toxicity: a linear-chain conditional random field over the words of a document.

Labels are given for documents, so tokens are labelled from them first: a word, or a word beginning
(4 or 5 bytes), is evidence by its log odds between toxic and other training documents, and a token of
a toxic document with strong evidence is a toxic token. The field (two states; emissions from the
evidence of the word and its beginnings, and transitions) is fitted to these labels by its likelihood.
Forward-backward marginals give each token's probability; document scores come from a logistic model of
their sum, maximum and density; runs of tokens over one half are the offending spans.

Inference is exact and independent of text length: the chains of a batch lie end to end, with a reset
at each text, and are multiplied out by a blocked scan over 2 x 2 matrices.

The model is fitted on at most `SAMPLE` labelled documents of each class (ordered by a hash of the id) and
`SAMPLE_CHARS` of each, its field on at most `FIELD_TOKENS` tokens of documents of both classes in turn: documented
bounds of a fit. It has at most `TERMS` entries, so sending it to the executors is bounded too. Scores read whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, U64, Words, slices, text_buffers

SAMPLE, SAMPLE_CHARS, FIELD_TOKENS = 1000, 100_000, 150_000
TERMS = 40_000
PREFIXES = (4, 5)
EVIDENCE = 2.5


def _features(w: Words) -> list[np.ndarray]:
    return [w.hash, *(w.prefix[k] for k in PREFIXES)]


class Evidence:
    """Log odds by feature hash; absent features count 0."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def fit(docs: list[list[np.ndarray]], toxic: np.ndarray) -> Evidence:
        bag = [np.unique(np.concatenate(d)) for d in docs]
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        keys, inverse = np.unique(np.concatenate(bag) if bag else np.zeros(0, U64), return_inverse=True)
        is_toxic = np.repeat(toxic, [len(b) for b in bag])
        one = np.bincount(inverse[is_toxic], minlength=len(keys))
        zero = np.bincount(inverse[~is_toxic], minlength=len(keys))
        prior = 0.3 + n1 / 1000  # families of copies make rare words look toxic; with more data ask for more
        odds = np.log((one + prior) / (n1 + 2 * prior)) - np.log((zero + prior) / (n0 + 2 * prior))
        keep = np.flatnonzero((one + zero >= 4) & (odds > 1.0))
        keep = keep[np.argsort(-(odds[keep] * np.sqrt(one[keep])), kind="stable")[:TERMS]]
        return Evidence(keys[keep], odds[keep])

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        if len(self.keys):
            some = np.flatnonzero(self.maybe[(h & U64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == h[some], self.odds[at], 0.0)
        return out

    def design(self, features: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.ones(len(features[0])), *(self.of(h) for h in features)], axis=1)


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and the expected transitions [2, 2] summed over all of them.

    `emission`: log potential of state 1 against state 0; `first`: token starts a text; `trans`: log
    potentials. Messages are normalised; blocks of a batch are scanned in parallel and then joined.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    step = max(1, int(np.sqrt(n)))
    blocks = -(-n // step)
    size = blocks * step
    e = np.zeros((size, 2))
    e[:n, 1] = np.clip(emission, -30, 30)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    m = t[None] * e[:, None, :]  # m[i][a, b]: from state a of i - 1 to state b of i
    start = np.flatnonzero(first)
    m[start] = np.stack([e[start], e[start]], axis=1)  # whatever came before, a text starts evenly
    m[n:] = np.eye(2)

    def scan(m: np.ndarray, left: np.ndarray) -> np.ndarray:
        b = m.reshape(blocks, step, 2, 2)
        p = np.empty_like(b)
        p[:, 0] = b[:, 0]
        for k in range(1, step):
            x = np.einsum("bij,bjk->bik", p[:, k - 1], b[:, k])
            p[:, k] = x / x.sum(axis=(1, 2), keepdims=True)
        carry = np.empty((blocks, 2))
        for k in range(blocks):
            carry[k] = left
            left = left @ p[k, -1]
            left = left / left.sum()
        f = np.einsum("bi,bkij->bkj", carry, p).reshape(size, 2)
        return f / f.sum(axis=1, keepdims=True)

    f = scan(m, np.array([0.5, 0.5]))
    # Backwards: b[i] = m[i + 1] b[i + 1]; reversed and transposed it is the same scan.
    back = np.empty_like(m)
    back[:-1] = m[:0:-1].transpose(0, 2, 1)
    back[-1] = np.eye(2)
    b = np.empty((size, 2))
    b[:-1] = scan(back, np.array([0.5, 0.5]))[size - 2 :: -1] if size > 1 else np.zeros((0, 2))
    b[-1] = 0.5
    joint = f * b
    p1 = joint[:, 1] / joint.sum(axis=1)
    pair = f[: n - 1, :, None] * m[1:n] * b[1:n, None, :]
    pair = pair[~first[1:n]]
    total = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(pair) else np.zeros((2, 2))
    return p1[:n], total


class Model:
    """Evidence, field weights and the logistic model of document scores."""

    def __init__(self, texts: list[str | None], toxic: list[int]):
        self.empty = not any(toxic) or all(toxic)
        if self.empty:
            self.rate = 0.0 if not any(toxic) else 1.0
            return
        y = np.array(toxic, bool)
        docs = self._docs(texts)
        half = np.arange(len(y)) % 2 == 0
        self.weights, self.trans = np.zeros(2 + len(PREFIXES)), np.zeros((2, 2))
        x = np.zeros((len(y), 4))
        # Document features of each half come from evidence of the other half, else they look too good.
        for part in (half, ~half):
            if not (y[part].any() and (~y[part]).any()):
                part = np.ones(len(y), bool)
            self.evidence = Evidence.fit([d for d, k in zip(docs, part) if k], y[part])
            if not self.weights.any():
                self._fit_field([d for d, k in zip(docs, part) if k], y[part])
            other = np.flatnonzero(~part) if not part.all() else np.arange(len(y))
            for i in other.tolist():
                x[i] = self._summary(docs[i])[0][0]
        self._fit_logistic(x, y)
        self.evidence = Evidence.fit(docs, y)

    @staticmethod
    def _docs(texts) -> list[list[np.ndarray]]:
        offsets, data = text_buffers(pa.array(texts, pa.string()))
        out = []
        for i, j in slices(offsets):
            w = Words(offsets, data, i, j, LETTER, PREFIXES)
            f = _features(w)
            out += [[h[a:b].copy() for h in f] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
        return out

    def _fit_field(self, docs, y, rounds: int = 50) -> None:
        """Gradient ascent on the conditional log likelihood of the token labels of at most FIELD_TOKENS tokens."""
        used, total = [], 0
        turn = np.zeros(len(y))
        turn[y], turn[~y] = np.arange(y.sum()), np.arange((~y).sum()) + 0.5
        for k in np.argsort(turn, kind="stable").tolist():
            if total < FIELD_TOKENS and len(docs[k][0]):
                used.append(k)
                total += len(docs[k][0])
        x = np.concatenate([self.evidence.design(docs[k]) for k in used])
        first = np.zeros(len(x), bool)
        first[np.cumsum([0, *(len(docs[k][0]) for k in used)])[:-1]] = True
        gold = (x[:, 1:].max(axis=1) >= EVIDENCE) & np.repeat(y[used], [len(docs[k][0]) for k in used])
        seen = np.zeros((2, 2))
        inner = ~first[1:]
        np.add.at(seen, (gold[:-1][inner].astype(int), gold[1:][inner].astype(int)), 1)
        want = x.T @ gold
        theta = np.r_[-4.0, np.ones(x.shape[1] - 1), np.zeros(4)]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            p, pairs = marginals(x @ theta[: x.shape[1]], first, theta[x.shape[1] :].reshape(2, 2))
            g = np.r_[want - x.T @ p, (seen - pairs).ravel()] / len(x) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        self.weights, self.trans = theta[: x.shape[1]], theta[x.shape[1] :].reshape(2, 2)

    def _fit_logistic(self, x, y) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])

        def loss(w):
            m = z @ w
            return np.logaddexp(0, np.where(y, -m, m)).sum() + 0.5 * w @ w

        for _ in range(30):  # Newton's method, halving steps that don't improve (classes may be separable)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + np.eye(len(w))
            step, before = np.linalg.solve(h, z.T @ (y - p) - w), loss(w)
            while loss(w + step) > before and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w + step
        self.logit = w

    def _summary(self, features: list[np.ndarray], first: np.ndarray | None = None):
        """Per text: summary of its marginals; and the marginals. `first`: token bounds of the texts."""
        n = len(features[0])
        bounds = np.array([0, n]) if first is None else first
        starts = np.zeros(n, bool)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        p, _ = marginals(self.evidence.design(features) @ self.weights, starts, self.trans)
        total = np.r_[0.0, np.cumsum(p)]
        words = np.diff(bounds)
        mass = total[bounds[1:]] - total[bounds[:-1]]
        top = np.zeros(len(words))
        full = np.flatnonzero(words)
        if n:
            top[full] = np.maximum.reduceat(p, bounds[:-1][full])
        rows = np.stack([top, np.log1p(mass), np.minimum(mass, 3.0), mass / np.maximum(words, 1)], axis=1)
        return rows, p

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        if self.empty:
            return np.full(len(w.bounds) - 1, self.rate), np.zeros(len(w.hash))
        rows, p = self._summary(_features(w), w.first)
        z = np.c_[np.ones(len(rows)), (rows - self.mean) / self.scale] @ self.logit
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the documents whose id isn't held out; `sample` bounds the documents of each class."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out("id"))
    order = F.xxhash64("id")
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "id").limit(sample) for k in (0, 1)]
    both = chosen[0].union(chosen[1]).dropDuplicates(["id", "toxic"])
    found = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(both), F.col("doc_id") == F.col("id"))
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect()  # an id that repeats counts once
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id, r.text or "", r.toxic))
    return Model([r.text for r in rows], [r.toxic for r in rows])


def held_out(column: str):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0, F.lit(False))


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                w = Words(offsets, data, i, j, LETTER, PREFIXES)
                score, p = model.score(w)
                point = np.r_[0, np.cumsum((w.buf & 0xC0) != 0x80)]  # bytes to code points
                hot = p > 0.5
                spans = []
                for k in range(j - i):
                    a, b = w.first[k], w.first[k + 1]
                    at = np.flatnonzero(hot[a:b]) + a
                    base = point[w.bounds[k]]
                    cut = np.flatnonzero(np.r_[True, np.diff(at) > 1]) if len(at) else []
                    ends = [*cut[1:], len(at)] if len(at) else []
                    spans.append([{"start": int(point[w.start[at[s]]] - base), "end": int(point[w.end[at[e - 1]]] - base)} for s, e in zip(cut, ends)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "score", "spans"],
                )

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (offending code points).

    One row per row; null and empty texts have no tokens and get the score of a document without
    evidence. A corpus without toxic labels scores 0. No shuffle; the model is of bounded size.
    """
    s = docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double, spans array<struct<start: long, end: long>>")
    return s.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their columns; one pass, nothing is shuffled."""
    schema = docs.schema
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(text))
            stay = np.concatenate([model.score(Words(offsets, data, i, j, LETTER, PREFIXES))[0] < 0.5 for i, j in slices(offsets)]) if len(batch) else np.zeros(0, bool)
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, schema)
