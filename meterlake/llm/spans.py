"""What the scanners of secrets and personal data share: spans of texts, columns made of them, and a bounded sample."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers

Span = tuple[int, int, str]  # start, end (code points, end exclusive), kind


def spelled(spans: list[Span], kinds: list[str]) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


class Cover:
    """What some spans cover, for tests of overlap by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end


def scanner(scan, base: list[str], kinds: list[str], needed: np.ndarray):
    """mapInArrow function of `scan(texts) -> [(base spans, more spans)]`. `needed`: bytes without which a text has none."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            texts = pc.fill_null(batch.column(1), "")
            for i, j in slices(offsets):
                n = {k: [0] * (j - i) for k in base}
                digest, all_spans, total = [nothing] * (j - i), [""] * (j - i), [0] * (j - i)
                lo = int(offsets[i])
                at = np.flatnonzero(needed[data[lo : int(offsets[j])]]) + lo
                rows = np.unique(np.searchsorted(offsets, at, "right") - 1).tolist()
                for row, (found, more) in zip(rows, scan([texts[r].as_py() for r in rows])):
                    for _, _, k in found:
                        n[k][row - i] += 1
                    digest[row - i] = hashlib.sha256(spelled(found, kinds).encode()).hexdigest()
                    all_spans[row - i] = spelled(found + more, kinds)
                    total[row - i] = len(found) + len(more)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(n[k], pa.int64()) for k in base), pa.array(digest), pa.array(all_spans), pa.array(total, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "n_spans"],
                )

    return run


def scan_with(docs: DataFrame, scan, base: list[str], kinds: list[str], needed: np.ndarray) -> DataFrame:
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in base), "base_sha256 string, spans string, n_spans long"])
    return docs.select("doc_id", "text").mapInArrow(scanner(scan, base, kinds, needed), schema)


def sample_texts(docs: DataFrame, limit: int, most_chars: int) -> list[str]:
    """Some `limit` distinct documents by a hash of id and text, at most `most_chars` of each: a bounded sample to fit on.

    Rows are chosen by their hash before anything is gathered, so what reaches the driver has the same size at any scale.
    """
    places = 1 << 40
    cut = int(places * min(1.0, 1.2 * limit / max(1, docs.count())))
    h = F.xxhash64("doc_id", "text")
    rows = docs.select(h.alias("h"), F.substring("text", 1, most_chars).alias("t")).where((F.pmod("h", F.lit(places)) < cut) & F.col("t").isNotNull())
    found = rows.groupBy("h").agg(F.first("t").alias("t")).collect()
    return [r.t for r in sorted(found, key=lambda r: r.h)[:limit]]
