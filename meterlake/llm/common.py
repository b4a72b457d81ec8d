"""Shared parts of the training-data operators: materialising, size-checked joins, byte arrays.

Every operator selects the columns it needs first, so extra columns with clashing names never
reach a join. Intermediate results go to Parquet under the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a table that may be broadcast, as the hash table that the driver builds; it holds that some three times until it is sent.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a folder of our own only on one machine, where it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these, once all that is made of them is written too."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None, beyond: str = "merge") -> DataFrame:
    """Broadcast hint only behind a count; beyond `BROADCAST_BYTES` a hint for a join over a shuffle, so that Spark doesn't broadcast on a guess from the size of files.

    A row takes 8 bytes a number, once more for its keys, and some 70 for its place in the table.
    """
    n = df.count() if rows is None else rows
    numbers = sum(len(f.dataType.fields) if isinstance(f.dataType, StructType) else 1 for f in df.schema)
    return F.broadcast(df) if n * (8 * numbers + 100) <= BROADCAST_BYTES else df.hint(beyond)


#: What tells rows apart: the id, which may be missing or repeat, and the hash of the text.
ROW = ("doc_id", "version")


def with_version(docs: DataFrame, name: str = "version") -> DataFrame:
    return docs.withColumn(name, F.xxhash64("text"))


def join_rows(docs: DataFrame, rows: DataFrame, how: str = "inner", version: str = "__version") -> DataFrame:
    """Rows with a text met by small rows of the same id and version, a missing id included; the latter's columns get a `__`.

    Always a hash join over a shuffle, so the plan is the same at every size; each text moves once.
    """
    rows = rows.select([F.col(c).alias("__row_version" if c == "version" else f"__{c}") for c in rows.columns])
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col(version) == F.col("__row_version"))
    out = docs.join(rows.hint("shuffle_hash"), same, how)
    return out if how in ("left_semi", "left_anti") else out.drop("__doc_id", "__row_version")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], by: str, salts: int = 64) -> DataFrame:
    """Inner join in which a key of `many` may hold most rows: it is dealt by `salts` values of `by`, and `few` copied to each.

    Always over a shuffle: Spark takes the copies for no more bytes than `few` and would gather all of them on the driver.
    """
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(copies, [*keys, "salt"]).drop("salt")


# --------------------------------------------------------------------------- bytes in numpy

U64 = np.uint64
#: Bytes whose words are hashed at once.
CHUNK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, U64)
_ipow = np.ones(1, U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for base, name in ((_BASE, "_pow"), (_INV, "_ipow")):
            a = np.full(size, base, U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow, _ipow


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (a longer text alone), so that memory stays bounded."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of the texts i..j of a batch: byte spans, hashes and the text each belongs to."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, i: int, j: int, inside: np.ndarray, prefixes: tuple[int, ...] = ()):
        lo, hi = int(offsets[i]), int(offsets[j])
        self.buf = buf = data[lo:hi]
        self.bounds = bounds = offsets[i : j + 1] - lo
        n = len(buf)
        m = np.zeros(n + 2, bool)
        m[1 : n + 1] = inside[buf]
        before, after = m[:n].copy(), m[2:].copy()
        cuts = bounds[(bounds < n)]
        before[cuts] = False
        cuts = bounds[bounds > 0] - 1
        after[cuts] = False
        here = m[1 : n + 1]
        self.start = np.flatnonzero(here & ~before)
        self.end = np.flatnonzero(here & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)  # words of text k: first[k]..first[k + 1]
        self.hash = np.zeros(len(self.start), U64)
        self.prefix = {k: np.zeros(len(self.start), U64) for k in prefixes}
        a = 0
        while a < len(self.start):  # some `CHUNK` bytes of words at once, so that a long text costs little more than itself
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + CHUNK, "right")))
            start, end = self.start[a:b] - self.start[a], self.end[a:b] - self.start[a]
            n = int(end[-1])
            p, ip = _powers(n + 1)
            s = np.zeros(n + 1, U64)
            np.cumsum((LOWER[buf[self.start[a] : self.end[b - 1]]].astype(U64) + U64(1)) * p[:n], out=s[1:])
            self.hash[a:b] = mix((s[end] - s[start]) * ip[start] + (end - start).astype(U64))
            for k, out in self.prefix.items():
                out[a:b] = mix((s[np.minimum(start + k, end)] - s[start]) * ip[start] + U64(k << 40))
            a = b

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
