"""Stored keys in buckets that grow: linear hashing by provider, and a Bloom filter a key file.

A provider's keys lie in `n` buckets; once they average more than the table's capacity, the next buckets are split off, and only
those that they split are written anew. `key_files` has a row for each file of keys, with its Bloom filter; a row with `base`
says that a bucket's older files are gone. A batch looks up the files of its buckets whose filters hold one of its keys.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import FAN, Versions

KEYS = "fingerprint string, provider string, bucket int"
FILES = "bucket int, seq bigint, base boolean, file string, n bigint, bloom binary, provider string"
#: Files of a bucket from which they are written as one; keys of a batch in a bucket up to which filters are asked.
MOST_FILES, FEW = 8, 4096
#: Bits of a filter a key, at least; bits set by a key.
BITS, HASHES = 16, 7


def bucket(layout: dict[str, dict]) -> Column:
    """The bucket of (provider, fingerprint)."""
    if not layout:
        return F.lit(0)
    n = {p: x["n"] for p, x in layout.items()}
    in_map = lambda m: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("provider")], F.lit(1)).cast("long")
    high = in_map({p: 2 << (k.bit_length() - 1) for p, k in n.items()})
    b = F.pmod(F.xxhash64("fingerprint"), high)
    return F.when(b < in_map(n), b).otherwise(b - F.expr("1L") * high / 2).cast("int")


def split_by(before: int, after: int) -> set[int]:
    """Buckets among the first `before` that new ones up to `after` take keys from."""
    out = set()
    for x in range(before, after):
        while x >= before:
            x -= 1 << (x.bit_length() - 1)
        out.add(x)
    return out


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    u = h.view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _filter(t: pa.Table) -> pa.Table:
    """The Bloom filter of a file's keys (provider, bucket, h)."""
    h = t.column("h").to_numpy()
    bits = 1 << max(6, math.ceil(math.log2(BITS * max(1, len(h)))))
    at = _places(h, bits).ravel()
    held = np.zeros(bits, bool)
    held[at] = True
    held = np.packbits(held, bitorder="little")
    return pa.table({"provider": t.column("provider").slice(0, 1), "bucket": t.column("bucket").slice(0, 1), "n": pa.array([len(h)], pa.int64()), "bloom": pa.array([held.tobytes()], pa.binary())})


def _may_hold(asked: pa.Table, files: pa.Table) -> pa.Table:
    """Files (provider, bucket, file, bloom) whose filter holds one of the keys asked for."""
    h = asked.column("h").to_numpy()
    hit = []
    for k in range(len(files) if len(h) else 0):
        held = np.frombuffer(files.column("bloom")[k].as_py(), np.uint8)
        at = _places(h, len(held) * 8)
        hit.append(bool(((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1).any()))
    return files.select(["provider", "bucket", "file"]).filter(pa.array(hit or [False] * len(files), pa.bool_()))


def files(table: Versions, state: dict) -> DataFrame:
    """provider, bucket, file, n, bloom of the files that hold keys in a version."""
    rows = table.read(state, "key_files", FILES)
    since = rows.where("base").groupBy("provider", "bucket").agg(F.max("seq").alias("since"))
    return rows.where("file is not null").join(since, ["provider", "bucket"], "left").where("since is null or seq >= since").select("provider", "bucket", "file", "n", "bloom")


def paths(table: Versions, state: dict, some: DataFrame) -> list[str]:
    """The folders of files (provider, bucket, file)."""
    folder = {(e["write"], unquote(p.removeprefix("provider="))): p for e in state["tables"].get("keys", []) for p in e["parts"]}
    return sorted(f"{table.path}/keys/write={r.file}/{folder[r.file, r.provider]}/bucket={r.bucket}" for r in some.select("provider", "bucket", "file").distinct().collect())


def read(table: Versions, folders: list[str]) -> DataFrame:
    if not folders:
        return table.spark.createDataFrame([], KEYS)
    return table.spark.read.schema(f"{KEYS}, write string").option("basePath", f"{table.path}/keys").parquet(*folders).drop("write")


def asked_files(table: Versions, state: dict, batch: DataFrame, everywhere: bool = False) -> DataFrame:
    """Files (provider, bucket, file) that may hold keys of a batch (provider, fingerprint); `everywhere`: under any provider.

    Buckets of which a batch has many keys are taken whole; for the others its few keys meet the filters.
    """
    layout = state.get("layout", {})
    asked = batch.select("provider", "fingerprint")
    if everywhere and layout:
        asked = asked.select("fingerprint").withColumn("provider", F.explode(F.array(*[F.lit(p) for p in layout])))
    held = files(table, state)
    if not layout:
        return held.select("provider", "bucket", "file")
    asked = asked.where(F.col("provider").isin(list(layout))).withColumn("bucket", bucket(layout))
    # A row a bucket comes to the driver, as the files' paths do.
    load = [(r.provider, r.bucket, r.asked) for r in asked.groupBy("provider", "bucket").agg(F.count("*").alias("asked")).collect()]
    of = lambda some: F.broadcast(table.spark.createDataFrame([(p, b) for p, b, _ in some], "provider string, bucket int"))
    whole = held.join(of([x for x in load if x[2] > FEW]), ["provider", "bucket"], "left_semi").select("provider", "bucket", "file")
    few = [x for x in load if x[2] <= FEW]
    if not few:
        return whole
    keys = asked.join(of(few), ["provider", "bucket"], "left_semi").select("provider", "bucket", F.xxhash64("fingerprint", F.lit(1)).alias("h"))
    met = keys.groupBy("provider", "bucket").cogroup(files(table, state).groupBy("provider", "bucket")).applyInArrow(_may_hold, "provider string, bucket int, file string")
    return whole.union(met)


def add(table: Versions, state: dict, rows: DataFrame, added: dict[str, int], capacity: int) -> tuple[dict, dict, dict]:
    """Writes the keys of new rows, splits buckets that have grown full and joins buckets of many files. Returns the entries of `keys` and `key_files`, and the layout."""
    layout, again, split = dict(state.get("layout", {})), set(), set()
    for p, n in added.items():
        old = layout.get(p, {"n": 1, "keys": 0})
        total = old["keys"] + n
        grown = max(old["n"], -(-total // capacity))
        layout[p] = {"n": grown, "keys": total}
        if old["keys"]:
            split |= {(p, b) for b in split_by(old["n"], grown)}
            again |= {(p, b) for b in range(old["n"], grown)}
    held = files(table, state).where(F.col("provider").isin(list(added)))
    many = held.groupBy("provider", "bucket").count().where(F.col("count") >= MOST_FILES).select("provider", "bucket")
    anew = split | {(r.provider, r.bucket) for r in many.collect()}
    keys = rows.select("fingerprint", "provider")
    spark = table.spark
    if anew:
        whole = spark.createDataFrame(sorted(anew), "provider string, bucket int")
        keys = keys.union(read(table, paths(table, state, held.join(whole, ["provider", "bucket"], "left_semi"))).select("fingerprint", "provider"))
    dealt = keys.withColumn("bucket", bucket(layout)).hint("rebalance", "provider", "bucket")
    entry = table.write("keys", dealt, "bucket")
    written = read(table, table.paths("keys", [entry])).select("provider", "bucket", F.xxhash64("fingerprint", F.lit(1)).alias("h"))
    found = written.groupBy("provider", "bucket").applyInArrow(_filter, "provider string, bucket int, n bigint, bloom binary")
    seq = F.lit(state["version"] + 1).cast("bigint")
    index = found.select("bucket", seq.alias("seq"), F.lit(False).alias("base"), F.lit(entry["write"]).alias("file"), "n", "bloom", "provider")
    if anew:
        marks = spark.createDataFrame(sorted(anew | again), "provider string, bucket int")
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        index = index.union(marks.select("bucket", seq.alias("seq"), F.lit(True).alias("base"), none("string", "file"), none("bigint", "n"), none("binary", "bloom"), "provider"))
    return entry, table.write("key_files", index), layout


def merge(table: Versions, state: dict) -> dict:
    """One version more if writes of `key_files` have piled up: what still counts of all of them becomes one, and keys that no row names are let go."""
    entries = state["tables"].get("key_files", [])
    if len(entries) < FAN:
        return state
    live = files(table, state)
    seq = F.lit(state["version"]).cast("bigint").alias("seq")
    one = table.write("key_files", live.select("bucket", seq, F.lit(False).alias("base"), "file", "n", "bloom", "provider"))
    held = {r.file for r in live.select("file").distinct().collect()}
    left = [e for e in state["tables"]["keys"] if e["write"] in held]
    return table.commit(state, tables=state["tables"] | {"key_files": [one], "keys": left})
