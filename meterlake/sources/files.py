"""Log files as DataFrames: lines, JSON documents, compressed lines, rows of embedded databases.

A root is (folder, label); the label goes before the relative path and so into every key. Files of up to
`MAX_BYTES` are kept whole in one row until their lines are numbered; files of lines over that are read in parts. A missing root is
an empty result. Documents, databases and compressed files over the cap, and those that can't be unpacked or opened, are reported by `errors`; a scan
goes on without them. `Roots` restricts a scan to files that changed.
"""

from __future__ import annotations

import io
import sqlite3
import tempfile
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a file is held in one row.
MAX_BYTES = 64 << 20
MAX_DEPTH = 8

Root = tuple[str, str | None]


class Roots(list):
    """Roots of which only the files of `only` (rel) are read; a plain list is read whole. `tagged`: jobs give a row with an `error` for each file that can't be read."""

    def __init__(self, roots: list[Root], only: DataFrame | None = None, tagged: bool = False):
        super().__init__(roots)
        self.only, self.tagged = only, tagged


def _exists(spark: SparkSession, folder: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _relative(spark: SparkSession, folder: str, label: str | None) -> Column:
    """Decoded path below the root, behind the label."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath().rstrip("/") + "/"
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rel = F.substring_index(plain, top, -1)
    return F.concat(F.lit(f"{label}/"), rel) if label else rel


#: What a store's name has more where changes wait that aren't in the store yet.
SIDECAR = r"(?<=\.db|\.vscdb)-wal$"


#: Files that can only be read whole; all others are files of lines.
WHOLE = r"(?i)\.(json|zstd|db|vscdb)(-wal)?$"


def _scan(spark: SparkSession, roots: list[Root], kind: str, pattern: str, depth: int, content: list[Column], schema: str, sizes: str = "size <= {cap}", sidecars: bool = False, parts_of: bool = False) -> DataFrame:
    """Files whose path matches, of the `sizes` named (by `size`, `cap` and `lines`, whether it is a file of lines).

    With `sidecars` those of stores too, under the store's own `rel`, with `sidecar` set. With `parts_of` the lines of files,
    with the file, the start of the block that a task reads, and a number that grows within the block.
    """
    parts = []
    for folder, label in roots:
        if not _exists(spark, folder):
            continue
        reader = spark.read.format(kind).option("recursiveFileLookup", "true")
        if kind == "text":
            reader = reader.option("lineSep", "\n") if parts_of else reader.option("wholetext", "true")
        rel = _relative(spark, folder, label)
        df = reader.load(folder).select(rel.alias("rel"), F.lit(label).alias("label"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), *content)
        if sidecars:
            df = df.withColumns({"sidecar": F.col("rel").rlike(SIDECAR), "rel": F.regexp_replace("rel", SIDECAR, "")})
        inside = F.size(F.split("rel", "/")) <= depth + (1 if label else 0)
        df = df.withColumn("lines", ~F.col("rel").rlike(WHOLE)).where(F.col("rel").rlike(pattern) & inside & F.expr(sizes.format(cap=MAX_BYTES))).drop("lines")
        parts.append(df.withColumn("at", F.monotonically_increasing_id()) if parts_of else df)  # before any shuffle
    if not parts:
        return spark.createDataFrame([], "rel string, label string, size bigint, mtime timestamp" + schema + (", sidecar boolean" if sidecars else "") + (", at bigint" if parts_of else ""))
    found, only = reduce(DataFrame.unionByName, parts), getattr(roots, "only", None)
    return found if only is None else found.join(only.select("rel"), "rel", "left_semi").select(found.columns)


def listing(spark: SparkSession, provider: str, roots: list[Root], pattern: str = r"(?i)\.jsonl$", depth: int = MAX_DEPTH) -> DataFrame:
    """provider, rel, mtime, size of the files, a store's with its sidecar's; contents aren't read."""
    found = _scan(spark, roots, "binaryFile", pattern, depth, [], "", "size <= {cap} or lines", sidecars=True)
    both = found.groupBy("rel").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"), F.min("sidecar").alias("alone")).where("not alone")
    return both.select(F.lit(provider).alias("provider"), "rel", "mtime", "size")


def snapshot(files: DataFrame) -> DataFrame:
    """provider and a fingerprint of its files: count, newest change, bytes."""
    parts = F.concat_ws(":", F.count("*"), F.coalesce(F.unix_micros(F.max("mtime")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)))
    return files.groupBy("provider").agg(parts.alias("fingerprint"))


def oversized(spark: SparkSession, provider: str, roots: list[Root], pattern: str = r"(?i)\.jsonl$", depth: int = MAX_DEPTH) -> DataFrame:
    """provider, rel, message of files that aren't read for their size."""
    files = _scan(spark, roots, "binaryFile", pattern, depth, [], "", "size > {cap} and not lines")
    return files.select(F.lit(provider).alias("provider"), "rel", F.concat(F.lit("file too large: "), F.col("size"), F.lit(" bytes")).alias("message"))


def contents(spark: SparkSession, roots: list[Root], pattern: str, depth: int = MAX_DEPTH) -> DataFrame:
    """rel, label, content of whole files."""
    return _scan(spark, roots, "binaryFile", pattern, depth, [F.col("content")], ", content binary").select("rel", "label", "content")


def stores(spark: SparkSession, roots: list[Root], pattern: str, depth: int = MAX_DEPTH) -> DataFrame:
    """rel, label, content, wal of database files: each store with the changes that its sidecar holds, if there is one."""
    found = _scan(spark, roots, "binaryFile", pattern, depth, [F.col("content")], ", content binary", sidecars=True)
    waiting = found.where("sidecar").select(F.col("rel").alias("of"), F.col("content").alias("wal"))
    return found.where("not sidecar").join(waiting, F.col("rel") == F.col("of"), "left").select("rel", "label", "content", "wal")


def errors(spark: SparkSession, provider: str, roots: list[Root], pattern: str = r"(?i)\.jsonl$", depth: int = MAX_DEPTH) -> DataFrame:
    """The error channel: provider, rel, message of files that are too large, or can't be unpacked or opened."""
    bad = unreadable(contents(spark, roots, rf"(?=.*\.(db|vscdb|zstd)$){pattern}", depth), provider)
    return oversized(spark, provider, roots, pattern, depth).union(bad)


def number_lines(files: DataFrame, text: str = "value") -> DataFrame:
    """rel, line_idx (from 0), line, raw_bytes; of a file with an `error` one empty line that holds it."""
    tags = [c for c in ("error",) if c in files.columns]
    return _filled(files.select("rel", *tags, F.posexplode(F.split(F.make_valid_utf8(text), "\n")).alias("line_idx", "line")))


def _filled(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))
    some = F.trim("line") != ""
    return lines.withColumn("raw_bytes", F.octet_length("line").cast("long")).where(some | F.col("error").isNotNull() if "error" in lines.columns else some)


def large_lines(spark: SparkSession, roots: list[Root], pattern: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Numbered lines of files of lines over `MAX_BYTES`, which tasks read in blocks: a line's place in its block behind the lines of the blocks before."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")]
    found = _scan(spark, roots, "text", pattern, depth, place, ", file string, block bigint, value string", "size > {cap} and lines", parts_of=True)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy("file", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    lines = found.withColumn("inside", inside).join(blocks, ["file", "block"])
    return _filled(lines.select("rel", (F.col("before") + F.col("inside")).alias("line_idx"), F.make_valid_utf8("value").alias("line")))


def json_lines(spark: SparkSession, roots: list[Root], pattern: str = r"(?i)\.jsonl$", depth: int = MAX_DEPTH) -> DataFrame:
    """Numbered lines of text files of any size."""
    small = number_lines(_scan(spark, roots, "text", pattern, depth, [F.col("value")], ", value string"))
    return small.unionByName(large_lines(spark, roots, pattern, depth))


def documents(spark: SparkSession, roots: list[Root], pattern: str = r"\.json$", depth: int = MAX_DEPTH) -> DataFrame:
    """rel, size, doc: whole JSON files."""
    return _scan(spark, roots, "text", pattern, depth, [F.col("value").alias("doc")], ", doc string")


def _unpack(rel: str, raw: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read() if rel.lower().endswith(".zstd") else raw


def _open(raw: bytes, wal: bytes | None = None) -> sqlite3.Connection:
    """A connection to the bytes of a database file, with the changes that wait in its sidecar; raises sqlite3.Error if they are none.

    Only a pair of files can be opened with its sidecar, so both lie in a folder of the task's own until they are copied to memory.
    """
    if wal:
        with tempfile.TemporaryDirectory() as folder:
            for name, held in (("store.db", raw), ("store.db-wal", wal)):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(held)
            pair, db = sqlite3.connect(f"{folder}/store.db"), sqlite3.connect(":memory:")
            try:
                pair.backup(db)
                db.execute("SELECT count(*) FROM sqlite_master")
            except sqlite3.Error:
                db.close()
                raise
            finally:
                pair.close()
        return db
    raw = bytearray(raw)
    if raw[18:20] == b"\x02\x02":
        raw[18:20] = b"\x01\x01"  # write-ahead mode: read the file alone
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(bytes(raw))
        db.execute("SELECT count(*) FROM sqlite_master")
    except (sqlite3.Error, ValueError, OverflowError) as x:
        db.close()
        raise sqlite3.DatabaseError(str(x)) from x
    return db


def unreadable(files: DataFrame, provider: str) -> DataFrame:
    """provider, rel, message of compressed files and databases (rel, content) that can't be read."""

    def look(batches):
        for batch in batches:
            bad = []
            for rel, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    _unpack(rel, raw) if rel.lower().endswith(".zstd") else _open(raw).close()
                except (OSError, pa.ArrowInvalid, sqlite3.Error) as x:
                    bad.append((rel, f"unreadable: {x}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in bad], pa.string()), pa.array([x[1] for x in bad], pa.string())], names=["rel", "message"])

    found = files.select("rel", "content").mapInArrow(look, "rel string, message string")
    return found.select(F.lit(provider).alias("provider"), "rel", "message")


def compressed_lines(spark: SparkSession, roots: list[Root], pattern: str = r"(?i)\.jsonl(\.zstd)?$", depth: int = MAX_DEPTH, files: DataFrame | None = None) -> DataFrame:
    """Numbered lines of plain files of any size or zstd-compressed ones (rel, content), one file at a time in a task; those that can't be unpacked give none, or a row with an `error` if `roots` are tagged."""
    large = large_lines(spark, roots, pattern, depth) if files is None else None
    files, tagged = contents(spark, roots, pattern, depth) if files is None else files, getattr(roots, "tagged", False)

    def unpack(batches):
        for batch in batches:
            for rel, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, error = "", None
                try:
                    text = _unpack(rel, raw).decode("utf-8", "replace")
                except (OSError, pa.ArrowInvalid) as x:
                    error = f"unreadable: {x}"
                if tagged or error is None:
                    yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["rel", "value", "error"])

    rows = files.select("rel", "content").mapInArrow(unpack, "rel string, value string, error string")
    lines = number_lines(rows if tagged else rows.drop("error"))
    return lines if large is None else lines.unionByName(large, allowMissingColumns=True)


def database_rows(spark: SparkSession, roots: list[Root], pattern: str, sql: str | tuple[str, ...], schema: str, depth: int = MAX_DEPTH, files: DataFrame | None = None) -> DataFrame:
    """rel, label and the rows of a query on each SQLite file (rel, label, content, and wal where there is a sidecar).

    Of several queries the first that a file's tables and columns allow is asked; files that allow none, or aren't
    databases, give no rows. If `roots` are tagged, a file that is no database gives one row with its `error`.
    """
    files, tagged = stores(spark, roots, pattern, depth) if files is None else files, getattr(roots, "tagged", False)
    if "wal" not in files.columns:
        files = files.withColumn("wal", F.lit(None).cast("binary"))
    names = [c.strip().split()[0] for c in schema.split(",")]
    queries = (sql,) if isinstance(sql, str) else sql

    def ask(raw: bytes, wal: bytes | None) -> tuple[list[tuple], str | None]:
        try:
            db = _open(raw, wal)
        except sqlite3.Error as x:
            return [], f"unreadable: {x}"
        try:
            for q in queries:
                try:
                    return db.execute(q).fetchall(), None
                except sqlite3.Error:
                    continue
            return [], None
        finally:
            db.close()

    def read(frame):
        found = []
        for rel, label, raw, wal in zip(frame.rel, frame.label, frame.content, frame.wal):
            rows, error = ask(raw, wal)
            if error is not None:
                rows = [(None,) * len(names)] if tagged else []
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out.insert(0, "label", label)
            out.insert(0, "rel", rel)
            out["error"] = error
            found.append(out)
        return pd.concat(found)

    # A group a file: in batches of rows a worker would hold thousands of stores at once.
    rows = files.select("rel", "label", "content", "wal").groupBy("rel").applyInPandas(read, f"rel string, label string, {schema}, error string")
    return rows if tagged else rows.drop("error")


def sqlite_bytes(statements: list[str]) -> bytes:
    """A small database file, for tests."""
    db = sqlite3.connect(":memory:")
    for s in statements:
        db.execute(s)
    db.commit()
    out = io.BytesIO(db.serialize()).getvalue()
    db.close()
    return out
