"""Structured Streaming over usage: deduplicated ingest, daily rollup, touched-partition refresh."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import calendar
from ..functions.pricing import price
from ..operators.aggregate import stats, with_total
from ..operators.rollups import RollupTable
from ..operators.store import UsageStore
from ..sources.files import number_lines
from ..sources.ingest import codex
from .file_state import lines_with_state

Job = Callable[[SparkSession, list, datetime, DataFrame], DataFrame]

FLOOR_SECONDS = 5
DEFAULT_SECONDS = 300


def trigger(seconds: int | None = DEFAULT_SECONDS) -> dict[str, str | bool]:
    """Options of a periodic rescan (at least every 5 s), or of one catch-up run for None."""
    return {"availableNow": True} if seconds is None else {"processingTime": f"{max(FLOOR_SECONDS, seconds)} seconds"}


def daily_rollup(stream: DataFrame, *dims: str, late: str | None = None) -> DataFrame:
    """Sums by day of the calendar and dimensions. Without `late` any record counts, whatever its age."""
    s = stream.withColumn("at", F.to_timestamp(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    s = s.withWatermark("at", late) if late else s
    window = F.window("at", "1 day", startTime=f"{24 - calendar.OFFSET_HOURS} hours")
    out = s.groupBy(window.alias("w"), *dims).agg(*stats())
    return with_total(out.select(F.date_add(F.col("w.start").cast("date"), 1).alias("day"), *[c for c in out.columns if c != "w"]))


def ingest(stream: DataFrame, store: UsageStore, checkpoint: str, make_batch: Callable[[DataFrame], DataFrame] = lambda df: df, seconds: int | None = None) -> StreamingQuery:
    """Each micro-batch through the store's deduplicated append: keys are never forgotten, late rows count, a batch that is replayed does not."""

    def write(df: DataFrame, batch_id: int) -> None:
        store.append(make_batch(df), scan_id=store.next_scan(), stream=(checkpoint, batch_id))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()


def log_files(spark: SparkSession, folder: str, suffix: str = r"\.jsonl$") -> DataFrame:
    """A stream of whole log files: (rel, value), a row for each file that arrives."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return files.select(F.substring_index(name, f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1).alias("rel"), "value").where(F.col("rel").rlike(suffix))


def ingest_logs(files: DataFrame, job: Job, store: UsageStore, checkpoint: str, run_ts: datetime, seconds: int | None = None) -> StreamingQuery:
    """Files of a log stream through a tool's job, pricing and the deduplicated append, file by file as they arrive.

    A file that is replaced under a new name is read again whole; what was stored of it is skipped.
    """
    make = lambda df: price(job(df.sparkSession, [], run_ts, number_lines(df)))
    return ingest(files, store, checkpoint, make, seconds)


def ingest_changes(changes: DataFrame, provider: str, job: Job, store: UsageStore, checkpoint: str, run_ts: datetime, seconds: int | None = None) -> StreamingQuery:
    """A `file_changes` stream of whole files through a tool's job: a file that grows under its name is read once more and its stored rows are skipped.

    File states go with the rows; files that are gone are noted among the errors, and their rows stay.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        there = df.where("kind <> 'remove'")
        rows = job(df.sparkSession, [], run_ts, number_lines(there.select("rel", F.make_valid_utf8(F.col("value").cast("string")).alias("value"))))
        seen = there.select(F.lit(provider).alias("provider"), "rel", F.timestamp_micros("mtime_micros").alias("mtime"), "size")
        gone = df.where("kind = 'remove'").select(F.lit(provider).alias("provider"), "rel", F.lit("removed").alias("message"))
        store.append(price(rows), files=seen, errors=gone, scan_id=store.next_scan(), stream=(checkpoint, batch_id))
        df.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()


def ingest_pieces(changes: DataFrame, store: UsageStore, checkpoint: str, run_ts: datetime, seconds: int | None = None) -> StreamingQuery:
    """Rollout files as a `file_changes` stream with `tail`: only what they have grown by is read, with the state of each file kept by the stream."""
    return ingest(lines_with_state(changes), store, checkpoint, lambda df: price(codex(df.sparkSession, [], run_ts, df)), seconds)


def rollup_table(stream: DataFrame, path: str, checkpoint: str, *dims: str, seconds: int | None = None) -> StreamingQuery:
    """A stored rollup by provider, day and `dims`: each batch is merged into the days that it touches, once, however late its rows are. `latest` reads it."""
    rows = RollupTable(stream.sparkSession, path, *dims)
    return stream.writeStream.foreachBatch(lambda df, n: rows.add(df, ("stream", n)) and None).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()


def latest(spark: SparkSession, path: str, *dims: str) -> DataFrame:
    """The stored rollup with totals."""
    return with_total(RollupTable(spark, path, *dims).rows())


def bounded_dedup(stream: DataFrame, late: str) -> DataFrame:
    """Duplicates within a time bound only, with state that is dropped after it."""
    s = stream.withColumn("at", F.to_timestamp(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return s.withWatermark("at", late).dropDuplicatesWithinWatermark(["provider", "fingerprint"]).drop("at")


def refresh_touched(usage: DataFrame, batch: DataFrame, rollup: DataFrame) -> DataFrame:
    """A stored rollup by (provider, day) after a batch: only the touched keys are computed anew.

    The rows carry their batch's order through the caller's version, so stale results can be told apart.
    """
    touched = batch.select("provider", calendar.day("started_at").alias("day")).distinct()
    fresh = with_total(usage.withColumn("day", calendar.day("started_at")).join(touched, ["provider", "day"], "left_semi").groupBy("provider", "day").agg(*stats()))
    return rollup.join(touched, ["provider", "day"], "left_anti").unionByName(fresh)
