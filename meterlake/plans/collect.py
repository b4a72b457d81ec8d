"""The ingest job: of each tool's files those that changed are read, priced, appended without duplicates and noted."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import price
from ..operators.store import UsageStore
from ..schema import USAGE
from ..sources import files, ingest
from ..sources.files import Root, Roots
from ..sources.paths import remove_folder, work_folder


@contextmanager
def reading(patterns: dict[str, tuple[str, int]], jobs: dict):
    """Within it the jobs named read files of other patterns, by jobs of their own."""
    before = {p: (ingest.FILES[p], ingest.JOBS[p]) for p in patterns}
    ingest.FILES.update(patterns)
    ingest.JOBS.update(jobs)
    try:
        yield
    finally:
        for p, (pattern, job) in before.items():
            ingest.FILES[p], ingest.JOBS[p] = pattern, job


def collect(spark: SparkSession, store: UsageStore, roots: dict[str, list[Root]], run_ts: datetime, scan_id: int, enabled: list[str] | None = None, prices: DataFrame | None = None) -> DataFrame:
    """One scan; returns its log: provider, found, inserted, skipped (a provider whose files are as before has no row).

    A tool whose files' fingerprint is that of its last scan is left out. Of the others the changed files, listed once, are read
    once: jobs give usage rows and, of files that can't be read, rows with an error, all written in one pass and split then. Such files are not
    noted as seen, so they are tried again. One batch goes through pricing and the deduplicated append, which takes file
    states, errors and the log along. What was written for the scan is deleted. The loop is over tools, a dozen at most.
    """
    names = [p for p in ingest.JOBS if roots.get(p) and (enabled is None or p in enabled)]
    before = {r.provider: r.fingerprint for r in store.last_fingerprints().collect()}
    none = store.scan_log().where(F.lit(False))
    if not names:
        return none
    top = work_folder(spark, "scan")
    try:
        found = reduce(DataFrame.unionByName, [files.listing(spark, p, roots[p], *ingest.FILES[p]) for p in names])
        found = _written(found, f"{top}/listing")
        now = {r.provider: r.fingerprint for r in files.snapshot(found).collect()}
        names = [p for p in names if p in now and now[p] != before.get(p)]
        if not names:
            return none
        changed = _written(store.changed(found.where(F.col("provider").isin(names))), f"{top}/changed")
        parts = [spark.createDataFrame([], PARSED)]
        for p in names:
            some = Roots(roots[p], only=changed.where(F.col("provider") == p), tagged=True)
            if p == "workbuddy":  # ledger totals of sessions that no row covers, stored or read now
                stored = store.usage().where("provider = 'workbuddy'").select("session_id")
                parts += [ingest.workbuddy(spark, some, run_ts), ingest.workbuddy_ledger(spark, some, run_ts, stored).withColumn("ledger", F.lit(True))]
            else:
                parts.append(ingest.JOBS[p](spark, some, run_ts))
        parsed = _written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), f"{top}/parsed")
        rows = parsed.where("error is null")
        if "workbuddy" in names:
            logged = rows.where("provider = 'workbuddy' and ledger is null").select("session_id").distinct()
            rows = rows.where("ledger is null").unionByName(rows.where("ledger").join(logged, "session_id", "left_anti").select(rows.columns))
        large = reduce(DataFrame.union, [files.oversized(spark, p, roots[p], *ingest.FILES[p]) for p in names])
        errors = _written(parsed.where("error is not null").select("provider", "rel", F.col("error").alias("message")).distinct().union(large), f"{top}/errors")
        seen = changed.join(errors.select("provider", "rel"), ["provider", "rel"], "left_anti").select("provider", "rel", "mtime", "size")
        failed = {r.provider for r in errors.select("provider").distinct().collect()}
        # A tool with a failed file keeps no fingerprint, so the next scan looks at it again.
        state = spark.createDataFrame([(p, "" if p in failed else now[p]) for p in names], "provider string, fingerprint string")
        store.append(price(rows.drop("rel", "error", "ledger"), prices), files=seen, scan_id=scan_id, fingerprints=state, errors=errors)
    finally:
        remove_folder(spark, top)
    return store.scan_log().where(F.col("scan_id") == scan_id)


#: Usage rows and errors as jobs give them.
PARSED = USAGE + ", ord bigint, rel string, error string, ledger boolean"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
