"""Stored rollups of usage: sums by provider, day and more dimensions, kept by merging what a batch adds.

A batch's rows become partial sums; only the (provider, day) folders that these touch are written anew, with the old sums of those
days added, and a new version names them in place of the old ones. Questions whose dimensions a rollup covers are answered from its days; the
facts give only what a window cuts off of its first and last day.
"""

from __future__ import annotations

from datetime import timedelta
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from .aggregate import STATS, merge, rollup, stats
from .versions import Conflict, Versions

#: Rollups that a usage store keeps, with their dimensions beside provider and day.
ROLLUPS = {"rollup_models": ("model",), "rollup_projects": ("project",)}
#: Times that a merge is made anew if another writer was first.
TRIES = 3


def schema(dims: tuple[str, ...]) -> str:
    return ", ".join([*[f"{d} string" for d in dims], *[f"{c} bigint" for c in STATS], "provider string", "day date"])


def partial(usage: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Sums of rows by provider, day and `dims`."""
    return usage.groupBy("provider", calendar.day("started_at").alias("day"), *dims).agg(*stats())


def dealt(sums: DataFrame, folders: int) -> DataFrame:
    """Sums for a write by provider and day: small as they are, each folder costs a file, so that all tasks share the folders."""
    return sums.repartition(max(1, min(folders, int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "provider", "day")


def merged(table: Versions, state: dict, name: str, dims: tuple[str, ...], added: DataFrame) -> list[dict]:
    """Writes the sums of the days that `added` touches, old and new; the rollup's entries with these in place of the old ones. The touched days come to the driver."""
    added = added.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touched = {(r.provider, str(r.day)) for r in added.select("provider", "day").distinct().collect()}
        entries = state["tables"].get(name, [])
        if not touched:
            return entries

        def is_touched(part: str) -> bool:
            provider, day = part.split("/")
            return (unquote(provider.removeprefix("provider=")), day.removeprefix("day=")) in touched

        old, left = [], []
        for e in entries:
            parts = {True: [], False: []}
            for p in e["parts"]:
                parts[is_touched(p)].append(p)
            old += [e | {"parts": parts[True]}] if parts[True] else []
            left += [e | {"parts": parts[False]}] if parts[False] else []
        before = table.read(state, name, schema(dims), old)
        sums = before.unionByName(added.select(before.columns)).groupBy("provider", "day", *dims).agg(*[F.sum(c).alias(c) for c in STATS])
        return [table.write(name, dealt(sums, len(touched)), "day", deep=True), *left]
    finally:
        added.unpersist()


class RollupTable:
    """A rollup on its own, fed by the batches of a stream: each counts once, and one older than the last is refused."""

    def __init__(self, spark: SparkSession, path: str, *dims: str):
        self.spark, self.dims = spark, tuple(d for d in dims if d != "provider")
        self.table = Versions(spark, path)

    def rows(self) -> DataFrame:
        """provider, day, dimensions and sums."""
        return self.table.read(self.table.state(), "rollup", schema(self.dims))

    def add(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """Merges a batch of usage; False if a stream's batch isn't newer than its last one."""
        for k in range(TRIES):
            state = self.table.state()
            done = state.get("streams", {})
            if stream and done.get(stream[0], -1) >= stream[1]:
                return False
            entries = merged(self.table, state, "rollup", self.dims, partial(batch, self.dims))
            try:
                self.table.commit(state, tables=state["tables"] | {"rollup": entries}, streams=done | ({stream[0]: stream[1]} if stream else {}))
                return True
            except Conflict:
                if k == TRIES - 1:
                    raise


def covering(dims: tuple[str, ...], rollups: dict[str, tuple[str, ...]] = ROLLUPS) -> str | None:
    """The stored rollup with the fewest dimensions that has all of `dims`; days make weeks and months."""
    need = set(dims) - {"provider", "day", "week", "month"}
    return min((n for n, d in rollups.items() if need <= set(d)), key=lambda n: len(rollups[n]), default=None)


def answer(facts: DataFrame, stored: dict[str, DataFrame], *dims: str, window: calendar.Window | None = None, order: str = "cost_micros", rollups: dict[str, tuple[str, ...]] = ROLLUPS) -> DataFrame:
    """What `rollup(facts, *dims, window=window, order=order)` gives, from a stored rollup where one covers the dimensions.

    Whole days of the window come from the rollup, the rest of its first and last day from `facts` (whose `day` column prunes the scan).
    """
    name = covering(dims, rollups)
    if name is None:
        return rollup(facts, *dims, window=window, order=order)
    sums, edges = stored[name], []
    if window is not None:
        begins = lambda d: calendar.custom(d, d)[0]
        day_of = lambda t: (t + timedelta(hours=calendar.OFFSET_HOURS)).date()
        start, end = window
        first = day_of(start) if begins(day_of(start)) == start else day_of(start) + timedelta(days=1)
        last = day_of(end)  # the first day behind the whole ones
        if first >= last:
            return rollup(facts, *dims, window=window, order=order)
        sums = sums.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(last)))
        edges = [w for w in ((start, begins(first)), (begins(last), end)) if w[0] < w[1]]
    # Keys of a day are those of any of its instants, such as noon.
    noon = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {12 - calendar.OFFSET_HOURS} HOURS")
    keys = {"day": calendar.day_key, "week": calendar.week_key, "month": calendar.month_key}
    pieces = sums.select(*[keys[d](noon).alias(d) if d in keys else F.col(d) for d in dims], *STATS)
    for w in edges:
        pieces = pieces.unionByName(rollup(facts, *dims, window=w).select(*dims, *STATS))
    out = merge(pieces, *dims)
    return out.orderBy(F.desc(order), *dims) if dims else out
