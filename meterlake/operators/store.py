"""The stored usage table: Parquet by provider and day, appended without duplicates, with scan state, changed by whole versions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.pricing import price
from ..schema import USAGE
from . import keys, rollups
from .aggregate import rollup
from .versions import Conflict, Versions

KEY = ("provider", "fingerprint")
COLUMNS = [c.strip().split()[0] for c in USAGE.split(",")]
#: Columns that say which of equal keys is first; `ord`, where a batch has it, is a row's place in its sources.
ORDER = ("ord", "started_at", "session_id")
#: Keys that a bucket of a new store holds on average before buckets are split; a store keeps the number it began with.
CAPACITY = 1 << 16
#: Times that a change is made anew if another writer was first.
TRIES = 3


def first_of_each(batch: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row a fingerprint: the first by `order` columns that the batch has, then by all others."""
    return _first_hashed(batch, key, order).drop(HASH)


#: Hash of a row's key, sorted by first: keys have long beginnings in common, which a sort would compare over and over.
HASH = "hash of the key"


def _first_hashed(batch: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    rest = [c for c in batch.columns if c not in (*key, *order)]
    w = Window.partitionBy(HASH, *key).orderBy(*[c for c in order if c in batch.columns], *rest)
    return batch.withColumn(HASH, F.xxhash64(*key)).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def new_rows(batch: DataFrame, stored: DataFrame, global_key: bool = False, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows of the batch whose fingerprint isn't stored; first writer wins, inside the batch too."""
    key = ("fingerprint",) if global_key else KEY
    return _first_hashed(batch, key, order).join(stored.select(*key, F.xxhash64(*key).alias(HASH)), [HASH, *key], "left_anti").select(batch.columns)


def duplicates(usage: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return usage.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def projects(usage: DataFrame) -> DataFrame:
    """name, providers: which tools have used each project."""
    return usage.groupBy(F.col("project").alias("name")).agg(F.sort_array(F.collect_set("provider")).alias("providers"))


class UsageStore:
    """A folder with `usage` (by provider and day), its keys, its rollups, `file_state`, `scan_log` and `scan_errors`.

    Each change is one version: a scan's rows, keys, sums, file states, errors and log appear together or not at all, and so do a
    deletion and a new pricing. What a cut-off change has written is never read; `vacuum` removes it. An append reads the key
    files that may hold its keys, not the history. A writer that finds another was first makes its change anew on the other's version.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path = spark, str(path).rstrip("/")
        self.table, self.capacity = Versions(spark, path), capacity

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.table.read(self.table.state(), name, schema)

    def usage(self) -> DataFrame:
        return self._read("usage", USAGE + ", day date")

    def rollup(self, name: str) -> DataFrame:
        """A stored rollup: provider, day, its dimensions and sums."""
        return self._read(name, rollups.schema(rollups.ROLLUPS[name]))

    def answer(self, *dims: str, window: calendar.Window | None = None, order: str = "cost_micros") -> DataFrame:
        """Sums by dimensions in a window, from the coarsest stored rollup that has them; the facts give what the window cuts off of days."""
        if rollups.covering(dims) is None:
            return rollup(self.usage(), *dims, window=window, order=order)
        return rollups.answer(self.usage(), {n: self.rollup(n) for n in rollups.ROLLUPS}, *dims, window=window, order=order)

    def model_counts(self) -> DataFrame:
        """provider and the number of its models, from a stored rollup."""
        return self.rollup("rollup_models").groupBy("provider").agg(F.countDistinct("model").alias("models"))

    def file_state(self) -> DataFrame:
        return self._read("file_state", "rel string, mtime timestamp, size bigint, scan_id bigint, provider string").select("provider", "rel", "mtime", "size", "scan_id")

    def scan_log(self) -> DataFrame:
        names = ("provider", "scan_id", "found", "inserted", "skipped", "fingerprint", "pricing_version")
        return self._read("scan_log", "scan_id bigint, found bigint, inserted bigint, skipped bigint, fingerprint string, pricing_version string, provider string").select(*names)

    def scan_errors(self) -> DataFrame:
        return self._read("scan_errors", "rel string, message string, scan_id bigint, provider string").select("provider", "rel", "message", "scan_id")

    def version(self) -> int:
        return self.table.state()["version"]

    def pricing_version(self) -> str:
        """Version of the prices that the stored costs follow."""
        return self.table.state().get("pricing", "1")

    def next_scan(self) -> int:
        """A scan number above all logged ones, for scans and streams that share a store."""
        return (self.scan_log().agg(F.max("scan_id")).first()[0] or 0) + 1

    def keys(self, batch: DataFrame | None = None, global_key: bool = False) -> DataFrame:
        """Stored (fingerprint, provider, bucket); for a batch those of the files that may hold its keys."""
        return keys.read(self.table, self.key_folders(batch, global_key))

    def key_folders(self, batch: DataFrame | None = None, global_key: bool = False, state: dict | None = None) -> list[str]:
        state = state or self.table.state()
        return keys.paths(self.table, state, keys.files(self.table, state) if batch is None else keys.asked_files(self.table, state, batch, global_key))

    def _changed(self, make) -> dict:
        """What `make(state)` gives, which writes and commits; anew if another writer was first."""
        for last in (*[False] * (TRIES - 1), True):
            try:
                return make(self.table.state())
            except Conflict:
                if last:
                    raise

    def insert(self, rows: DataFrame) -> int:
        """Plain append; refuses fingerprints that are stored already or repeat."""
        rows = rows.select(COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)

        def make(state: dict) -> int:
            stored = keys.read(self.table, self.key_folders(rows, state=state))
            if not duplicates(rows).isEmpty() or not rows.join(stored, list(KEY), "left_semi").isEmpty():
                raise ValueError("fingerprint exists already")
            changes, added = self._with_rows(state, rows)
            if added:
                self.table.commit(state, **changes)
            return sum(added.values())

        try:
            return self._changed(make)
        finally:
            rows.unpersist()

    def _with_rows(self, state: dict, rows: DataFrame) -> tuple[dict, dict[str, int]]:
        """Writes rows aside, once, and from what is written their keys and sums; what the record has to say of them, and their number by provider."""
        capacity = state.get("capacity", self.capacity)
        by_day = rows.select(COLUMNS).withColumn("day", calendar.day("started_at")).hint("rebalance", "provider", "day")
        entry = self.table.write("usage", by_day, "day")
        if not entry["parts"]:
            return {"tables": state["tables"]}, {}
        rows = self.table.read(state, "usage", USAGE + ", day date", [entry])
        added = {r.provider: r["count"] for r in rows.groupBy("provider").count().collect()}  # one row a provider
        in_keys, in_files, layout = keys.add(self.table, state, rows, added, capacity)
        tables = state["tables"]
        more = {n: [*tables.get(n, []), e] for n, e in (("usage", entry), ("keys", in_keys), ("key_files", in_files))}
        more |= {n: rollups.merged(self.table, state, n, dims, rollups.partial(rows, dims)) for n, dims in rollups.ROLLUPS.items()}
        return {"tables": tables | more, "layout": layout, "capacity": capacity}, added

    def append(
        self, batch: DataFrame, files: DataFrame | None = None, scan_id: int = 0, global_key: bool = False, fingerprints: DataFrame | None = None, errors: DataFrame | None = None,
        order: tuple[str, ...] = ORDER, stream: tuple[str, int] | None = None,
    ) -> dict[str, int]:
        """Deduplicated append of a priced batch with file states, errors and the log by provider, in one version. Returns the totals.

        Of rows that share a key the first by `order` counts.
        `fingerprints` (provider, fingerprint) are the states of the sources, for the log. `stream` (name, batch number): a batch that is
        not newer than the last one stored of that stream is a replay and changes nothing.
        """
        batch = batch.select(*COLUMNS, *[c for c in ("ord",) if c in batch.columns]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._changed(lambda state: self._appended(state, batch, files, scan_id, global_key, fingerprints, errors, order, stream))
        finally:
            batch.unpersist()

    def _appended(self, state, batch, files, scan_id, global_key, fingerprints, errors, order, stream) -> dict[str, int]:
        if stream and state.get("streams", {}).get(stream[0], -1) >= stream[1]:
            return {"found": 0, "inserted": 0, "skipped": 0}
        stored = keys.read(self.table, self.key_folders(batch, global_key, state))
        changes, added = self._with_rows(state, new_rows(batch, stored, global_key, order))
        counts = batch.groupBy("provider").agg(F.count("*").alias("found"))
        if fingerprints is not None:
            counts = counts.join(fingerprints.select("provider", "fingerprint"), "provider", "full")
        else:
            counts = counts.withColumn("fingerprint", F.lit(""))
        log = counts.select("provider", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint")).collect()  # one row a provider
        number = F.lit(scan_id).cast("bigint").alias("scan_id")
        noted = {}
        if files is not None:
            noted["file_state"] = files.select("provider", "rel", "mtime", "size", number)
        if errors is not None:
            noted["scan_errors"] = errors.select("provider", "rel", "message", number)
        version = state.get("pricing", "1")
        rows = [(r.provider, scan_id, r.found, added.get(r.provider, 0), r.found - added.get(r.provider, 0), r.fingerprint, version) for r in log]
        noted["scan_log"] = self.spark.createDataFrame(rows, self.scan_log().schema).coalesce(1)
        for name, df in noted.items():
            if (entry := self.table.write(name, df))["parts"]:
                changes["tables"] = changes["tables"] | {name: [*changes["tables"].get(name, []), entry]}
        if stream:
            changes["streams"] = state.get("streams", {}) | {stream[0]: stream[1]}
        self._merge(self.table.commit(state, **changes))
        found, inserted = sum(r.found for r in log), sum(added.values())
        return {"found": found, "inserted": inserted, "skipped": found - inserted}

    def _merge(self, state: dict) -> None:
        """Small writes that have piled up become larger ones; another writer's version puts that off."""
        try:
            state = self.table.merge_small(state, "usage", USAGE + ", day date", "day")
            state = self.table.merge_small(state, "file_state", "rel string, mtime timestamp, size bigint, scan_id bigint, provider string")
            state = self.table.merge_small(state, "scan_errors", "rel string, message string, scan_id bigint, provider string")
            state = self.table.merge_small(state, "scan_log", "scan_id bigint, found bigint, inserted bigint, skipped bigint, fingerprint string, pricing_version string, provider string")
            keys.merge(self.table, state)
        except Conflict:
            pass

    def last_fingerprints(self) -> DataFrame:
        """provider, fingerprint: the state of each provider's files at its last logged scan."""
        latest = self.scan_log().where("fingerprint <> ''").groupBy("provider").agg(F.max_by("fingerprint", "scan_id").alias("fingerprint"))
        return latest

    def changed(self, listing: DataFrame) -> DataFrame:
        """Files whose (mtime, size) differs from the last state written for them."""
        latest = Window.partitionBy("provider", "rel").orderBy(F.desc("scan_id"), F.desc("mtime"))
        known = self.file_state().withColumn("k", F.row_number().over(latest)).where("k = 1").select("provider", "rel", "mtime", "size")
        return listing.join(known, ["provider", "rel", "mtime", "size"], "left_anti")

    def reprice(self, version: str, prices: DataFrame | None = None) -> bool:
        """Costs of all history anew if `version` isn't the stored one; idempotent. True if it ran."""

        def make(state: dict) -> bool:
            if version == state.get("pricing", "1"):
                return False
            tables = state["tables"]
            if tables.get("usage"):
                rows = self.table.read(state, "usage", USAGE + ", day date").drop("day")
                dealt = price(rows, prices).withColumn("day", calendar.day("started_at")).hint("rebalance", "provider", "day")
                entry = self.table.write("usage", dealt, "day") | {"tier": max(e["tier"] for e in tables["usage"])}
                now = self.table.read(state, "usage", USAGE + ", day date", [entry])
                folders = now.select("provider", "day").distinct().count()
                sums = {n: [self.table.write(n, rollups.dealt(rollups.partial(now, dims), folders), "day", deep=True)] for n, dims in rollups.ROLLUPS.items()}
                tables = tables | {"usage": [entry]} | sums
            self.table.commit(state, tables=tables, pricing=version)
            return True

        return self._changed(make)

    def delete_provider(self, provider: str) -> None:
        """Drop a provider's rows, keys, file states and log, in one version that no longer names its folders; its files count as unseen again."""
        self._changed(lambda state: self.table.commit(state, tables=Versions.without(state, provider), layout={p: x for p, x in state.get("layout", {}).items() if p != provider}))

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Removes what only older versions or cut-off changes hold."""
        return self.table.vacuum(keep, older_than)
