"""Tables whose content changes by whole versions: a commit record names the folders of each, and readers take the newest.

A write puts Parquet in a folder of its own, below one folder a provider, where nobody looks until a record names it. A record is
written aside and renamed into place under the next number, which fails if another writer was first. So whatever is cut off
before the rename leaves the version before, whole. Folders that no kept record names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

#: Entries of one tier that are merged into one of the next.
FAN = 16


class Conflict(RuntimeError):
    """Another writer has committed since the version that this change builds on."""


class Versions:
    """A folder of tables and `commits`. An entry is one write of a table: {write, parts, tier}, `parts` its provider folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        p, fs = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def state(self) -> dict:
        """The newest record; before the first one an empty version 0."""
        numbers = [int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and not n.startswith("_")]
        return self._record(max(numbers)) if numbers else {"version": 0, "tables": {}}

    def _record(self, number: int) -> dict:
        p, fs = self._at(f"commits/{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, table: str, df: DataFrame, *by: str, deep: bool = False) -> dict:
        """Writes rows aside, by provider and `by`; the entry for a record, whose parts are the folders of providers, or one level below if `deep`.

        Tasks move their files into place themselves (version 2 of the committer), since nobody looks there before a record names the folder.
        """
        name = uuid.uuid4().hex
        top = f"{table}/write={name}"
        df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("provider", *by).parquet(f"{self.path}/{top}")
        parts = [n for n in self._names(top) if n.startswith("provider=")]
        if deep:
            parts = [f"{p}/{n}" for p in parts for n in self._names(f"{top}/{p}") if "=" in n]
        return {"write": name, "parts": sorted(parts), "tier": 0}

    def commit(self, before: dict, **changes) -> dict:
        """The version after `before`, with these keys changed; raises Conflict if there is one already."""
        record = before | changes | {"version": before["version"] + 1, "at": time.time()}
        aside, fs = self._at(f"commits/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps(record).encode())
        out.close()
        to = self._at(f"commits/{record['version']:012d}.json")[0]
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kind[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(aside, to, kind)
        except Exception as x:
            fs.delete(aside, False)
            if fs.exists(to):
                raise Conflict(f"version {record['version']} is there already") from x
            raise
        return record

    def paths(self, table: str, entries: Iterable[dict]) -> list[str]:
        return [f"{self.path}/{table}/write={e['write']}/{p}" for e in entries for p in e["parts"]]

    def read(self, state: dict, table: str, schema: str, entries: list[dict] | None = None) -> DataFrame:
        """Rows of a table in a version; the folders of a provider and partition columns are pruned by filters."""
        paths = self.paths(table, state["tables"].get(table, []) if entries is None else entries)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, write string").option("basePath", f"{self.path}/{table}").parquet(*paths)
        return rows.drop("write")

    @staticmethod
    def without(state: dict, provider: str) -> dict[str, list[dict]]:
        """All tables' entries without a provider's folders."""
        left = lambda e: e | {"parts": [p for p in e["parts"] if unquote(p.split("/")[0].removeprefix("provider=")) != provider]}
        return {t: [x for e in entries if (x := left(e))["parts"]] for t, entries in state["tables"].items()}

    def merge_small(self, state: dict, table: str, schema: str, *by: str) -> dict:
        """One version more if `FAN` writes of a tier have piled up: they become one of the next tier, so rows are rewritten a logarithm of times."""
        entries = state["tables"].get(table, [])
        for tier in sorted({e["tier"] for e in entries}):
            some = [e for e in entries if e["tier"] == tier]
            if len(some) >= FAN:
                rows = self.read(state, table, schema, some).hint("rebalance", "provider", *by)
                one = self.write(table, rows, *by) | {"tier": tier + 1}
                left = [e for e in entries if e not in some]
                return self.commit(state, tables=state["tables"] | {table: [one, *left]})
        return state

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Removes records but for the newest `keep`, and folders that none of those names and that no writer can still be filling. Returns how many folders went."""
        numbers = sorted(int(n[:-5]) for n in self._names("commits") if n.endswith(".json") and not n.startswith("_"))
        kept = [self._record(n) for n in numbers[-keep:]]
        named = {(t, e["write"]) for r in kept for t, entries in r["tables"].items() for e in entries}
        for n in numbers[:-keep]:
            p, fs = self._at(f"commits/{n:012d}.json")
            fs.delete(p, False)
        gone, limit = 0, (time.time() - older_than) * 1000
        for table in self._names(""):
            for name in self._names(table) if table != "commits" else []:
                p, fs = self._at(f"{table}/{name}")
                if name.startswith("write=") and (table, name[6:]) not in named and fs.getFileStatus(p).getModificationTime() <= limit:
                    gone += fs.delete(p, True)
        return gone
