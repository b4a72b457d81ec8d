"""The store: versions that appear whole, keys in growing buckets, first writers."""

import os
import re
import shutil
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterlake.operators import keys, store, versions
from meterlake.schema import USAGE

NAMES = [c.strip().split()[0] for c in USAGE.split(",")]


def usage(spark, rows):
    base = {"provider": "claude", "project": "p", "session_id": "s", "model": "claude-opus-4-8", "started_at": datetime(2026, 8, 14), "input_tokens": 1, "output_tokens": 0, "cache_read_tokens": 0, "cache_write_tokens": 0, "cost_micros": 0, "raw_bytes": 0}
    full = [base | {"fingerprint": f"f{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], USAGE)


def many(spark, lo, hi, provider="claude"):
    return spark.range(lo, hi).selectExpr(
        f"'{provider}' AS provider", "'p' AS project", "'s' AS session_id", "'claude-opus-4-8' AS model", "TIMESTAMP_NTZ '2026-08-14 00:00:00' AS started_at", "id AS input_tokens", "0L AS output_tokens",
        "0L AS cache_read_tokens", "0L AS cache_write_tokens", "0L AS cost_micros", "0L AS raw_bytes", "concat('f', id) AS fingerprint",
    )


def content(t):
    return (
        sorted((r.provider, r.fingerprint, r.cost_micros) for r in t.usage().collect()), sorted((r.provider, r.fingerprint) for r in t.keys().collect()),
        sorted((r.provider, r.rel) for r in t.file_state().collect()), sorted((r.provider, r.scan_id) for r in t.scan_log().collect()), t.pricing_version(),
    )


class Cut(Exception):
    pass


def cut_after(monkeypatch, n):
    """The n-th step from now on, a write or a commit, is done and then all stops. None: the last before is cut aside the rename."""
    left = [n]
    write, commit = versions.Versions.write, versions.Versions.commit

    def then(f):
        def run(*a, **b):
            out = f(*a, **b)
            left[0] -= 1
            if not left[0]:
                raise Cut
            return out

        return run

    monkeypatch.setattr(versions.Versions, "write", then(write))
    monkeypatch.setattr(versions.Versions, "commit", then(commit))


def files(spark, *rels):
    return spark.createDataFrame([(p, r, datetime(2026, 1, 1), 3) for p, r in rels], "provider string, rel string, mtime timestamp, size bigint")


@pytest.mark.parametrize("change", ["append", "delete", "reprice"])
def test_cut_off_after_every_step(spark, tmp_path, change):
    rows = usage(spark, [{}, {}, {"provider": "pi"}, {"provider": "pi"}, {}, {"provider": "codex"}]).persist()
    first, errors = rows.where("fingerprint < 'f4'"), files(spark, ("pi", "bad")).select("provider", "rel", F.lit("m").alias("message"))
    changes = {
        "append": lambda t: t.append(rows, files=files(spark, ("claude", "b"), ("codex", "c")), scan_id=2, errors=errors),
        "delete": lambda t: t.delete_provider("pi"),
        "reprice": lambda t: t.reprice("2"),
    }
    run = changes[change]
    start = store.UsageStore(spark, str(tmp_path / "start"), capacity=2)
    start.append(first, files=files(spark, ("claude", "a"), ("pi", "a")), scan_id=1)
    before = content(start)
    copy = lambda name: store.UsageStore(spark, shutil.copytree(tmp_path / "start", tmp_path / name), capacity=1)
    run(other := copy("whole"))
    assert (whole := content(other)) != before
    for n in range(1, 20):
        t = copy(path := f"cut{n}")
        path = str(tmp_path / path)
        with pytest.MonkeyPatch.context() as m:
            cut_after(m, n)
            try:
                run(t)
                done = True
            except Cut:
                done = False
        after = content(store.UsageStore(spark, path))
        assert after in (before, whole)
        if after == before and not done and n % 4 == 1:  # made anew, it gives what it should
            run(store.UsageStore(spark, path))
            assert content(store.UsageStore(spark, path)) == whole
        if change == "delete" and not done:  # a scan after the cut brings the rows back, none twice
            again = store.UsageStore(spark, path)
            again.append(first, scan_id=3)
            assert [x[:2] for x in content(again)[0]] == [x[:2] for x in before[0]] and content(again)[1] == before[1]
        if done:
            break
    assert n == {"append": 10, "delete": 2, "reprice": 5}[change]  # eight writes and a commit, and so on
    rows.unpersist()


def test_another_capacity_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    a = store.UsageStore(spark, path, capacity=4)
    assert a.append(many(spark, 0, 40), scan_id=1)["inserted"] == 40
    for capacity in (1, 64, 1000):
        b = store.UsageStore(spark, path, capacity=capacity)
        assert b.append(many(spark, 0, 44), scan_id=2)["inserted"] == (4 if capacity == 1 else 0)
        with pytest.raises(ValueError):
            b.insert(many(spark, 43, 45))
    assert a.usage().count() == 44 and a.keys().count() == 44
    assert a.insert(many(spark, 44, 50)) == 6 and a.append(many(spark, 40, 51), scan_id=3)["inserted"] == 1


def test_linear_hashing():
    """Growing step by step or at once gives the same buckets, and only split buckets lose keys."""
    where = lambda h, n: b if (b := h % (2 << (n.bit_length() - 1))) < n else b - (1 << (n.bit_length() - 1))
    for before, after in ((1, 2), (1, 7), (3, 4), (5, 6), (6, 13), (8, 64)):
        moved = {where(h, before) for h in range(500) if where(h, before) != where(h, after)}
        assert moved == keys.split_by(before, after)
        assert {where(h, after) for h in range(500)} == set(range(after))


def test_a_small_batch_reads_few_keys(spark, tmp_path):
    t = store.UsageStore(spark, str(tmp_path / "t"), capacity=500)
    t.append(many(spark, 0, 60_000), scan_id=1)
    t.append(many(spark, 60_000, 100_000), scan_id=2)
    size = lambda folders: sum(p.stat().st_size for f in folders for p in Path(f.removeprefix("file:")).glob("*.parquet"))
    everything = size(t.key_folders())
    new, old = t.key_folders(many(spark, 200_000, 200_100)), t.key_folders(many(spark, 500, 510))
    assert size(new) < everything / 50 and 0 < size(old) < everything / 10
    assert t.append(many(spark, 99_990, 100_090), scan_id=3) == {"found": 100, "inserted": 90, "skipped": 10}
    assert t.usage().count() == t.keys().count() == 100_090
    assert t.keys().groupBy("fingerprint").count().where("count > 1").isEmpty()


def test_many_small_appends(spark, tmp_path, monkeypatch):
    """Writes are merged by tiers and buckets by files; nothing is lost or doubled."""
    monkeypatch.setattr(versions, "FAN", 3)
    monkeypatch.setattr(keys, "FAN", 3)
    monkeypatch.setattr(keys, "MOST_FILES", 3)
    t = store.UsageStore(spark, str(tmp_path / "t"), capacity=20)
    for k in range(8 + 1):
        p = "pi" if k % 3 == 2 else "claude"
        assert t.append(many(spark, 5 * k, 5 * k + 8, p), files=files(spark, (p, f"r{k}")), scan_id=k)["found"] == 8
    assert t.usage().groupBy("provider").count().orderBy("provider").collect() == [("claude", 39), ("pi", 24)]
    assert t.keys().count() == 63 and t.file_state().count() == 9 and t.scan_log().count() == 9
    state = t.table.state()
    assert all(len(e) <= 6 for n, e in state["tables"].items() if n != "keys")
    t.delete_provider("pi")
    assert t.append(many(spark, 0, 50, "pi"), scan_id=20)["inserted"] == 50 and t.append(many(spark, 0, 43), scan_id=21)["inserted"] == 4  # 13, 14, 28 and 29
    before = content(t)
    assert t.vacuum(keep=1, older_than=-60) > 0
    assert content(t) == before and len(os.listdir(tmp_path / "t" / "commits")) <= 2 + sum(n.startswith(".") for n in os.listdir(tmp_path / "t" / "commits"))


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = store.UsageStore(spark, path), store.UsageStore(spark, path)
    a.append(many(spark, 0, 5), scan_id=1)
    state = b.table.state()
    a.append(many(spark, 5, 7), scan_id=2)
    with pytest.raises(versions.Conflict):
        b.table.commit(state, pricing="9")
    stale = [state]
    now = b.table.state
    monkeypatch.setattr(b.table, "state", lambda: stale.pop() if stale else now())
    assert b.append(many(spark, 4, 9), scan_id=3) == {"found": 5, "inserted": 2, "skipped": 3}  # made anew on the other's version
    assert a.usage().count() == 9 and a.next_scan() == 4


def test_replayed_stream_batch(spark, tmp_path):
    t = store.UsageStore(spark, str(tmp_path / "t"))
    assert t.append(many(spark, 0, 5), stream=("s", 0))["inserted"] == 5
    v = t.version()
    assert t.append(many(spark, 0, 9), stream=("s", 0))["found"] == 0 and t.version() == v
    assert t.append(many(spark, 0, 9), stream=("other", 0))["inserted"] == 4 and t.append(many(spark, 8, 10), stream=("s", 1))["inserted"] == 1


def test_first_writer(spark, tmp_path):
    """Copies that differ in counts: the first in the order of the sources stays, also where it isn't the smaller."""
    rows = usage(spark, [{"fingerprint": "a", "input_tokens": 9}, {"fingerprint": "a", "input_tokens": 2}, {"fingerprint": "b", "input_tokens": 1}, {"fingerprint": "b", "input_tokens": 7}])
    rows = rows.withColumn("ord", F.expr("CASE WHEN input_tokens IN (9, 7) THEN 0L ELSE 1L END"))
    t = store.UsageStore(spark, str(tmp_path / "t"))
    t.append(rows, scan_id=1)
    assert sorted((r.fingerprint, r.input_tokens) for r in t.usage().collect()) == [("a", 9), ("b", 7)]


def test_global_keys(spark, tmp_path):
    t = store.UsageStore(spark, str(tmp_path / "t"), capacity=3)
    t.append(many(spark, 0, 20), scan_id=1)
    assert t.append(many(spark, 10, 25, "pi"), scan_id=2, global_key=True)["inserted"] == 5
    assert t.append(many(spark, 10, 25, "pi"), scan_id=3)["inserted"] == 10


def by_day(spark, rows):
    return usage(spark, [{"provider": p, "model": m, "project": j, "started_at": datetime(2026, 8, d, h), "input_tokens": t, "fingerprint": f"{k}:{p}{d}{h}{m}"} for k, (p, m, j, d, h, t) in enumerate(rows)])


def test_rollups_follow_the_facts(spark, tmp_path):
    """Appends, replays, a deletion and a new pricing leave stored sums equal to those of the facts; only touched days are written."""
    from meterlake.operators import aggregate, rollups

    t = store.UsageStore(spark, str(tmp_path / "t"))
    day = lambda d, **k: ("claude", "claude-opus-4-8", "p", d, 3, 10)

    def same():
        for name, dims in rollups.ROLLUPS.items():
            want = {tuple(r) for r in rollups.partial(t.usage(), dims).select("provider", "day", *dims, *aggregate.STATS).collect()}
            assert {tuple(r) for r in t.rollup(name).select("provider", "day", *dims, *aggregate.STATS).collect()} == want

    first = by_day(spark, [day(1), day(2), day(2), ("pi", "m", "q", 2, 20, 5), ("pi", "m2", "q", 3, 1, 5)])
    t.append(first, scan_id=1)
    same()
    second = by_day(spark, [*[day(1)] * 6, day(3), ("pi", "m", "r", 3, 17, 7)])
    t.append(second, stream=("s", 5))
    same()
    for n in rollups.ROLLUPS:
        newest, *older = t.table.state()["tables"][n]
        assert newest["parts"] == ["provider=claude/day=2026-08-01", "provider=claude/day=2026-08-03", "provider=pi/day=2026-08-04"]
        assert [e["parts"] for e in older] == [["provider=claude/day=2026-08-02", "provider=pi/day=2026-08-03"]]
    before = t.version()
    t.append(second, stream=("s", 5))
    t.append(by_day(spark, [day(9)]), stream=("s", 4))
    assert t.version() == before
    t.reprice("2")
    same()
    assert t.rollup("rollup_models").where("provider = 'claude'").agg(F.sum("cost_micros")).first()[0] > 0
    t.delete_provider("claude")
    same()
    assert [r.provider for r in t.model_counts().collect()] == ["pi"]


def test_answers_from_rollups(spark, tmp_path):
    from meterlake.operators import aggregate, rollups

    rows = [(p, f"m{d % 3}", f"j{h % 2}", d, h, 100 * d + h) for d in range(1, 28) for h in (0, 9, 15, 16, 23) for p in ("claude", "codex")]
    t = store.UsageStore(spark, str(tmp_path / "t"))
    t.append(by_day(spark, rows), scan_id=1)
    facts = t.usage()
    windows = [None, (datetime(2026, 8, 3, 5), datetime(2026, 8, 9, 10)), (datetime(2026, 8, 3, 16), datetime(2026, 8, 5, 16)), (datetime(2026, 8, 3, 17), datetime(2026, 8, 4, 12)), (datetime(2026, 8, 2, 16), datetime(2026, 8, 20, 9, 30)), (datetime(2027, 1, 1), datetime(2027, 2, 1))]
    for dims in ((), ("provider", "model"), ("project", "week"), ("session",)):
        for w in windows:
            want = [tuple(r) for r in aggregate.rollup(facts, *dims, window=w).collect()]
            got = t.answer(*dims, window=w)
            assert [tuple(r) for r in got.collect()] == want, (dims, w)
            if w and rollups.covering(dims):
                plan = got._jdf.queryExecution().executedPlan().toString()
                cuts = re.findall(r"day#\d+ >= (\d{4}-\d\d-\d\d)\), \(day#\d+ <= (\d{4}-\d\d-\d\d)\)", plan)
                assert len(re.findall(r"FileScan[^\n]*/usage", plan)) == len(cuts)  # the plan may be there twice, as made and as run
                assert len(set(cuts)) <= 2 and all(a == b for a, b in cuts)
    assert rollups.covering(("model", "project")) is None and rollups.covering(()) in rollups.ROLLUPS


def test_rollup_table_of_a_stream(spark, tmp_path):
    from meterlake.operators.rollups import RollupTable
    from meterlake.streaming import usage_stream

    r = RollupTable(spark, str(tmp_path / "r"), "provider", "model")
    day = lambda d: ("claude", "m", "p", d, 3, 10)
    assert r.add(by_day(spark, [day(1), day(2)]), ("s", 0)) and r.add(by_day(spark, [day(2)]), ("s", 1))
    assert not r.add(by_day(spark, [day(2)]), ("s", 1)) and not r.add(by_day(spark, [day(3)]), ("s", 0))
    assert r.add(by_day(spark, []), ("s", 2)) and r.add(by_day(spark, [day(1)]))
    assert sorted((x.day.day, x.records, x.input_tokens) for x in r.rows().collect()) == [(1, 2, 20), (2, 2, 20)]
    assert sorted((x.day.day, x.total_tokens) for x in usage_stream.latest(spark, str(tmp_path / "r"), "model").collect()) == [(1, 20), (2, 20)]


def test_append_writes_rows_once_and_deals_folders(spark, tmp_path, monkeypatch):
    """New rows are made once, keys and sums come from what is written; sums of many days are written by all tasks."""
    t = store.UsageStore(spark, str(tmp_path / "t"))
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = by_day(spark, [("claude", "m", "p", d, 3, 10) for d in range(1, 21)])
    new = store.new_rows

    def counted(*args):
        out = new(*args)
        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(store, "new_rows", counted)
    assert t.append(rows, scan_id=1) == {"found": 20, "inserted": 20, "skipped": 0} and made.value == 20
    for n in ("rollup_models", "rollup_projects"):
        files = {f.name[:10] for f in (tmp_path / "t" / n).rglob("part-*.parquet")}
        assert len(files) > 1
    priced = pricing_plan(spark, rows)
    assert "BroadcastHashJoin" in priced and not re.search(r"hashpartitioning\(provider#\d+, model#\d+, \d+\), ENSURE", priced.split("BroadcastExchange")[0])


def pricing_plan(spark, rows) -> str:
    from meterlake.functions.pricing import price

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return price(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
