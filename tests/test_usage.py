"""Calendar, pricing, series, quotas and the store, on literal fixtures."""

import math
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions import calendar, pricing, tokens
from meterlake.operators import aggregate, filters, quota, series, store
from meterlake.schema import USAGE

NOW = datetime(2026, 8, 14, 15)


def usage(spark, rows):
    base = {"provider": "claude", "project": "p", "session_id": "s", "model": "claude-opus-4-8", "started_at": datetime(2026, 8, 14), "input_tokens": 0, "output_tokens": 0, "cache_read_tokens": 0, "cache_write_tokens": 0, "cost_micros": 0, "raw_bytes": 0}
    names = [c.strip().split()[0] for c in USAGE.split(",")]
    full = [base | {"fingerprint": f"f{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], USAGE)


def test_windows():
    assert calendar.current("day", NOW) == (datetime(2026, 8, 13, 16), datetime(2026, 8, 14, 16))
    assert calendar.previous("week", NOW) == (datetime(2026, 8, 2, 16), datetime(2026, 8, 9, 16))
    assert calendar.last_n_days(7, NOW) == (datetime(2026, 8, 7, 16), NOW)
    assert calendar.previous("month", datetime(2026, 1, 20)) == (datetime(2025, 11, 30, 16), datetime(2025, 12, 31, 16))
    assert calendar.custom(date(2026, 1, 5), date(2026, 1, 1)) == calendar.custom(date(2026, 1, 1), date(2026, 1, 5))
    assert calendar.current("all", NOW) == (calendar.EPOCH, NOW)


def test_pricing(spark):
    u = usage(spark, [
        {"input_tokens": 1_000_000, "cache_write_tokens": 500_000},
        {"provider": "codex", "model": "gpt-5.5", "input_tokens": 200_000, "output_tokens": 10_000, "cache_read_tokens": 50_000},
        {"provider": "codex", "model": "gpt-5.5", "input_tokens": 200_000, "output_tokens": 10_000, "cache_read_tokens": 100_000},
        {"provider": "codex", "model": "gpt-5.6-sol", "cache_write_tokens": 1_000_000},
        {"model": " ", "input_tokens": 10}, {"model": "<SYNTHETIC>", "input_tokens": 10}, {"model": "mystery", "input_tokens": 10}, {"model": "glm-5.3", "input_tokens": 10},
    ])
    cost = {r.fingerprint: r.cost_micros for r in pricing.price(u).collect()}
    assert cost == {"f0": 8_125_000, "f1": 1_325_000, "f2": 2_550_000, "f3": 0, "f4": 0, "f5": 0, "f6": 50, "f7": 0}


def test_normalize_and_paths(spark):
    df = spark.createDataFrame([("Claude-Opus-4-8-free",), ("GPT-4O:free",), ("hy3 preview",), ("mystery-model",), ("",), (None,)], "m string")
    got = [r[0] for r in df.select(tokens.normalize_model(F.col("m"))).collect()]
    assert got == ["anthropic/claude-opus-4.8", "openai/gpt-4o", "tencent/hy3-preview", "mystery-model", None, None]
    df = spark.createDataFrame([("/a/b/", "b", "b"), ("C:\\x\\y", "y", "y"), (None, "unknown", "unknown"), ("/w/2026-08-07-10-11-12", "2026-08-07-10-11-12", "w")], "p string, want string, launch string")
    for r in df.select(tokens.project_of(F.col("p")).alias("got"), "want", tokens.launch_project(F.col("p")).alias("l"), "launch").collect():
        assert (r.got, r.l) == (r.want, r.launch)
    times = spark.createDataFrame([("2026-08-07T01:02:03.5Z",), ("2026-08-07T01:02:03+08:00",), ("2026-08-07",), ("x",), (None,)], "t string")
    assert [r[0] for r in times.select(tokens.from_rfc3339(F.col("t"))).collect()] == [datetime(2026, 8, 7, 1, 2, 3, 500000), datetime(2026, 8, 6, 17, 2, 3), None, None, None]


def test_series(spark):
    day = lambda m, d, n=1, c=0: {"started_at": datetime(2026, m, d, 1), "input_tokens": n, "cost_micros": c}
    today = date(2026, 8, 19)
    days = series.daily(usage(spark, [day(8, 10), day(8, 11), *[day(8, d) for d in range(14, 20)]]))
    assert series.longest_streak(days, today).first()[0] == series.current_streak(days, today).first()[0] == 6
    days = series.daily(usage(spark, [day(8, 16), day(8, 17), day(8, 18)]))
    assert series.current_streak(days, today).first()[0] == 3
    assert series.current_streak(days, date(2026, 8, 25)).first()[0] == 0
    days = series.daily(usage(spark, [day(8, 1, 500, 50), day(8, 2, 900, 40)]))
    assert series.busiest_day(days, today).first().day == date(2026, 8, 2)
    grid = series.grid(days, today)
    assert series.grid_start(today) == date(2025, 8, 17) and grid.agg(F.max("week")).first()[0] == 52
    assert {r.level: r.days for r in series.level_histogram(grid).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1}
    empty = series.daily(usage(spark, [day(8, 1)]).limit(0))
    assert series.activity(empty, today).first().asDict() == {"total_tokens": 0, "cost_micros": 0, "active_days": 0, "longest_streak": 0, "current_streak": 0}
    levels = spark.createDataFrame([(0, 100), (1, 100), (50, 100), (100, 100), (7, 0)], "v long, m long")
    assert [r[0] for r in levels.select(series.level(F.col("v"), F.col("m"))).collect()] == [0, 1, 2, 4, 1]


def test_empty_total_and_selection(spark):
    empty = usage(spark, [{}]).limit(0)
    assert aggregate.rollup(empty).first().asDict() == {k: 0 for k in (*aggregate.STATS, "total_tokens")}
    providers = filters.provider_dimension(spark)
    s = filters.normalize_selection(spark.createDataFrame([("pi", False, 0), ("codex", True, 1), ("pi", True, 2)], "provider string, enabled boolean, position int"), providers)
    rows = [(r.provider, r.enabled) for r in s.orderBy("position").collect()]
    assert rows[:3] == [("pi", False), ("codex", True), ("claude", True)] and len(rows) == 12
    assert filters.move_entry(s, "claude", 0).orderBy("position").first().provider == "claude"


def test_quota(spark):
    u = usage(spark, [{"input_tokens": 30, "started_at": NOW}, {"provider": "codex", "input_tokens": 999, "started_at": NOW}, {"input_tokens": 5, "started_at": datetime(2026, 8, 1)}])
    q = spark.createDataFrame([("claude", "day", 100, 0), ("claude", "all", 0, 0), ("trae", "week", 7, 0)], "provider string, period string, limit_tokens long, limit_cost_micros long")
    got = {(r.provider, r.period): (r.used_tokens, r.remaining_tokens, r.percent_used) for r in quota.refresh(q, u, datetime(2026, 8, 14, 15, 0, 1)).collect()}
    assert got == {("claude", "day"): (30, 70, 30.0), ("claude", "all"): (35, None, None), ("trae", "week"): (0, 7, 0.0)}


def test_store(spark, tmp_path):
    t = store.UsageStore(spark, str(tmp_path / "t"))
    rows = usage(spark, [{"input_tokens": 1}, {"input_tokens": 2}, {"provider": "pi", "fingerprint": "f0"}])
    assert t.append(rows, scan_id=1) == {"found": 3, "inserted": 3, "skipped": 0}
    assert t.append(rows.union(rows), scan_id=2) == {"found": 6, "inserted": 0, "skipped": 6}
    with pytest.raises(ValueError):
        t.insert(rows)
    t.reprice("2")
    assert {r.fingerprint: r.cost_micros for r in t.usage().where("provider = 'claude'").collect()} == {"f0": 5, "f1": 10}
    t.append(rows.limit(0), files=spark.createDataFrame([("pi", "a", datetime(2026, 1, 1), 3)], "provider string, rel string, mtime timestamp, size bigint"), scan_id=3)
    listing = spark.createDataFrame([("pi", "a", datetime(2026, 1, 1), 3), ("pi", "b", datetime(2026, 1, 1), 3)], "provider string, rel string, mtime timestamp, size bigint")
    assert [r.rel for r in t.changed(listing).collect()] == ["b"]
    t.delete_provider("pi")
    assert t.usage().count() == 2 and t.changed(listing).count() == 2
    assert {r.name: r.providers for r in store.projects(t.usage()).collect()} == {"p": ["claude"]}


def test_registered_queries_match_sql(spark):
    import duckdb

    from meterlake.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "conversations", "lineitem", "pages", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")

    def rows(df: pd.DataFrame):
        text = lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else f"{v:.5f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
        return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    for name in ("agg_03_by_provider_model", "agg_06_by_iso_week", "win_06_presets", "ts_10_activity", "prc_03_cost", "sto_01_dedup_append", "quo_02_refresh", "snp_01_dashboard", "ing_02_codex_carry", "ing_10_openclaw"):
        assert rows(QUERIES[name](spark, d).toPandas()) == rows(con.execute(ORACLES[name]).df()), name
