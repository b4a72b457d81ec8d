"""Registered queries over the given tables, each with the same in DuckDB SQL.

`events` stands in for usage (`usage`), `lineitem` for usage at scale, `conversations` and re-encoded
events for raw logs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar, pricing, tokens
from .operators import aggregate, filters, metrics, quota, series, store
from .plans import collect, snapshot
from .sources import files, ingest
from .sources.paths import work_folder
from .streaming import file_state, usage_stream

NOW = datetime(2024, 1, 20, 15)
TODAY = date(2024, 1, 20)
MONTH = calendar.last_n_days(30, NOW)
#: Range of event_id, and so rows at most, of a made-up Trae or Gemini document.
TRAE_ROWS, GEMINI_ROWS = 1000, 100_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODEL = """CASE event_id % 8 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'gpt-5.5' WHEN 2 THEN 'gemini-3-pro-preview' WHEN 3 THEN 'qwen3.7-plus'
  WHEN 4 THEN 'Claude-Sonnet-4-6-free' WHEN 5 THEN 'totally-unknown' WHEN 6 THEN '<synthetic>' ELSE 'glm-5.3' END"""
_USAGE = f"""
  CASE event_type WHEN 'click' THEN 'claude' WHEN 'view' THEN 'codex' WHEN 'purchase' THEN 'gemini' WHEN 'signup' THEN 'opencode' ELSE 'pi' END AS provider,
  concat('proj-', user_id % 7) AS project, concat('sess-', user_id) AS session_id, {_MODEL} AS model, CAST(ts AS {{ntz}}) AS started_at,
  greatest(CAST(floor(value * 1000) AS BIGINT) - k * 500, 0) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  least(k * 500, CAST(floor(value * 1000) AS BIGINT)) AS cache_read_tokens, CASE WHEN event_id % 5 = 0 THEN k ELSE 0 END AS cache_write_tokens,
  CAST(length(props) AS BIGINT) AS raw_bytes, concat('events:', event_id) AS fingerprint, event_id"""

_NAMES = ["claude-opus-4-8", "gpt-5.5", "gemini-3-pro-preview", "qwen3.7-plus", "Claude-Sonnet-4-6-free", "totally-unknown", "<synthetic>", "glm-5.3"]
#: Model resolution of the names above, spelled out: exact, alias, family and provider default.
_PRICE_ID = """CASE model WHEN 'claude-opus-4-8' THEN 'anthropic/claude-opus-4.8' WHEN 'gpt-5.5' THEN 'openai/gpt-5.5' WHEN 'gemini-3-pro-preview' THEN 'google/gemini-3.1-pro-preview'
  WHEN 'qwen3.7-plus' THEN 'qwen/qwen3.7-plus' WHEN 'Claude-Sonnet-4-6-free' THEN 'anthropic/claude-sonnet-4.6' WHEN '<synthetic>' THEN NULL WHEN 'glm-5.3' THEN 'z-ai/glm-5'
  ELSE CASE provider WHEN 'codex' THEN 'openai/gpt-5.5' ELSE 'anthropic/claude-opus-4.8' END END"""
_PRICES = ", ".join(f"('{i}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, a, b, c, d in pricing.DEFAULTS + pricing.OVERRIDES)
_COST = """CAST(coalesce(greatest(round(CASE WHEN provider = 'codex'
  THEN input_tokens::DOUBLE * (p_in * CASE WHEN input_tokens + cache_read_tokens > 272000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)
     + cache_read_tokens::DOUBLE * (p_cr * CASE WHEN input_tokens + cache_read_tokens > 272000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)
     + output_tokens::DOUBLE * (p_out * CASE WHEN input_tokens + cache_read_tokens > 272000 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
  ELSE input_tokens::DOUBLE * p_in + output_tokens::DOUBLE * p_out + cache_read_tokens::DOUBLE * p_cr + cache_write_tokens::DOUBLE * p_cw END), 0), 0) AS BIGINT)"""
WITH = f"""WITH raw AS (SELECT {_USAGE.format(ntz='TIMESTAMP')} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e),
  prices(id, p_in, p_out, p_cr, p_cw) AS (VALUES {_PRICES}),
  usage AS (SELECT raw.*, {_COST} AS cost_micros, CAST(started_at + INTERVAL 8 HOURS AS DATE) AS d, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS tt
    FROM raw LEFT JOIN prices ON prices.id = {_PRICE_ID}) """
SUMS_SQL = ", ".join(["count(*) AS records", *[f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in aggregate.SUMS], "CAST(coalesce(sum(tt), 0) AS BIGINT) AS total_tokens"])


def unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.selectExpr(*_split(_USAGE.format(ntz="TIMESTAMP_NTZ")), "cast(0 as bigint) AS cost_micros")


def _split(columns: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price(unpriced(spark, sf_dir))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as usage of several years."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_returnflag AS provider", "concat('p-', l_suppkey) AS project", "concat('s-', l_orderkey) AS session_id", "concat('m-', l_partkey % 50) AS model",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS started_at", "CAST(floor(l_quantity * 1000) AS BIGINT) AS input_tokens", "CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens",
        "0L AS cache_read_tokens", "0L AS cache_write_tokens", "0L AS cost_micros", "0L AS raw_bytes", "concat(l_orderkey, ':', l_linenumber) AS fingerprint",
    )


SCALED = """WITH usage AS (SELECT l_returnflag AS provider, concat('p-', l_suppkey) AS project, concat('m-', l_partkey % 50) AS model, CAST(l_shipdate AS TIMESTAMP) AS started_at,
  CAST(floor(l_quantity * 1000) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens, 0 AS cache_read_tokens, 0 AS cache_write_tokens, 0 AS cost_micros,
  CAST(l_shipdate + INTERVAL 8 HOURS AS DATE) AS d, CAST(floor(l_quantity * 1000) AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT) AS tt FROM lineitem) """


def text_days(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names or ("day",)})


def add(name: str, run: Query, sql: str | None, base: str = WITH) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = base + sql


def in_sql(w: calendar.Window, ts: str = "started_at") -> str:
    return f"{ts} >= TIMESTAMP '{w[0]}' AND {ts} < TIMESTAMP '{w[1]}'"


M = in_sql(MONTH)
KEYS = {"provider": "provider", "model": "model", "project": "project", "session": "session_id", "day": "strftime(d, '%Y-%m-%d')", "week": "strftime(d, '%G-W%V')", "month": "strftime(d, '%Y-%m')", "hour": "CAST(extract(hour FROM started_at + INTERVAL 8 HOURS) AS INTEGER)"}


def _rollups() -> None:
    plans = {
        "agg_01_window_total": ((), True), "agg_02_by_provider": (("provider",), True), "agg_03_by_provider_model": (("provider", "model"), True), "agg_04_by_project": (("project",), True),
        "agg_05_by_day": (("day",), True), "agg_06_by_iso_week": (("week",), False), "agg_07_by_month": (("month",), False), "agg_08_by_model": (("model",), False), "agg_10_by_session": (("session",), False),
        "agg_10_by_provider_hour": (("provider", "hour"), True),
    }
    for name, (dims, windowed) in plans.items():
        keys = "".join(f"{KEYS[d]} AS {d}, " for d in dims)
        sql = f"SELECT {keys}{SUMS_SQL} FROM usage" + (f" WHERE {M}" if windowed else "") + (" GROUP BY " + ", ".join(KEYS[d] for d in dims) if dims else "")
        add(name, lambda s, d, dims=dims, w=MONTH if windowed else None: aggregate.rollup(usage(s, d), *dims, window=w), sql)
    for name, dims in (("agg_13_by_provider_tokens", ("provider",)), ("agg_14_by_model_tokens", ("model",))):
        add(name, lambda s, d, dims=dims: aggregate.rollup(usage(s, d), *dims, order="total_tokens"), f"SELECT {dims[0]}, {SUMS_SQL} FROM usage GROUP BY 1")
    add("agg_15_projects_by_tokens", lambda s, d: aggregate.projects_by_tokens(usage(s, d), MONTH), f"SELECT project, {SUMS_SQL} FROM usage WHERE {M} GROUP BY 1")
    add("agg_09_by_hour_of_day", lambda s, d: series.hours_of_day(usage(s, d), TODAY), f"SELECT {KEYS['hour']} AS hour, {SUMS_SQL} FROM usage WHERE d = DATE '{TODAY}' GROUP BY 1")
    add("agg_11_merge", lambda s, d: aggregate.merge(aggregate.rollup(usage(s, d), "provider", "model", "day"), "provider"), f"SELECT provider, {SUMS_SQL} FROM usage GROUP BY 1")
    add("agg_12_distinct_projects", lambda s, d: aggregate.distinct_projects(usage(s, d)), "SELECT DISTINCT project FROM usage")
    add("agg_03_nested_models", lambda s, d: aggregate.models_by_provider(usage(s, d)).select("provider", "records", "cost_micros", F.concat_ws(",", F.transform("models", lambda m: m["model"])).alias("models")),
        "SELECT provider, CAST(sum(n) AS BIGINT) AS records, CAST(sum(c) AS BIGINT) AS cost_micros, string_agg(model, ',' ORDER BY c DESC, model) AS models FROM (SELECT provider, model, count(*) AS n, sum(cost_micros) AS c FROM usage GROUP BY ALL) GROUP BY 1")
    add("scale_by_provider_model_day", lambda s, d: aggregate.rollup(scaled(s, d), "provider", "model", "day"), f"SELECT provider, model, {KEYS['day']} AS day, {SUMS_SQL} FROM usage GROUP BY ALL", SCALED)
    add("scale_by_project", lambda s, d: aggregate.rollup(scaled(s, d), "project", order="total_tokens"), f"SELECT project, {SUMS_SQL} FROM usage GROUP BY 1", SCALED)
    add("scale_by_iso_week", lambda s, d: aggregate.rollup(scaled(s, d), "week"), f"SELECT {KEYS['week']} AS week, {SUMS_SQL} FROM usage GROUP BY 1", SCALED)
    add("scale_top_models", lambda s, d: metrics.top_per(aggregate.rollup(scaled(s, d), "provider", "model"), "provider", "model", 8).select("provider", "model", "total_tokens", "rank"),
        "SELECT provider, model, CAST(t AS BIGINT) AS total_tokens, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY provider ORDER BY t DESC, model) AS INTEGER) AS rank FROM (SELECT provider, model, sum(tt) AS t FROM usage GROUP BY ALL)) WHERE rank <= 8", SCALED)


ROW = "provider, project, session_id, model, started_at, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, cost_micros, raw_bytes, fingerprint"


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*[c.strip() for c in ROW.split(",")])


def _selection(s: SparkSession, d: str) -> DataFrame:
    """A user's list from the data: providers by first use, with repeats, those of few records off."""
    seen = usage(s, d).groupBy("provider").agg(F.count("*").alias("n"), F.min("fingerprint").alias("f"))
    once = seen.select("provider", (F.col("n") >= 1000).alias("enabled"), F.length("provider").alias("position"))
    return filters.normalize_selection(once.unionByName(once.withColumn("position", F.col("position") + 100)), filters.provider_dimension(s))


def _filters() -> None:
    add("flt_01_window", lambda s, d: _rows(filters.in_window(usage(s, d), calendar.current("week", NOW))), f"SELECT {ROW} FROM usage WHERE {in_sql(calendar.current('week', NOW))}")
    add("flt_02_provider_window", lambda s, d: _rows(filters.in_window(usage(s, d), MONTH, provider="codex")), f"SELECT {ROW} FROM usage WHERE {M} AND provider = 'codex'")
    add("flt_03_project_window", lambda s, d: _rows(filters.in_window(usage(s, d), MONTH, project="proj-3")), f"SELECT {ROW} FROM usage WHERE {M} AND project = 'proj-3'")
    add("flt_04_fingerprint", lambda s, d: _rows(filters.by_fingerprint(usage(s, d), "events:25")), f"SELECT {ROW} FROM usage WHERE fingerprint = 'events:25'")
    add("flt_05_billed", lambda s, d: _rows(filters.billed(usage(s, d))).groupBy("provider").agg(F.count("*").alias("records")), "SELECT provider, count(*) AS records FROM usage WHERE tt > 0 GROUP BY 1")
    add("flt_06_used_providers", lambda s, d: filters.used(filters.provider_dimension(s).join(aggregate.rollup(usage(s, d), "provider").select("provider", "records"), "provider", "left").fillna(0)).select("provider", "records"),
        "SELECT provider, count(*) AS records FROM usage GROUP BY 1")
    add("flt_07_tracked", lambda s, d: filters.tracked(usage(s, d), _selection(s, d)).groupBy("provider").agg(F.count("*").alias("records")),
        "SELECT provider, count(*) AS records FROM usage GROUP BY 1 HAVING count(*) >= 1000")
    presets = " UNION ALL ".join(f"SELECT '{n}' AS name, TIMESTAMP '{a}' AS lo, TIMESTAMP '{b}' AS hi" for n, (a, b) in calendar.preset_windows(NOW).items())

    def in_presets(s: SparkSession, d: str) -> DataFrame:
        # Usage by hour first: window bounds are whole hours or now, which is one too.
        hourly = usage(s, d).groupBy(F.date_trunc("hour", F.col("started_at")).cast("timestamp_ntz").alias("h")).agg(F.count("*").alias("n"), F.sum("cost_micros").alias("c"))
        p = F.broadcast(calendar.presets(s, NOW))  # nine rows
        hit = (F.col("h") >= F.col("window_start")) & (F.col("h") < F.col("window_end"))
        return p.join(hourly, hit, "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("c"), F.lit(0)).alias("cost_micros"))

    add("win_06_presets", in_presets, f", presets AS ({presets}) SELECT name, count(fingerprint) AS records, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS cost_micros FROM presets LEFT JOIN usage ON started_at >= lo AND started_at < hi GROUP BY 1")
    for name, w in (("win_01_current_month", calendar.current("month", NOW)), ("win_02_previous_week", calendar.previous("week", NOW)), ("win_03_last_7_days", calendar.last_n_days(7, NOW)), ("win_04_current_year", calendar.current_year(NOW)), ("win_05_custom", calendar.custom(date(2024, 1, 20), date(2024, 1, 5)))):
        add(name, lambda s, d, w=w: aggregate.rollup(usage(s, d), window=w), f"SELECT {SUMS_SQL} FROM usage WHERE {in_sql(w)}")


DAYS = f", days AS (SELECT d AS day, {SUMS_SQL} FROM usage GROUP BY d)"
ISLANDS = f"{DAYS}, active AS (SELECT day FROM days WHERE total_tokens > 0 AND day BETWEEN DATE '{TODAY}' - 364 AND DATE '{TODAY}'), runs AS (SELECT max(day) AS last_day, count(*) AS n FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM active) GROUP BY g)"


def _series() -> None:
    day = "strftime(d, '%Y-%m-%d') AS day"
    for name, dims in (("ts_01_daily", ()), ("ts_02_daily_by_provider", ("provider",)), ("ts_03_daily_by_provider_model", ("provider", "model"))):
        add(name, lambda s, d, dims=dims: text_days(series.daily(usage(s, d), *dims, window=MONTH)), f"SELECT {''.join(x + ', ' for x in dims)}{day}, {SUMS_SQL} FROM usage WHERE {M} GROUP BY ALL")
    add("ts_04_model_series", lambda s, d: text_days(series.model_series(series.daily(usage(s, d), "provider", "model"))), f"SELECT model, {day}, {SUMS_SQL} FROM usage GROUP BY ALL")
    hours = f", found AS (SELECT {KEYS['hour']} AS hour, {SUMS_SQL} FROM usage WHERE d = DATE '{TODAY}' GROUP BY 1), spine AS (SELECT CAST(h AS INTEGER) AS hour FROM range(24) r(h)), hours AS (SELECT hour, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*aggregate.STATS, "total_tokens")) + " FROM spine LEFT JOIN found USING (hour))"
    add("ts_05_hours", lambda s, d: series.hours(usage(s, d), TODAY), f"{hours} SELECT * FROM hours")
    add("ts_06_peak_hour", lambda s, d: series.peak_hour(series.hours(usage(s, d), TODAY)), f"{hours} SELECT hour, total_tokens FROM hours WHERE total_tokens > 0 ORDER BY total_tokens DESC, hour LIMIT 1")
    add("ts_07_hour_bars", lambda s, d: series.hour_bars(series.hours(usage(s, d), TODAY)),
        f"{hours}, m AS (SELECT max(total_tokens) AS m FROM hours) SELECT hour, total_tokens, CAST(CASE WHEN total_tokens > 0 THEN greatest(round(total_tokens::DOUBLE / m * 4), 1) ELSE 0 END AS INTEGER) AS bar_rows, CAST(CASE WHEN total_tokens > 0 THEN ceil(total_tokens::DOUBLE / m * 8) ELSE 0 END AS INTEGER) AS bar_cells FROM hours, m")
    for span, unit in ((14, "day"), (90, "week"), (365, "month")):
        add(f"ts_08_trend_{unit}", lambda s, d, span=span: text_days(series.trend(series.daily(usage(s, d)), span), "bucket_start"), f"SELECT strftime(date_trunc('{unit}', d), '%Y-%m-%d') AS bucket_start, {SUMS_SQL} FROM usage GROUP BY 1")
    add("ts_09_report_days", lambda s, d: text_days(series.daily(usage(s, d), window=calendar.last_n_days(365, NOW))), f"SELECT {day}, {SUMS_SQL} FROM usage WHERE {in_sql(calendar.last_n_days(365, NOW))} GROUP BY 1")
    longest, live = "(SELECT coalesce(max(n), 0) FROM runs)", f"(SELECT coalesce(max(n), 0) FROM runs WHERE last_day >= DATE '{TODAY}' - 1)"
    add("ts_10_activity", lambda s, d: series.activity(series.daily(usage(s, d)), TODAY), f"{ISLANDS} SELECT CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) FILTER (total_tokens > 0) AS active_days, {longest} AS longest_streak, {live} AS current_streak FROM days WHERE day BETWEEN DATE '{TODAY}' - 364 AND DATE '{TODAY}'")
    add("ts_11_longest_streak", lambda s, d: series.longest_streak(series.daily(usage(s, d)), TODAY), f"{ISLANDS} SELECT {longest} AS longest_streak")
    add("ts_12_current_streak", lambda s, d: series.current_streak(series.daily(usage(s, d)), TODAY), f"{ISLANDS} SELECT {live} AS current_streak")
    add("ts_13_busiest_day", lambda s, d: text_days(series.busiest_day(series.daily(usage(s, d)), TODAY)), f"{DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, total_tokens, cost_micros FROM days WHERE total_tokens > 0 AND day BETWEEN DATE '{TODAY}' - 364 AND DATE '{TODAY}' ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1")
    start = series.grid_start(TODAY)
    cells = f"{DAYS}, spine AS (SELECT CAST(t AS DATE) AS day FROM generate_series(TIMESTAMP '{start}', TIMESTAMP '{TODAY}', INTERVAL 1 DAY) g(t)), c AS (SELECT day, coalesce(total_tokens, 0) AS total_tokens, coalesce(cost_micros, 0) AS cost_micros FROM spine LEFT JOIN days USING (day)), cells AS (SELECT *, CAST(CASE WHEN total_tokens = 0 THEN 0 ELSE least(greatest(floor(total_tokens * 4 / max(total_tokens) OVER ()), 1), 4) END AS INTEGER) AS level FROM c)"
    add("ts_14_grid", lambda s, d: text_days(series.grid(series.daily(usage(s, d)), TODAY)), f"{cells} SELECT strftime(day, '%Y-%m-%d') AS day, CAST((day - DATE '{start}') // 7 AS INTEGER) AS week, CAST(extract(dow FROM day) AS INTEGER) AS weekday, total_tokens, cost_micros, level FROM cells")
    add("ts_15_levels", lambda s, d: series.grid(series.daily(usage(s, d)), TODAY).groupBy("level").agg(F.count("*").alias("cells"), F.sum("total_tokens").alias("total_tokens")), f"{cells} SELECT level, count(*) AS cells, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM cells GROUP BY 1")
    add("ts_16_level_histogram", lambda s, d: series.level_histogram(series.grid(series.daily(usage(s, d)), TODAY)), f"{cells} SELECT CAST(l AS INTEGER) AS level, count(day) AS days FROM range(5) r(l) LEFT JOIN (SELECT * FROM cells WHERE total_tokens > 0) ON level = l GROUP BY 1")
    add("ts_17_day_detail", lambda s, d: text_days(series.day_detail(series.daily(usage(s, d)), TODAY)), f"{DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, total_tokens, cost_micros FROM days WHERE day = DATE '{TODAY}'")
    runs = "(SELECT d AS day FROM usage GROUP BY d)"
    add("scale_streaks", lambda s, d: text_days(series.streaks(series.daily(scaled(s, d)), date(1998, 8, 1)), "first_day", "last_day"),
        f"SELECT strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS length FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM {runs} WHERE day BETWEEN DATE '1998-08-01' - 364 AND DATE '1998-08-01') GROUP BY g", SCALED)


def _metrics_and_prices() -> None:
    agg = f", a AS (SELECT model, {SUMS_SQL} FROM usage GROUP BY 1)"
    sql = {"total": "total_tokens::DOUBLE", "output": "output_tokens::DOUBLE", "input": "input_tokens::DOUBLE", "cache_read": "cache_read_tokens::DOUBLE", "cost_usd": "cost_micros / 1e6",
           "hit_rate": "CASE WHEN cache_read_tokens + input_tokens = 0 THEN 0.0::DOUBLE ELSE cache_read_tokens::DOUBLE / (cache_read_tokens + input_tokens) * 100 END"}
    by_model = lambda s, d: aggregate.rollup(usage(s, d), "model")
    rounded = lambda df: df.withColumn("value", F.round("value", 6))
    add("met_01_metrics", lambda s, d: rounded(metrics.unpivoted(by_model(s, d), "model")), agg + " UNION ALL ".join(f" SELECT model, '{m}' AS metric, round({sql[m]}, 6) AS value FROM a" for m in metrics.METRICS))
    add("met_02_models_by_hit_rate", lambda s, d: rounded(metrics.ranked(by_model(s, d), "model", "hit_rate")), f"{agg} SELECT model, round({sql['hit_rate']}, 6) AS value FROM a")
    for name, weight in (("total", "total_tokens::DOUBLE"), ("hit_rate", "(cache_read_tokens + input_tokens)::DOUBLE")):
        add(f"met_03_share_{name}", lambda s, d, name=name: metrics.shares(by_model(s, d), "model", name).withColumn("share", F.round("share", 9)), f"{agg} SELECT model, {weight} AS value, round({weight} / sum({weight}) OVER (), 9) AS share FROM a")
    add("met_04_top_models", lambda s, d: metrics.top(by_model(s, d), "model", 8), f"{agg} SELECT * FROM a ORDER BY total_tokens DESC, model LIMIT 8")
    add("met_05_model_counts", lambda s, d: metrics.model_counts(usage(s, d)), "SELECT provider, count(DISTINCT model) AS models FROM usage GROUP BY 1")
    add("prc_02_resolve", lambda s, d: pricing.resolve(unpriced(s, d), pricing.price_table(s)).select("provider", "model", "price_id", "price_input", "price_output"),
        f"SELECT DISTINCT provider, model, {_PRICE_ID} AS price_id, p_in AS price_input, p_out AS price_output FROM raw LEFT JOIN prices ON prices.id = {_PRICE_ID}")
    add("prc_03_cost", lambda s, d: usage(s, d).select("fingerprint", "cost_micros"), "SELECT fingerprint, cost_micros FROM usage")


def _twice(s: SparkSession, d: str) -> DataFrame:
    u = usage(s, d).drop("event_id")
    again = usage(s, d).where("event_id % 3 = 0").drop("event_id").withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    return u.unionByName(again)


def _storage() -> None:
    add("sto_01_dedup_append", lambda s, d: _rows(store.new_rows(_twice(s, d), usage(s, d).where("event_id % 10 = 0"))), f"SELECT {ROW} FROM usage WHERE event_id % 10 <> 0")
    add("sto_02_duplicates", lambda s, d: store.duplicates(_twice(s, d)), "SELECT provider, fingerprint, CAST(2 AS BIGINT) AS n FROM usage WHERE event_id % 3 = 0")
    def new_store(s: SparkSession) -> store.UsageStore:
        return store.UsageStore(s, work_folder(s, "usage-store"))

    def deleted(s: SparkSession, d: str) -> DataFrame:
        """Rows by provider once one is deleted, and once its rows are scanned again."""
        t = new_store(s)
        t.append(_rows(usage(s, d)), scan_id=1)
        t.delete_provider("pi")
        left = t.usage().groupBy("provider").agg(F.count("*").alias("records")).withColumn("step", F.lit("deleted")).toPandas()  # the folder changes below
        t.append(_rows(usage(s, d)), scan_id=2)
        again = t.usage().groupBy("provider").agg(F.count("*").alias("records")).withColumn("step", F.lit("again"))
        return again.unionByName(s.createDataFrame(left, again.schema))

    counts = "SELECT provider, count(*) AS records, '{}' AS step FROM usage {} GROUP BY 1"
    add("sto_03_delete_provider", deleted, f"{counts.format('deleted', "WHERE provider <> 'pi'")} UNION ALL {counts.format('again', '')}")
    add("sto_04_projects", lambda s, d: store.projects(usage(s, d)).withColumn("providers", F.concat_ws(",", "providers")), "SELECT project AS name, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM usage GROUP BY 1")

    def stored(s: SparkSession, d: str) -> DataFrame:
        t = new_store(s)
        t.append(_rows(usage(s, d).where("event_id % 4 <> 0")), scan_id=1)
        t.append(_rows(usage(s, d)), scan_id=2)
        return aggregate.rollup(t.usage(), "provider", window=MONTH)

    add("sto_06_store_round_trip", stored, f"SELECT provider, {SUMS_SQL} FROM usage WHERE {M} GROUP BY 1")

    def in_store(s: SparkSession, d: str) -> store.UsageStore:
        t = new_store(s)
        t.append(_rows(usage(s, d).where("event_id % 4 <> 0")), scan_id=1)
        t.append(_rows(usage(s, d)), scan_id=2)
        return t

    add("agg_11_from_rollup", lambda s, d: in_store(s, d).answer("provider", window=MONTH), f"SELECT provider, {SUMS_SQL} FROM usage WHERE {M} GROUP BY 1")
    add("agg_11_models_by_week", lambda s, d: in_store(s, d).answer("model", "week"), f"SELECT model, {KEYS['week']} AS week, {SUMS_SQL} FROM usage GROUP BY ALL")
    add("ts_02_from_rollup", lambda s, d: in_store(s, d).answer("provider", "day", window=MONTH), f"SELECT provider, {KEYS['day']} AS day, {SUMS_SQL} FROM usage WHERE {M} GROUP BY ALL")
    add("met_05_from_rollup", lambda s, d: in_store(s, d).model_counts(), "SELECT provider, count(DISTINCT model) AS models FROM usage GROUP BY 1")

    def cut_off(t: store.UsageStore, change) -> None:
        """A change that is cut off just before its version would appear."""
        class Cut(Exception):
            pass

        def commit(*_, **__):
            raise Cut

        t.table.commit = commit
        try:
            change(t)
        except Cut:
            del t.table.commit

    def resumed(s: SparkSession, d: str) -> DataFrame:
        """A deletion, a scan and a new pricing, each cut off at first; rows and costs of what is left, and stored sums of the same."""
        t = new_store(s)
        t.append(_rows(unpriced(s, d)), scan_id=1)
        for change in (lambda t: t.delete_provider("pi"), lambda t: t.append(_rows(unpriced(s, d).where("event_id % 3 = 0")), scan_id=2), lambda t: t.reprice("2")):
            cut_off(t, change)
            change(t)
        sums = t.rollup("rollup_models").groupBy("provider").agg(F.sum("records").alias("stored_records"), F.sum("cost_micros").alias("stored_cost"))
        return t.usage().groupBy("provider").agg(F.count("*").alias("records"), F.sum("cost_micros").alias("cost_micros")).join(sums, "provider")

    left = "SELECT provider, count(*) AS records, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, count(*) AS stored_records, CAST(sum(cost_micros) AS BIGINT) AS stored_cost FROM usage WHERE provider <> 'pi' OR event_id % 3 = 0 GROUP BY 1"
    add("sto_03_prc_06_resumed", resumed, left)

    def inserted(s: SparkSession, d: str) -> DataFrame:
        """Plain inserts of two halves; a third that repeats rows is refused."""
        t, u = new_store(s), usage(s, d)
        n = [t.insert(_rows(u.where(f"event_id % 2 = {k}"))) for k in (0, 1)]
        try:
            t.insert(_rows(u.where("event_id % 5 = 0")))
        except ValueError:
            n.append(-1)
        return t.usage().groupBy("provider").agg(F.count("*").alias("records")).withColumn("refused", F.lit(n[2:] == [-1]))

    add("sto_02_insert", inserted, "SELECT provider, count(*) AS records, true AS refused FROM usage GROUP BY 1")

    def first_written(s: SparkSession, d: str) -> DataFrame:
        """Copies with other counts, and a store before them: the first in source order stays, whatever its counts."""
        u = unpriced(s, d)
        copies = u.withColumn("ord", F.lit(1)).unionByName(u.withColumns({"ord": F.when(F.col("event_id") % 2 == 0, 0).otherwise(2), "output_tokens": F.col("output_tokens") + F.col("event_id") % 3 - 1}))
        t = new_store(s)
        t.append(copies.where("event_id % 5 = 0 and ord <> 1").drop("event_id"), scan_id=1)
        t.append(copies.drop("event_id"), scan_id=2)
        return t.usage().select("fingerprint", "output_tokens")

    add("sto_01_first_writer", first_written, "SELECT fingerprint, CAST(CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN output_tokens + event_id % 3 - 1 ELSE output_tokens END AS BIGINT) AS output_tokens FROM raw")

    def logged(s: SparkSession, d: str) -> DataFrame:
        t = new_store(s)
        t.append(_rows(usage(s, d).where("event_id % 10 = 0")), scan_id=1)
        t.append(_rows(_twice(s, d)), scan_id=2)
        return t.scan_log().select("provider", "scan_id", "found", "inserted", "skipped")

    tenth, third = "count(*) FILTER (event_id % 10 = 0)", "count(*) FILTER (event_id % 3 = 0)"
    add("sto_07_scan_summary", logged, f"SELECT provider, CAST(1 AS BIGINT) AS scan_id, {tenth} AS found, {tenth} AS inserted, CAST(0 AS BIGINT) AS skipped FROM usage GROUP BY 1 UNION ALL SELECT provider, 2, count(*) + {third}, count(*) - {tenth}, {third} + {tenth} FROM usage GROUP BY 1")

    def repriced(s: SparkSession, d: str) -> DataFrame:
        """Costs of a store that was filled without prices; a second call with the same version does nothing."""
        t = new_store(s)
        t.append(_rows(unpriced(s, d)), scan_id=1)
        ran = [t.reprice("2"), t.reprice("2")]
        return t.usage().groupBy("provider", "model").agg(F.sum("cost_micros").alias("cost_micros")).withColumn("runs", F.lit(sum(ran)))

    add("prc_06_reprice", repriced, "SELECT provider, model, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, CAST(1 AS INTEGER) AS runs FROM usage GROUP BY ALL")

    def priced(s: SparkSession, d: str) -> DataFrame:
        """Rows as the jobs give them, through the pricing stage into the store."""
        t = new_store(s)
        t.append(pricing.price(_rows(unpriced(s, d))), scan_id=1)
        return t.usage().select("fingerprint", "cost_micros")

    add("prc_05_price_at_ingest", priced, "SELECT fingerprint, cost_micros FROM usage")

    def quotas(s: SparkSession, d: str) -> DataFrame:
        periods = F.explode(F.array(*[F.lit(p) for p in quota.PERIODS])).alias("period")
        q = usage(s, d).groupBy("provider").agg(F.max("input_tokens").alias("m")).select("provider", periods, (F.col("m") * 100).alias("limit_tokens"))
        return q.withColumn("limit_tokens", F.when(F.col("period") == "all", 0).otherwise(F.col("limit_tokens")).cast("long")).withColumn("limit_cost_micros", F.lit(0).cast("long"))

    bounds = " UNION ALL ".join(f"SELECT '{p}' AS period, TIMESTAMP '{a}' AS lo, TIMESTAMP '{b}' AS hi" for p, (a, b) in ((p, calendar.current(p, NOW)) for p in quota.PERIODS))
    add("quo_02_refresh", lambda s, d: quota.refresh(quotas(s, d), usage(s, d), NOW).withColumns({"percent_used": F.round("percent_used", 6), "remaining_tokens": F.col("remaining_tokens").cast("double")}),
        f", b AS ({bounds}), q AS (SELECT provider, period, lo, hi, CASE WHEN period = 'all' THEN 0 ELSE m * 100 END AS lim FROM (SELECT provider, max(input_tokens) AS m FROM usage GROUP BY 1), b), "
        "t AS (SELECT q.provider, period, lim, CAST(coalesce(sum(tt), 0) AS BIGINT) AS used, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS cost FROM q LEFT JOIN usage u ON u.provider = q.provider AND started_at >= lo AND started_at < hi GROUP BY ALL) "
        "SELECT provider, period, lim AS limit_tokens, CAST(0 AS BIGINT) AS limit_cost_micros, used AS used_tokens, cost AS used_cost_micros, CAST(CASE WHEN lim > 0 THEN greatest(lim - used, 0) END AS DOUBLE) AS remaining_tokens, round(CASE WHEN lim > 0 THEN used::DOUBLE / lim * 100 END, 6) AS percent_used FROM t")  # fmt: skip
    add("quo_01_set_limits", lambda s, d: quota.upsert(quotas(s, d).withColumn("used_tokens", F.lit(7).cast("long")), quotas(s, d).where("period <> 'day'").withColumn("limit_tokens", F.lit(5).cast("long"))).select("provider", "period", "limit_tokens", "used_tokens"),
        f", b AS ({bounds}) SELECT provider, period, CAST(CASE WHEN period = 'day' THEN m * 100 ELSE 5 END AS BIGINT) AS limit_tokens, CAST(7 AS BIGINT) AS used_tokens FROM (SELECT provider, max(input_tokens) AS m FROM usage GROUP BY 1), b")
    add("snp_01_dashboard", lambda s, d: snapshot.dashboard(usage(s, d), MONTH),
        f"SELECT provider, model, project, day, {SUMS_SQL}, CASE grouping(provider, model, project, day) WHEN 15 THEN 'total' WHEN 7 THEN 'provider' WHEN 3 THEN 'provider_model' WHEN 13 THEN 'project' ELSE 'day' END AS level FROM (SELECT * EXCLUDE d, strftime(d, '%Y-%m-%d') AS day FROM usage WHERE {M}) GROUP BY GROUPING SETS ((), (provider), (provider, model), (project), (day))")
    add("snp_02_charts", lambda s, d: text_days(snapshot.charts(usage(s, d), MONTH)["provider"]), f"SELECT provider, strftime(d, '%Y-%m-%d') AS day, {SUMS_SQL} FROM usage WHERE {M} GROUP BY ALL")
    charts = {"provider_model": "provider, model, ", "model": "model, "}
    for name, keys in charts.items():
        add(f"snp_02_charts_{name}", lambda s, d, name=name: text_days(snapshot.charts(usage(s, d), MONTH)[name]), f"SELECT {keys}strftime(d, '%Y-%m-%d') AS day, {SUMS_SQL} FROM usage WHERE {M} GROUP BY ALL")
    same = {"activity": "ts_10_activity", "busiest": "ts_13_busiest_day", "grid": "ts_14_grid", "levels": "ts_16_level_histogram", "hours": "ts_05_hours", "peak": "ts_06_peak_hour"}
    for name, other in same.items():
        dated = name in ("busiest", "grid")
        add(f"snp_03_report_{name}", lambda s, d, name=name, dated=dated: text_days(r) if (r := snapshot.report(usage(s, d), TODAY, MONTH)[name]) and dated else r, ORACLES[other], "")
    in_grid = in_sql(calendar.custom(series.grid_start(TODAY), TODAY))
    add("snp_03_report_days", lambda s, d: text_days(snapshot.report(usage(s, d), TODAY, MONTH)["days"]), f"SELECT strftime(d, '%Y-%m-%d') AS day, {SUMS_SQL} FROM usage WHERE {in_grid} GROUP BY 1")
    add("snp_03_report_models", lambda s, d: snapshot.report(usage(s, d), TODAY, MONTH)["models"], f"SELECT model, {SUMS_SQL} FROM usage WHERE {M} GROUP BY 1")

    def partial_view(s: SparkSession, d: str) -> DataFrame:
        """A view one part of which throws: rows and cost of the others."""
        def broken(u: DataFrame, w: calendar.Window) -> DataFrame:
            return u.select("no such column")

        v = snapshot.view(usage(s, d), MONTH, 1, snapshot.PARTS | {"project": broken})
        rows = [(name, len(r), sum(x.cost_micros for x in r)) for name, r in v.rows.items()]
        return s.createDataFrame([*rows, ((v.error or "").split(":")[0], -1, 0)], "part string, n long, cost_micros long")

    counted = " UNION ALL ".join(f"SELECT '{n}' AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS cost_micros FROM (SELECT sum(cost_micros) AS c FROM usage WHERE {M} {'GROUP BY ' + k if k else ''})" for n, k in (("total", ""), ("provider", "provider"), ("provider_model", "provider, model"), ("day", "d")))
    add("snp_01_partial_view", partial_view, f"{counted} UNION ALL SELECT 'project', CAST(-1 AS BIGINT), CAST(0 AS BIGINT)")
    add("snp_03_report_providers", lambda s, d: snapshot.report(usage(s, d), TODAY, MONTH)["providers"], f"SELECT provider, {SUMS_SQL} FROM usage WHERE {M} GROUP BY 1")


def _streams() -> None:
    def streamed(s: SparkSession, d: str) -> DataFrame:
        top = work_folder(s, "usage-stream")
        usage(s, d).drop("event_id").write.parquet(f"{top}/in")
        source = s.readStream.schema(s.read.parquet(f"{top}/in").schema).parquet(f"{top}/in")
        usage_stream.rollup_table(source, f"{top}/out", f"{top}/state", "provider", "model").awaitTermination()
        return text_days(usage_stream.latest(s, f"{top}/out", "model"))

    add("str_06_daily_rollup", streamed, f"SELECT provider, model, strftime(d, '%Y-%m-%d') AS day, {SUMS_SQL} FROM usage GROUP BY ALL")

    def ingested(s: SparkSession, d: str) -> DataFrame:
        top = work_folder(s, "usage-ingest")
        _twice(s, d).where("fingerprint is not null").write.parquet(f"{top}/in")
        source = s.readStream.schema(s.read.parquet(f"{top}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
        t = store.UsageStore(s, f"{top}/store")
        usage_stream.ingest(source, t, f"{top}/state").awaitTermination()
        return t.usage().groupBy("provider").agg(F.count("*").alias("records"))

    add("str_03_stream_dedup", ingested, "SELECT provider, count(*) AS records FROM usage GROUP BY 1")

    def kept(s: SparkSession, d: str) -> DataFrame:
        """A stream of usage into a store with rollups, in several batches; one is replayed, with all rows, and changes nothing."""
        top, u = work_folder(s, "usage-rollup"), usage(s, d)
        u.unionByName(u.where("event_id % 3 = 0")).drop("event_id").repartition(6, "fingerprint", "cost_micros").write.parquet(f"{top}/in")
        source = s.readStream.schema(s.read.parquet(f"{top}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
        t = store.UsageStore(s, f"{top}/store")
        usage_stream.ingest(source, t, f"{top}/state").awaitTermination()
        t.append(_rows(usage(s, d).withColumn("fingerprint", F.concat("fingerprint", F.lit("x")))), stream=(f"{top}/state", 0))
        return text_days(t.rollup("rollup_models").select("provider", "model", "day", *aggregate.STATS))

    add("str_05_stored_rollup", kept, f"SELECT provider, model, strftime(min_day, '%Y-%m-%d') AS day, count(*) AS records, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in aggregate.SUMS)} FROM (SELECT *, d AS min_day FROM usage) GROUP BY ALL")

    def refreshed(s: SparkSession, d: str) -> DataFrame:
        u, old = usage(s, d), usage(s, d).where("event_id % 50 <> 0")
        stored = series.daily(old, "provider")
        return text_days(usage_stream.refresh_touched(u, u.where("event_id % 50 = 0"), stored))

    add("str_05_refresh_touched", refreshed, f"SELECT provider, strftime(d, '%Y-%m-%d') AS day, {SUMS_SQL} FROM usage GROUP BY ALL")


def _raw_logs() -> None:
    def lines(s: SparkSession, d: str, make) -> DataFrame:
        e = unpriced(s, d).withColumn("line", F.to_json(make))
        return e.select(F.concat("project", F.lit("/"), "session_id", F.lit(".jsonl")).alias("rel"), F.col("event_id").alias("line_idx"), "line", F.octet_length("line").cast("long").alias("raw_bytes"))

    stamp = lambda: F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    t = lambda c, n: F.col(c).alias(n)
    back = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens"

    def as_claude(s: SparkSession, d: str) -> DataFrame:
        u = F.struct(t("input_tokens", "input_tokens"), t("output_tokens", "output_tokens"), t("cache_write_tokens", "cache_creation_input_tokens"), t("cache_read_tokens", "cache_read_input_tokens"))
        j = lines(s, d, F.struct(F.lit("assistant").alias("type"), stamp().alias("timestamp"), F.struct("model", u.alias("usage")).alias("message")))
        return ingest.claude(s, [], NOW, j).drop("raw_bytes", "cost_micros")

    add("ing_01_claude", as_claude, f"SELECT 'claude' AS provider, project, session_id, model, started_at, {back}, concat(project, '/', session_id, '.jsonl:', event_id) AS fingerprint FROM raw WHERE input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0")

    def as_openclaw(s: SparkSession, d: str) -> DataFrame:
        u = F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("prompt_tokens"), t("output_tokens", "completion_tokens"), t("cache_read_tokens", "cached_tokens"))
        j = lines(s, d, F.struct(F.lit("message").alias("type"), F.concat(F.lit("e"), "event_id").alias("id"), stamp().alias("timestamp"), F.struct(F.lit("assistant").alias("role"), "model", u.alias("usage")).alias("message")))
        return ingest.openclaw(s, [], NOW, j).select("model", "started_at", "input_tokens", "output_tokens", "cache_read_tokens", "fingerprint")

    add("ing_10_openclaw", as_openclaw, "SELECT model, started_at, input_tokens, output_tokens, cache_read_tokens, concat(project, '/', session_id, '.jsonl:e', event_id) AS fingerprint FROM raw WHERE input_tokens + output_tokens + cache_read_tokens > 0")

    def as_codebuddy(s: SparkSession, d: str) -> DataFrame:
        u = F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("input_tokens"), t("output_tokens", "output_tokens"), t("cache_read_tokens", "cache_read_input_tokens"))
        cwd = F.concat(F.lit("/home/u/"), "project").alias("cwd")
        j = lines(s, d, F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.unix_millis(F.to_timestamp(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))).alias("timestamp"), F.col("session_id").alias("sessionId"), cwd, F.struct(u.alias("usage")).alias("message")))
        return ingest.codebuddy(s, [], NOW, j).select("project", "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "fingerprint")

    add("ing_03_codebuddy", as_codebuddy, "SELECT project, session_id, input_tokens, output_tokens, cache_read_tokens, concat(project, '/', session_id, '.jsonl:', event_id) AS fingerprint FROM raw WHERE input_tokens + output_tokens + cache_read_tokens > 0")

    def all_shapes(s: SparkSession, d: str) -> DataFrame:
        """Usage in each of its three shapes by turns; the later ones know what was written to the cache, or who asked for the model."""
        total = F.col("input_tokens") + F.col("cache_read_tokens")
        at = lambda k, c: F.when(F.col("event_id") % 3 == k, c)
        sent = at(0, F.struct(F.struct(total.alias("input_tokens"), t("output_tokens", "output_tokens"), t("cache_read_tokens", "cache_read_input_tokens")).alias("usage")))
        rich = F.struct(total.alias("inputTokens"), t("output_tokens", "outputTokens"), F.array(F.struct(t("cache_read_tokens", "cached_tokens"))).alias("inputTokensDetails"))
        raw = F.struct((total + F.col("cache_write_tokens")).alias("prompt_tokens"), t("output_tokens", "completion_tokens"), F.struct(t("cache_read_tokens", "cached_tokens")).alias("prompt_tokens_details"), t("cache_write_tokens", "prompt_cache_write_tokens"))
        said = F.struct(F.concat(F.lit("custom-local:"), "model").alias("requestModelId"), at(1, F.concat(F.lit("e"), "event_id")).alias("messageId"), at(2, F.concat(F.lit("t"), "event_id")).alias("traceId"), at(1, rich).alias("usage"), at(2, raw).alias("rawUsage"))
        j = lines(s, d, F.struct(F.lit("function_call").alias("type"), sent.alias("message"), said.alias("providerData")))
        return ingest.codebuddy(s, [], NOW, j).select("model", *back.split(", "), "fingerprint")

    add("ing_03_all_shapes", all_shapes, """SELECT model, input_tokens, output_tokens, cache_read_tokens, CASE WHEN event_id % 3 = 2 THEN cache_write_tokens ELSE 0 END AS cache_write_tokens,
      concat(project, '/', session_id, '.jsonl:', CASE event_id % 3 WHEN 1 THEN 'e' WHEN 2 THEN 't' ELSE '' END, event_id) AS fingerprint
      FROM raw WHERE input_tokens + output_tokens + cache_read_tokens + CASE WHEN event_id % 3 = 2 THEN cache_write_tokens ELSE 0 END > 0""")

    def as_trae(s: SparkSession, d: str) -> DataFrame:
        """Documents of one project and range of event_id each, so that they stay small; those of a project share its path."""
        row = F.struct(F.col("model").alias("model_name"), "session_id", F.col("event_id").alias("usage_time"), F.struct(t("input_tokens", "input_token"), t("output_tokens", "output_token"), t("cache_read_tokens", "cache_read_token"), t("cache_write_tokens", "cache_write_token")).alias("extra_info"))
        docs = unpriced(s, d).groupBy("project", F.floor(F.col("event_id") / TRAE_ROWS)).agg(F.to_json(F.collect_list(row)).alias("doc")).select(F.concat(F.lit("sessions/"), "project", F.lit(".json")).alias("rel"), "doc")
        return ingest.trae(s, [], NOW, docs).select("session_id", "model", *back.split(", "), "fingerprint")

    add("ing_15_trae", as_trae, f"SELECT session_id, lower(model) AS model, {back}, concat('sessions/', project, '.json:', session_id, ':', event_id) AS fingerprint FROM raw WHERE event_id > 0 AND input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0")

    def as_gemini(s: SparkSession, d: str) -> DataFrame:
        row = F.struct(F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("promptTokenCount"), t("output_tokens", "candidatesTokenCount"), t("cache_read_tokens", "cachedContentTokenCount")).alias("usageMetadata"), "model")
        docs = unpriced(s, d).groupBy("session_id", F.floor(F.col("event_id") / GEMINI_ROWS).alias("part")).agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("turns")).alias("chat"))).alias("doc")).select(F.concat(F.lit("tmp/"), "part", F.lit("/chats/"), "session_id", F.lit(".json")).alias("rel"), "doc")
        g = ingest.gemini(s, [], NOW, docs)
        return g.groupBy("session_id", "model").agg(F.count("*").alias("records"), *[F.sum(c).alias(c) for c in back.split(", ")[:3]], F.countDistinct("fingerprint").alias("keys"))

    add("ing_14_gemini", as_gemini, "SELECT session_id, model, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) AS keys FROM raw WHERE input_tokens + output_tokens + cache_read_tokens > 0 GROUP BY ALL")

    def as_codex(s: SparkSession, d: str) -> DataFrame:
        """Conversations as rollout files: system turns set the model, assistant turns bill."""
        c = s.read.parquet(f"{d}/conversations.parquet")
        u = F.struct(F.length("text").alias("input_tokens"), F.lit(0).alias("cached_input_tokens"), F.lit(0).alias("output_tokens"))
        state = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.col("text").alias("model")).alias("payload")))
        bill = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(u.alias("last_token_usage")).alias("info")).alias("payload")))
        line = F.when(F.col("role") == "system", state).when(F.col("role") == "assistant", bill).otherwise("not json")
        j = c.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("rel"), F.col("turn").alias("line_idx"), line.alias("line"), F.lit(0).cast("long").alias("raw_bytes"))
        return ingest.codex(s, [], NOW, j).select("model", "input_tokens", "fingerprint")

    add("ing_02_codex_carry", as_codex, """SELECT coalesce(m, '') AS model, CAST(length(text) AS BIGINT) AS input_tokens, concat('c', conv_id, '.jsonl:', turn) AS fingerprint FROM (SELECT *, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM conversations) WHERE role = 'assistant' AND length(text) > 0""", "")

    def in_pieces(s: SparkSession, d: str) -> DataFrame:
        """The same files as a stream of three pieces each, cut inside lines, with state by file."""
        top = work_folder(s, "pieces")
        u = F.struct(F.length("text").alias("input_tokens"), F.lit(0).alias("cached_input_tokens"), F.lit(0).alias("output_tokens"))
        turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.col("text").alias("model")).alias("payload")))
        bill = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(u.alias("last_token_usage")).alias("info")).alias("payload")))
        c = s.read.parquet(f"{d}/conversations.parquet")
        line = F.when(F.col("role") == "system", turn).when(F.col("role") == "assistant", bill).otherwise("not json")
        text = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
        raw = text.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("rel"), F.concat(F.array_join("l.line", "\n"), F.lit("\n")).cast("binary").alias("b")).withColumn("n", F.octet_length("b"))
        where = lambda k: F.floor(F.col("n") * k / 3).cast("int")
        store_of, kind_of = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        before = s.conf.get(store_of)
        s.conf.set(store_of, kind_of)
        try:
            for k in range(3):  # all tasks write a piece; the stream goes on where it was and takes it as one batch
                piece = F.substring("b", where(k) + 1, where(k + 1) - where(k))
                kind = F.lit("modify" if k else "create")
                part = raw.select("rel", kind.alias("kind"), F.lit(k).cast("long").alias("mtime_micros"), F.col("n").cast("long").alias("size"), where(k).cast("long").alias("start"), piece.alias("value"))
                part.write.mode("append").parquet(f"{top}/in")
                made = file_state.lines_with_state(s.readStream.schema(part.schema).parquet(f"{top}/in")).writeStream
                made = made.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{top}/out/batch={n}"))
                made.option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
        finally:
            s.conf.set(store_of, before)
        found = s.read.schema(file_state.LINES).parquet(*[f"{top}/out/batch={k}" for k in range(3)])
        return ingest.codex(s, [], NOW, found).select("model", "input_tokens", "fingerprint")

    add("str_04_codex_pieces", in_pieces, ORACLES["ing_02_codex_carry"], "")

    def scalar(s: SparkSession, d: str) -> DataFrame:
        p = s.read.parquet(f"{d}/pages.parquet")
        return p.select("page_id", tokens.project_of(F.col("url")).alias("leaf"))

    add("fn_04_leaf_of_path", scalar, r"SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/\\]+)[/\\]*$', 1), ''), 'unknown') AS leaf FROM pages", "")
    add("fn_13_normalize", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", tokens.normalize_model(F.concat(F.lit("Claude "), "p_name", F.lit("-4-6:free"))).alias("model")), "SELECT p_partkey, 'anthropic/' || regexp_replace(lower('Claude ' || p_name || '-4-6'), '\\s+', '-', 'g')[:-5] || '-4.6' AS model FROM part", "")
    #: A name for each branch, and what becomes of it.
    names = {
        " Claude Opus-4-8 ": "anthropic/claude-opus-4.8", "GPT-5.5:free": "openai/gpt-5.5", "chatgpt-x": "openai/chatgpt-x", "o3-mini": "openai/o3-mini", "Gemini 3  Pro-free": "google/gemini-3-pro", "grok-4-1": "x-ai/grok-4-1",
        "Qwen3.7-max": "qwen/qwen3.7-max", "DeepSeek V4": "deepseek/deepseek-v4", "glm-5": "z-ai/glm-5", "mimo-v2": "xiaomi/mimo-v2", "hy3": "tencent/hy3", "hy3-preview:free": "tencent/hy3-preview", "hy3-other": "hy3-other", "a/B-c": "a/b-c", "plain": "plain",
    }
    displayed = {
        " GPT-5.4 ": "gpt-5.4", "gpt-5.3": "gpt-5.3-codex", "GPT-5.3 Codex": "gpt-5.3-codex", "gpt-5.3-codex": "gpt-5.3-codex", "gpt-5.2": "gpt-5.2-codex", "gpt-5.2 codex": "gpt-5.2-codex", "gpt-5.1": "gpt-5.1-codex", "gpt-5.1 codex": "gpt-5.1-codex",
        "Gemini 3.1 Pro": "gemini-3.1-pro", "gemini 3.1": "gemini-3.1", "GLM 5.1": "glm-5.1", "glm-5.1": "glm-5.1", "Claude Sonnet 4.6": "claude-sonnet-4.6", "claude sonnet 4.5 ": "claude-sonnet-4.5", "Some Other": "some other",
    }

    def by_name(table: dict[str, str], make):
        return lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get(F.array(*[F.lit(n) for n in table]), (F.col("event_id") % len(table)).cast("int")).alias("n")).select("event_id", make(F.col("n")).alias("model"))

    def in_cases(table: dict[str, str]) -> str:
        return f"SELECT event_id, CASE event_id % {len(table)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(table.values())) + " END AS model FROM events"

    add("fn_13_branches", by_name(names, tokens.normalize_model), in_cases(names), "")
    add("fn_08_displayed_names", by_name(displayed, tokens.trae_model), in_cases(displayed), "")

    def layered(s: SparkSession, d: str) -> DataFrame:
        """Prices of a base table over the defaults and under the overrides."""
        p = s.read.parquet(f"{d}/part.parquet")
        ident = F.when(F.col("p_partkey") == 1, "openai/gpt-5.5").when(F.col("p_partkey") == 2, "qwen/qwen3.7-plus").otherwise(F.concat(F.lit("shop/"), "p_partkey"))
        price = F.col("p_retailprice").cast("double")
        base = p.select(ident.alias("id"), price.alias("input"), (price * 2).alias("output"), (price / 2).alias("cache_read"), F.lit(0.0).alias("cache_write"))
        return pricing.price_table(s, base)

    given = lambda rows: ", ".join(f"('{i}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for i, a, b, c, e in rows)
    add("prc_01_layers", layered, f"""WITH layers AS (
      SELECT 2 AS prio, * FROM (VALUES {given(pricing.DEFAULTS)}) t(id, input, output, cache_read, cache_write)
      UNION ALL SELECT 1, CASE p_partkey WHEN 1 THEN 'openai/gpt-5.5' WHEN 2 THEN 'qwen/qwen3.7-plus' ELSE concat('shop/', p_partkey) END, p_retailprice::DOUBLE, p_retailprice::DOUBLE * 2, p_retailprice::DOUBLE / 2, 0::DOUBLE FROM part
      UNION ALL SELECT 0, * FROM (VALUES {given(pricing.OVERRIDES)}) t(id, input, output, cache_read, cache_write))
      SELECT id, input, output, cache_read, cache_write FROM layers QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio) = 1""", "")
    add("fn_11_week_keys", lambda s, d: scaled(s, d).select(calendar.week_key("started_at").alias("week"), calendar.day_key("started_at").alias("day"), calendar.month_key("started_at").alias("month")).distinct(), f"SELECT DISTINCT {KEYS['week']} AS week, {KEYS['day']} AS day, {KEYS['month']} AS month FROM usage", SCALED)


_FOUR = "input_tokens + output_tokens + cache_read_tokens + cache_write_tokens > 0"


def _sources() -> None:
    """Log files written from events by Spark, and read again by the scans. A folder a project, its name in the path."""

    def lines(s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("p"), F.col("user_id") % 7).alias("project"), F.concat(F.lit('{"id":'), "event_id", F.lit("}")).alias("value"))

    def folder(s: SparkSession, df: DataFrame) -> str:
        top = work_folder(s, "logs")
        df.write.partitionBy("project").text(top)
        return top

    def by_project(df: DataFrame, *more) -> DataFrame:
        return df.withColumn("project", F.regexp_extract("rel", "project=(p[0-9])", 1)).groupBy("project", *more)

    text = r"\.txt$"
    raw = "WITH raw AS (SELECT concat('p', user_id % 7) AS project, concat('{\"id\":', event_id, '}') AS value, event_id FROM events) "
    count = lambda: F.count("*").alias("n_lines")
    add("src_01_lines", lambda s, d: by_project(files.json_lines(s, [(folder(s, lines(s, d)), None)], text)).agg(count(), F.sum("raw_bytes").alias("raw_bytes")),
        "SELECT project, count(*) AS n_lines, CAST(sum(length(value)) AS BIGINT) AS raw_bytes FROM raw GROUP BY 1", raw)
    add("src_02_discovery", lambda s, d: by_project(files.listing(s, "x", [(folder(s, lines(s, d)), None)], r"project=p[0-4]/.*\.txt$", 2)).agg(F.sum("size").alias("size")),
        "SELECT project, CAST(sum(length(value) + 1) AS BIGINT) AS size FROM raw WHERE project < 'p5' GROUP BY 1", raw)

    def two_roots(s: SparkSession, d: str) -> DataFrame:
        odd = F.col("project").isin("p1", "p3", "p5")
        roots = [(folder(s, lines(s, d).where(odd)), "odd"), (folder(s, lines(s, d).where(~odd)), None), (work_folder(s, "missing"), "none")]
        return by_project(files.json_lines(s, roots, text), F.coalesce(F.nullif(F.regexp_extract("rel", "^(odd|none)/", 1), F.lit("")), F.lit("-")).alias("label")).agg(count())

    add("src_03_roots", two_roots, "SELECT project, CASE WHEN project IN ('p1', 'p3', 'p5') THEN 'odd' ELSE '-' END AS label, count(*) AS n_lines FROM raw GROUP BY ALL", raw)
    add("src_04_snapshot", lambda s, d: files.snapshot(files.listing(s, "x", [(folder(s, lines(s, d)), None)], text)).select("provider", F.split("fingerprint", ":")[2].cast("long").alias("size")),
        "SELECT 'x' AS provider, CAST(sum(length(value) + 1) AS BIGINT) AS size FROM raw", raw)

    def incremental(s: SparkSession, d: str) -> DataFrame:
        """Files of three projects are known as they are; lines of the others are read."""
        t, roots = store.UsageStore(s, work_folder(s, "usage-store")), [(folder(s, lines(s, d)), None)]
        found = files.listing(s, "x", roots, text)
        t.append(_rows(unpriced(s, d)).limit(0), files=found.where("rel like 'project=p0%' or rel like 'project=p1%' or rel like 'project=p2%'"), scan_id=1)
        return by_project(files.json_lines(s, files.Roots(roots, only=t.changed(found)), text)).agg(count())

    add("src_05_incremental", incremental, "SELECT project, count(*) AS n_lines FROM raw WHERE project >= 'p3' GROUP BY 1", raw)

    def documents(s: SparkSession, d: str) -> DataFrame:
        """A JSON document for each project and 1,000 events, a file each."""
        e = s.read.parquet(f"{d}/events.parquet").groupBy(F.concat(F.lit("p"), F.col("user_id") % 7, F.lit("-"), F.floor(F.col("event_id") / 1000)).alias("project"))
        docs = files.documents(s, [(folder(s, e.agg(F.to_json(F.collect_list("event_id")).alias("value"))), None)], text)
        each = by_project(docs).agg(F.sum(F.size(F.from_json("doc", "array<bigint>"))).alias("n_events"), F.count("*").alias("n_docs"))
        return each

    add("src_06_documents", documents, "SELECT project, count(*) AS n_events, count(DISTINCT event_id // 1000) AS n_docs FROM raw GROUP BY 1", raw)


def _databases(rows: DataFrame, tables: list[str], rel: str) -> DataFrame:
    """Made-up database files (rel, label, content): `rows` (part, sql) holds the statements of each; a part is of bounded size."""

    def make(key, frame):
        import pandas as pd

        return pd.DataFrame([(rel.format(key[0]), None, files.sqlite_bytes([*tables, *frame.sql]))], columns=["rel", "label", "content"])

    return rows.groupBy("part").applyInPandas(make, "rel string, label string, content binary")


def _embedded() -> None:
    t = lambda c, n: F.col(c).alias(n)
    back = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens"
    millis = lambda: F.unix_millis(F.to_timestamp(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")))
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    part = lambda: F.floor(F.col("event_id") / 1000).alias("part")
    cwd = lambda: F.concat(F.lit("/w/"), "project")

    def message() -> F.Column:
        tokens_of = F.struct((F.col("input_tokens")).alias("input"), t("output_tokens", "output"), F.lit(3).alias("reasoning"), F.struct(t("cache_read_tokens", "read"), t("cache_write_tokens", "write")).alias("cache"))
        return F.to_json(F.struct(F.lit("assistant").alias("role"), t("model", "modelID"), F.struct(cwd().alias("cwd")).alias("path"), tokens_of.alias("tokens"), F.struct(millis().alias("created")).alias("time")))

    def messages(s: SparkSession, d: str, rel: str, rows: str = "true") -> DataFrame:
        """Message stores, a bad row and a file that is no database among them."""
        values = F.concat(F.lit("INSERT INTO message VALUES ('m"), "event_id", F.lit("', "), quoted(F.col("session_id")), F.lit(", 1, "), quoted(message()), F.lit(")"))
        made = _databases(unpriced(s, d).where(rows).select(part(), values.alias("sql")), ["CREATE TABLE message(id, session_id, time_created, data)", "INSERT INTO message VALUES ('bad', 's', 1, 'no json')"], rel)
        return made.union(s.createDataFrame([("broken.db", None, b"no database")], made.schema))

    sent = f"SELECT project, session_id, model, date_trunc('second', started_at) AS started_at, input_tokens + 3 AS input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, concat('{{}}:m', event_id) AS fingerprint FROM raw"
    shown = ["project", "session_id", "model", "started_at", *back.split(", "), "fingerprint"]
    add("ing_09_qoder", lambda s, d: ingest.qoder(s, [], NOW, messages(s, d, "{}/local.db")).select(shown), sent.format("local.db"))

    def both_stores(s: SparkSession, d: str) -> DataFrame:
        """The newer store and the older files, which share every third message; duplicates by key collapse."""
        old = unpriced(s, d).where("event_id % 3 = 0").select(F.concat(F.lit("storage/message/m"), "event_id", F.lit(".json")).alias("rel"), F.lit(None).cast("string").alias("label"), message().alias("doc"), "session_id")
        doc = F.concat(F.expr("substring(doc, 1, length(doc) - 1)"), F.lit(',"sessionID":'), F.to_json(F.array("session_id")))
        doc = F.regexp_replace(doc, r'"sessionID":\[(.*)\]$', r'"sessionID":$1}')
        return store.first_of_each(ingest.opencode(s, [], NOW, messages(s, d, "{}/opencode.db"), old.select("rel", "label", doc.alias("doc")))).select(shown)

    add("ing_07_08_opencode", both_stores, sent.format("opencode.db"))
    none = "SELECT rel, raw FROM (SELECT 'broken.db' AS rel, 'x' AS raw)"
    add("src_07_10_databases", lambda s, d: files.unreadable(messages(s, d, "{}/local.db"), "qoder").select("provider", "rel"), f"SELECT 'qoder' AS provider, rel FROM ({none})", "")

    def damaged(s: SparkSession, d: str) -> DataFrame:
        """Rows and errors of one read: every second store is cut short."""
        stores = messages(s, d, "{}/local.db")
        odd = F.regexp_extract("rel", "^([0-9]+)/", 1).try_cast("int") % 2 == 1
        stores = stores.withColumn("content", F.when(odd, F.expr("substring(content, 1, 60)")).otherwise(F.col("content")))
        rows = ingest.qoder(s, files.Roots([], tagged=True), NOW, stores)
        return rows.groupBy(F.coalesce(F.when(F.col("error").isNotNull(), F.col("rel")), F.lit("read")).alias("what")).agg(F.sum("input_tokens").alias("input_tokens"), F.count("*").alias("n"))

    add("src_10_rows_and_errors", damaged, """SELECT 'read' AS what, CAST(sum(input_tokens + 3) AS BIGINT) AS input_tokens, count(*) AS n FROM raw WHERE (event_id // 1000) % 2 = 0
      UNION ALL SELECT DISTINCT concat(event_id // 1000, '/local.db'), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM raw WHERE (event_id // 1000) % 2 = 1 UNION ALL SELECT 'broken.db', CAST(0 AS BIGINT), CAST(1 AS BIGINT)""")

    def covered(s: SparkSession, d: str) -> DataFrame:
        """Ledger totals of sessions; those with an even number are covered by logs."""
        sums = unpriced(s, d).groupBy("session_id").agg(F.sum("input_tokens").alias("used"), F.min("project").alias("project"), F.max("event_id").alias("event_id"))
        row = F.concat(F.lit("INSERT INTO sessions VALUES ("), quoted(F.col("session_id")), F.lit(", "), quoted(cwd()), F.lit(", 'm', 1000); INSERT INTO session_usage VALUES ("), quoted(F.col("session_id")), F.lit(", "), "used", F.lit(")"))
        sql = sums.select(F.floor(F.col("event_id") / 1000).alias("part"), F.explode(F.split(row, "; ")).alias("sql"))
        stores = _databases(sql, ["CREATE TABLE sessions(id, cwd, model, created_at)", "CREATE TABLE session_usage(session_id, used)"], "{}/workbuddy.db")
        even = unpriced(s, d).where("cast(substring(session_id, 6) as bigint) % 2 = 0").select("session_id")
        return ingest.workbuddy_ledger(s, [], NOW, even, stores).select("project", "session_id", "input_tokens", "started_at", "fingerprint")

    add("ing_06_ledger", covered, "SELECT min(project) AS project, session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, TIMESTAMP '1970-01-01 00:00:01' AS started_at, concat('workbuddy.db:', session_id) AS fingerprint FROM raw WHERE CAST(session_id[6:] AS BIGINT) % 2 = 1 GROUP BY session_id HAVING sum(input_tokens) > 0")

    def lookup(s: SparkSession, d: str) -> DataFrame:
        """Desktop requests: documents of 1,000 events, models in message files, folders in a key-value store."""
        u = unpriced(s, d).withColumn("conv", F.concat(F.lit("c"), F.floor(F.col("event_id") / 1000)))
        req = F.struct(F.concat(F.lit("r"), "event_id").alias("id"), millis().alias("startedAt"), F.struct((F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("inputTokens"), t("output_tokens", "outputTokens"), t("cache_read_tokens", "cacheTokens"), t("cache_write_tokens", "cachedWriteTokens")).alias("usage"))
        no = F.lit(None).cast("string").alias("label")
        index = u.groupBy("conv").agg(F.to_json(F.struct(F.collect_list(req).alias("requests"))).alias("doc")).select(F.concat(F.lit("ws/"), "conv", F.lit("/index.json")).alias("rel"), no, F.length("doc").cast("long").alias("size"), "doc")
        extra = F.to_json(F.struct(F.to_json(F.struct(F.concat(F.lit("r"), "event_id").alias("requestId"), t("model", "modelId"))).alias("extra")))
        notes = u.where("event_id % 2 = 0").select(F.concat(F.lit("ws/"), "conv", F.lit("/messages/"), "event_id", F.lit(".json")).alias("rel"), no, F.lit(1).cast("long").alias("size"), extra.alias("doc"))
        kv = u.select(part(), "conv").distinct().where("part % 2 = 0").select("part", F.concat(F.lit("INSERT INTO ItemTable VALUES ('session:"), "conv", F.lit("', '{\"cwd\": \"/w/"), "conv", F.lit("-app\"}')")).alias("sql"))
        folders = ingest.conversation_folders(s, [], _databases(kv, ["CREATE TABLE ItemTable(key, value)"], "{}/state.vscdb"))
        return ingest.codebuddy_desktop(s, [], NOW, folders, index.union(notes)).select("project", "session_id", "model", *back.split(", "), "fingerprint")

    conv = "concat('c', event_id // 1000)"
    add("ing_04_src_09_desktop", lookup, f"SELECT CASE WHEN (event_id // 1000) % 2 = 0 THEN concat({conv}, '-app') ELSE 'ws' END AS project, {conv} AS session_id, CASE WHEN event_id % 2 = 0 THEN model ELSE '' END AS model, {back}, concat('desktop:ws:', {conv}, ':r', event_id) AS fingerprint FROM raw WHERE {_FOUR}")

    def generations(s: SparkSession, d: str) -> DataFrame:
        """Binary generation records in conversation stores, one of them cut short."""
        def encode(frames):
            varint = lambda n: b"" if n is None else bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])
            field = lambda n, v: varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v
            for f in frames:
                blobs = [field(1, field(1, int(a)) + field(2, 500_000_000)) + field(9, field(2, int(i)) + field(3, int(o)) + field(5, int(c))) for a, i, o, c in zip(f["at"], f["i"], f["o"], f["c"])]
                f["sql"] = [f"INSERT INTO steps VALUES ({e}, 15, x'{b.hex()}')" for e, b in zip(f.event_id, blobs)]
                yield f[["part", "sql"]]

        u = unpriced(s, d).select(part().cast("long").alias("part"), "event_id", F.floor(millis() / 1000).alias("at"), (F.col("input_tokens") + F.col("cache_read_tokens")).alias("i"), t("output_tokens", "o"), t("cache_read_tokens", "c"))
        uri = "0a08" + b"file:///w/app".hex()
        tables = ["CREATE TABLE steps(idx, step_type, metadata)", "CREATE TABLE trajectory_metadata_blob(id, data)", "INSERT INTO steps VALUES (-1, 15, x'ff'), (-2, 14, x'')", f"INSERT INTO trajectory_metadata_blob VALUES ('main', x'0a{len(b'file:///w/app'):02x}{uri[4:]}')"]
        stores = _databases(u.mapInPandas(encode, "part long, sql string"), tables, "conversations/u{}.db")
        settings = s.createDataFrame([("settings.json", None, 1, '{"model": "gemini-x"}')], "rel string, label string, size bigint, doc string")
        return ingest.antigravity(s, [], NOW, stores, settings).select("project", "session_id", "model", "started_at", *back.split(", ")[:3], "fingerprint")

    name = "concat('u', event_id // 1000"
    add("ing_13_fn_09_antigravity", generations, f"SELECT 'app' AS project, {name}) AS session_id, 'gemini-x' AS model, date_trunc('second', started_at) + INTERVAL 500 MILLISECONDS AS started_at, input_tokens, output_tokens, cache_read_tokens, {name}, '.db:', event_id) AS fingerprint FROM raw WHERE input_tokens + output_tokens + cache_read_tokens > 0")


def _more_logs() -> None:
    t = lambda c, n: F.col(c).alias(n)
    back = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens"
    millis = lambda: F.unix_millis(F.to_timestamp(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")))

    def lines(s: SparkSession, d: str, make) -> DataFrame:
        e = unpriced(s, d).withColumn("line", F.to_json(make))
        return e.select(F.concat("project", F.lit("/"), "session_id", F.lit(".jsonl")).alias("rel"), F.col("event_id").alias("line_idx"), "line", F.octet_length("line").cast("long").alias("raw_bytes"))

    def as_workbuddy(s: SparkSession, d: str) -> DataFrame:
        raw = F.struct((F.col("input_tokens") + F.col("cache_read_tokens")).alias("prompt_tokens"), t("output_tokens", "completion_tokens"), t("cache_read_tokens", "prompt_cache_hit_tokens"), t("cache_write_tokens", "prompt_cache_write_tokens"))
        cwd = F.concat(F.lit("/w/"), "project", F.when(F.col("event_id") % 2 == 0, F.lit("/2026-08-07-10-11-12")).otherwise(F.lit("")))
        j = lines(s, d, F.struct(F.lit("function_call").alias("type"), millis().alias("timestamp"), t("session_id", "sessionId"), cwd.alias("cwd"), F.struct("model", raw.alias("rawUsage")).alias("providerData")))
        return ingest.workbuddy(s, [], NOW, j).select("project", "session_id", "model", *back.split(", "), "fingerprint")

    add("ing_05_fn_05_workbuddy", as_workbuddy, f"SELECT project, session_id, model, {back}, concat(project, '/', session_id, '.jsonl:', event_id) AS fingerprint FROM raw WHERE {_FOUR}")

    def as_deepseek(s: SparkSession, d: str) -> DataFrame:
        """Compressed session files of 1,000 events; a file that can't be unpacked among them."""
        u = F.struct(t("input_tokens", "inputTokens"), t("output_tokens", "outputTokens"), t("cache_read_tokens", "cacheReadTokens"), t("cache_write_tokens", "cacheWriteTokens"))
        e = unpriced(s, d).withColumn("line", F.to_json(F.struct(F.lit("assistant/message").alias("type"), millis().alias("time"), F.struct(t("event_id", "turn"), F.lit(1).alias("step"), u.alias("usage"), F.struct(F.struct("model").alias("source")).alias("message")).alias("data"))))
        bodies = e.groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.array_join(F.collect_list("line"), "\n").alias("body"))

        def pack(frames):
            import pyarrow as pa

            for f in frames:
                f["content"] = [pa.compress(x.encode(), "zstd", asbytes=True) for x in f.body]
                yield f[["rel", "content"]]

        named = bodies.select(F.concat(F.lit("f"), "part", F.lit(".jsonl.zstd")).alias("rel"), F.concat(F.lit('{"type":"session","id":"s'), "part", F.lit('","cwd":"/w/app"}\n'), "body").alias("body"))
        packed = named.mapInPandas(pack, "rel string, content binary").union(s.createDataFrame([("bad.jsonl.zstd", b"no zstd")], "rel string, content binary"))
        return ingest.deepseek(s, [], NOW, files.compressed_lines(s, [], files=packed)).select("project", "session_id", "model", *back.split(", "), "fingerprint")

    add("ing_11_src_08_deepseek", as_deepseek, f"SELECT 'app' AS project, concat('s', event_id // 1000) AS session_id, model, {back}, concat('f', event_id // 1000, '.jsonl.zstd:', event_id, ':1') AS fingerprint FROM raw WHERE {_FOUR}")

    def as_pi(s: SparkSession, d: str) -> DataFrame:
        """Conversations: system turns change the model, assistant turns bill, tool turns bill under the model before."""
        c = s.read.parquet(f"{d}/conversations.parquet")
        u = F.struct(F.length("text").alias("input"), F.lit(1).alias("output"), F.lit(0).alias("cacheRead"), F.lit(0).alias("cacheWrite"))
        change = F.to_json(F.struct(F.lit("model_change").alias("type"), t("text", "modelId")))
        sent = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("e"), "turn").alias("id"), F.struct(F.lit("toolResult").alias("role"), u.alias("usage")).alias("message")))
        line = F.when(F.col("role") == "system", change).when(F.col("role") == "assistant", sent).otherwise("{bad")
        j = c.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("rel"), F.col("turn").alias("line_idx"), line.alias("line"), F.lit(0).cast("long").alias("raw_bytes"))
        return ingest.pi(s, [], NOW, j).select("model", "input_tokens", "output_tokens", "fingerprint")

    add("ing_12_pi", as_pi, "SELECT coalesce(m, '') AS model, CAST(length(text) AS BIGINT) AS input_tokens, CAST(1 AS BIGINT) AS output_tokens, concat('c', conv_id, '.jsonl:e', turn) AS fingerprint FROM (SELECT *, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM conversations) WHERE role = 'assistant'", "")

    def claude_lines(s: SparkSession, d: str) -> DataFrame:
        u = F.struct(t("input_tokens", "input_tokens"), t("output_tokens", "output_tokens"), t("cache_write_tokens", "cache_creation_input_tokens"), t("cache_read_tokens", "cache_read_input_tokens"))
        stamp = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return unpriced(s, d).select("project", F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), F.struct("model", u.alias("usage")).alias("message"))).alias("value"))

    logs = {"claude": (r"(?i)\.txt$", 8)}

    def collected(s: SparkSession, d: str, streamed: bool = False) -> DataFrame:
        """Log files through the whole job: half of the projects, all of them, and once more without a change."""
        top = work_folder(s, "collect")
        t_, data = store.UsageStore(s, f"{top}/store"), claude_lines(s, d)
        first = F.col("project") < "proj-4"
        data.where(first).write.partitionBy("project").text(f"{top}/logs/a")
        made = []
        with collect.reading(logs, {"claude": lambda spark, roots, now: ingest.claude(spark, roots, now, files.json_lines(spark, roots, *logs["claude"]))}):
            for k in (1, 2, 3):
                if k == 2:
                    data.where(~first).write.partitionBy("project").text(f"{top}/logs/b")
                made += [(r.scan_id, r.found, r.inserted) for r in collect.collect(s, t_, {"claude": [(f"{top}/logs", None)]}, NOW, k).collect()]
        return t_.usage().groupBy("model").agg(F.count("*").alias("records"), F.sum("cost_micros").alias("cost_micros")).withColumn("scans", F.lit(str(len(made))))

    by_model = f"SELECT model, count(*) AS records, CAST(sum(c) AS BIGINT) AS cost_micros, '{{}}' AS scans FROM (SELECT model, {_COST} AS c FROM (SELECT * REPLACE ('claude' AS provider) FROM raw) r LEFT JOIN prices ON prices.id = {_PRICE_ID} WHERE {_FOUR}) GROUP BY 1"
    add("ing_16_collect", collected, by_model.format(2))

    def streamed(s: SparkSession, d: str) -> DataFrame:
        """Raw log files as a stream, in two steps, and once more without new files."""
        top = work_folder(s, "log-stream")
        t_ = store.UsageStore(s, f"{top}/store")
        for k in range(3):
            if k < 2:
                claude_lines(s, d).where((F.col("project") < "proj-4") == (k == 0)).write.mode("append").partitionBy("project").text(f"{top}/logs")
            usage_stream.ingest_logs(usage_stream.log_files(s, f"{top}/logs", r"\.txt$"), ingest.claude, t_, f"{top}/state", NOW).awaitTermination()
        return t_.usage().groupBy("model").agg(F.count("*").alias("records"), F.sum("cost_micros").alias("cost_micros")).withColumn("scans", F.lit("2"))

    add("str_01_02_log_stream", streamed, by_model.format(2))
    add("fn_03_split_cached", lambda s, d: unpriced(s, d).select("fingerprint", *[c.alias(n) for c, n in zip(tokens.split_cached(F.col("input_tokens"), F.col("cache_read_tokens") * 2), ("fresh", "cached"))]),
        "SELECT fingerprint, input_tokens - least(input_tokens, cache_read_tokens * 2) AS fresh, least(input_tokens, cache_read_tokens * 2) AS cached FROM raw")
    add("fn_06_workspace", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tokens.workspace_name(F.concat(F.lit("file:///w/"), F.col("page_id"), F.lit("-x"))).alias("name")),
        "SELECT page_id, concat(page_id, '-x') AS name FROM pages", "")
    add("fn_08_trae_model", lambda s, d: unpriced(s, d).select("model").distinct().select("model", tokens.trae_model(F.concat(F.lit(" "), "model", F.lit("-X "))).alias("name")), "SELECT DISTINCT model, lower(concat(model, '-X')) AS name FROM raw")


for register in (_rollups, _filters, _series, _metrics_and_prices, _storage, _streams, _raw_logs, _sources, _embedded, _more_logs):
    register()
