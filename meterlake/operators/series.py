"""Series by day and hour, gaps filled from spines, streaks, and the contribution grid."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from .aggregate import STATS, merge, rollup, stats, with_total


def _all():
    return Window.partitionBy()


def daily(usage: DataFrame, *dims: str, window: calendar.Window | None = None) -> DataFrame:
    """Sums by day (a date), optionally by further dimensions; days without usage have no row."""
    if window is not None:
        usage = usage.where(calendar.within(window, day_column=calendar.stored_day(usage)))
    keys = [*dims, calendar.day("started_at").alias("day")]
    return with_total(usage.groupBy(*keys).agg(*stats())).orderBy(*dims, "day")


def model_series(by_provider_model: DataFrame) -> DataFrame:
    """Series of models over all providers, from the series by provider and model."""
    return merge(by_provider_model, "model", "day").orderBy("model", "day")


def hours(usage: DataFrame, day: date) -> DataFrame:
    """24 rows of one day, hours without usage zero."""
    spark = usage.sparkSession
    found = rollup(usage, "hour", window=calendar.custom(day, day))
    spine = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(found, "hour", "left").fillna(0).orderBy("hour")


def hours_of_day(usage: DataFrame, day: date) -> DataFrame:
    return rollup(usage, "hour", window=calendar.custom(day, day)).orderBy("hour")


def peak_hour(hourly: DataFrame) -> DataFrame:
    """The busiest hour, the first of equals; no row if nothing was used."""
    top = hourly.agg(F.max_by("hour", F.struct("total_tokens", -F.col("hour"))).alias("hour"), F.max("total_tokens").alias("total_tokens"))
    return top.where("total_tokens > 0")


def hour_bars(hourly: DataFrame) -> DataFrame:
    """Bars relative to the busiest hour: of 4 rows (rounded, 1 at least) and 8 cells (rounded up)."""
    most = F.max("total_tokens").over(_all())
    share = F.when(most > 0, F.col("total_tokens") / most).otherwise(0.0)
    some = F.col("total_tokens") > 0
    return hourly.select(
        "hour", "total_tokens",
        F.when(some, F.greatest(F.round(share * 4), F.lit(1.0))).otherwise(0).cast("int").alias("bar_rows"),
        F.when(some, F.ceil(share * 8)).otherwise(0).cast("int").alias("bar_cells"),
    )


def trend(days: DataFrame, span_days: int) -> DataFrame:
    """Days, weeks from Monday or months, by the span: up to 14 days, up to 120, beyond."""
    unit = "day" if span_days <= 14 else "week" if span_days <= 120 else "month"
    start = F.date_trunc(unit, F.col("day")).cast("date").alias("bucket_start")
    sums = [F.sum(c).alias(c) for c in STATS]
    return with_total(days.groupBy(start).agg(*sums)).orderBy("bucket_start")


def _trailing(days: DataFrame, today: date, n: int = 365) -> DataFrame:
    return days.where(F.col("day").between(F.lit(today - timedelta(days=n - 1)), F.lit(today)))


def streaks(days: DataFrame, today: date) -> DataFrame:
    """first_day, last_day, length of each run of days with tokens in the trailing year."""
    active = _trailing(days, today).where("total_tokens > 0").select("day").distinct()
    # At most 365 rows, whatever the table's size.
    island = F.date_sub(F.col("day"), F.row_number().over(Window.orderBy("day")))
    return active.select("day", island.alias("island")).groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("island")


def longest_streak(days: DataFrame, today: date) -> DataFrame:
    return streaks(days, today).agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest_streak"))


def current_streak(days: DataFrame, today: date) -> DataFrame:
    """The run that ends today, or yesterday while today is empty; else 0."""
    live = F.col("last_day") >= F.lit(today - timedelta(days=1))
    return streaks(days, today).agg(F.coalesce(F.max(F.when(live, F.col("length"))), F.lit(0)).alias("current_streak"))


def activity(days: DataFrame, today: date) -> DataFrame:
    """One row: tokens, cost, active days and streaks of the trailing year, from one pass over its (at most 365) days."""
    by_day = _trailing(days, today).groupBy("day").agg(F.sum("total_tokens").alias("t"), F.sum("cost_micros").alias("c"))
    active = F.col("t") > 0
    rank = F.sum(active.cast("int")).over(Window.orderBy("day")).cast("int")
    runs = by_day.withColumn("island", F.when(active, F.date_sub("day", rank))).groupBy("island").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c"), F.when(F.col("island").isNotNull(), F.count("*")).alias("n"), F.max("day").alias("last_day")
    )
    live = F.col("last_day") >= F.lit(today - timedelta(days=1))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return runs.agg(
        zero(F.sum("t")).alias("total_tokens"), zero(F.sum("c")).alias("cost_micros"), zero(F.sum("n")).alias("active_days"), zero(F.max("n")).alias("longest_streak"), zero(F.max(F.when(live, F.col("n")))).alias("current_streak")
    )


def busiest_day(days: DataFrame, today: date) -> DataFrame:
    """Most tokens, then cost, then the earliest; no row without tokens."""
    return _trailing(days, today).where("total_tokens > 0").orderBy(F.desc("total_tokens"), F.desc("cost_micros"), "day").select("day", "total_tokens", "cost_micros").limit(1)


def level(value: Column, most: Column) -> Column:
    """Intensity 0 to 4: 0 without use, quarters of the most used day, 1 at least."""
    quarter = F.least(F.greatest(F.floor(value * 4 / F.when(most > 0, most)), F.lit(1)), F.lit(4))
    return F.when(value <= 0, 0).otherwise(F.coalesce(quarter, F.lit(1))).cast("int")


def grid_start(today: date, n: int = 365) -> date:
    first = today - timedelta(days=n - 1)
    return first - timedelta(days=(first.weekday() + 1) % 7)


def grid(days: DataFrame, today: date) -> DataFrame:
    """A cell for each day from the Sunday on or before today - 364: week, weekday (Sunday 0), tokens, level."""
    start = grid_start(today)
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(today))).alias("day"))
    used = days.select("day", "total_tokens", "cost_micros")
    cells = spine.join(used, "day", "left").fillna(0)
    return cells.select(
        "day",
        F.floor(F.datediff("day", F.lit(start)) / 7).cast("int").alias("week"),
        (F.dayofweek("day") - 1).alias("weekday"),
        "total_tokens", "cost_micros",
        level(F.col("total_tokens"), F.max("total_tokens").over(_all())).alias("level"),
    ).orderBy("day")


def level_histogram(cells: DataFrame) -> DataFrame:
    """Days with usage on each level 0 to 4."""
    n = cells.where("total_tokens > 0").groupBy("level").agg(F.count("*").alias("days"))
    spine = cells.sparkSession.range(5).select(F.col("id").cast("int").alias("level"))
    return spine.join(n, "level", "left").fillna(0).orderBy("level")


def day_detail(days: DataFrame, day: date) -> DataFrame:
    return days.where(F.col("day") == F.lit(day)).select("day", "total_tokens", "cost_micros")
