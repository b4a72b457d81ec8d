"""Quotas by provider and period: limits of 0 are unlimited."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar

PERIODS = ("day", "week", "month", "all")


def upsert(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("used_tokens", "used_cost_micros")) -> DataFrame:
    """`new` limits over `old`, by (provider, period); columns in `keep` stay as they were."""
    keys = ["provider", "period"]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    cols = [F.coalesce(f"o.{c}", F.lit(0)).alias(c) if c in keep or c not in new.columns else F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns if c not in keys]
    return both.select(*keys, *cols)


def refresh(quotas: DataFrame, usage: DataFrame, now: datetime) -> DataFrame:
    """Quotas with what their provider has used inside the current period, what remains, and percent.

    Usage is summed by provider and day first; the quotas then meet those few rows.
    """
    spark = quotas.sparkSession
    bounds = spark.createDataFrame([(p, *calendar.current(p, now)) for p in PERIODS], "period string, lo timestamp_ntz, hi timestamp_ntz")
    q = quotas.select("provider", "period", "limit_tokens", "limit_cost_micros").join(bounds, "period", "left")
    # `all` ends at now, inside a day, so days are cut there as well. Without a quota on all time older days aren't read.
    before = usage.withColumn("past", F.col("started_at") < calendar.literal(now))
    if stored := calendar.stored_day(usage):
        since = q.agg(F.min("lo")).first()[0]
        before = before.where(F.col(stored) >= calendar.day(calendar.literal(since))) if since else before
    daily = before.groupBy(F.col("provider").alias("p"), calendar.day("started_at").alias("d"), "past").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).alias("tokens"), F.sum("cost_micros").alias("cost")
    )
    inside = (F.col("provider") == F.col("p")) & (F.col("d") >= calendar.day("lo")) & F.when(F.col("period") == "all", F.col("past")).otherwise(F.col("d") < calendar.day("hi"))
    used = q.join(daily, inside, "left").groupBy("provider", "period", "limit_tokens", "limit_cost_micros").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("used_tokens"), F.coalesce(F.sum("cost"), F.lit(0)).alias("used_cost_micros")
    )
    left = F.when(F.col("limit_tokens") > 0, F.greatest(F.col("limit_tokens") - F.col("used_tokens"), F.lit(0)))
    percent = F.when(F.col("limit_tokens") > 0, F.col("used_tokens") / F.col("limit_tokens") * 100)
    return used.withColumns({"remaining_tokens": left, "percent_used": percent})
