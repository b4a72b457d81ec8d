"""Aggregates of usage: six sums by any dimensions, one partial and one final hash aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.tokens import total_tokens
from ..schema import SUMS

STATS = ("records", *SUMS)

DIMENSIONS: dict[str, Column | str] = {"provider": "provider", "model": "model", "project": "project", "session": "session_id"}


def dimension(name: str) -> Column:
    keys = {"day": calendar.day_key, "week": calendar.week_key, "month": calendar.month_key, "hour": calendar.hour_key}
    return (keys[name]("started_at") if name in keys else F.col(DIMENSIONS[name])).alias(name)


def stats() -> list[Column]:
    return [F.count("*").alias("records"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]]


def with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total_tokens", total_tokens())


def rollup(usage: DataFrame, *dims: str, window: calendar.Window | None = None, order: str = "cost_micros") -> DataFrame:
    """Sums by dimensions (provider, model, project, session, day, week, month, hour) in a window.

    Descending by `order` (cost_micros or total_tokens), ties by the keys; without dimensions one row,
    zeros when empty.
    """
    if window is not None:
        usage = usage.where(calendar.within(window, day_column="day" if "day" in usage.columns else None))
    if not dims:
        return with_total(usage.agg(*stats()))
    out = with_total(usage.groupBy(*[dimension(d) for d in dims]).agg(*stats()))
    return out.orderBy(F.desc(order), *dims)


def merge(parts: DataFrame, *dims: str) -> DataFrame:
    """Sums of pre-aggregated rows: sums of sums."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS]
    return with_total(parts.groupBy(*dims).agg(*sums) if dims else parts.agg(*sums))


def models_by_provider(usage: DataFrame, window: calendar.Window | None = None) -> DataFrame:
    """One row a provider with its models nested, each dearest first."""
    flat = rollup(usage, "provider", "model", window=window)
    model = F.struct((-F.col("cost_micros")).alias("order"), "model", *STATS, "total_tokens")
    out = flat.groupBy("provider").agg(*[F.sum(c).alias(c) for c in STATS], F.array_sort(F.collect_list(model)).alias("models"))
    return with_total(out).orderBy(F.desc("cost_micros"), "provider")


def distinct_projects(usage: DataFrame) -> DataFrame:
    return usage.select("project").distinct().orderBy("project")


def projects_by_tokens(usage: DataFrame, window: calendar.Window | None = None) -> DataFrame:
    return rollup(usage, "project", window=window, order="total_tokens")
