"""Filters of usage, and the selection of tracked providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.tokens import total_tokens
from ..schema import PROVIDERS


def in_window(usage: DataFrame, window: calendar.Window, provider: str | None = None, project: str | None = None) -> DataFrame:
    """Rows of a half-open window by time; optionally of one provider or project."""
    p = calendar.within(window, day_column=calendar.stored_day(usage))
    if provider is not None:
        p &= F.col("provider") == provider
    if project is not None:
        p &= F.col("project") == project
    return usage.where(p).orderBy("started_at", "fingerprint")


def by_fingerprint(usage: DataFrame, fingerprint: str) -> DataFrame:
    """The row of a fingerprint, or none: fingerprints are unique in a stored table."""
    return usage.where(F.col("fingerprint") == fingerprint).limit(1)


def billed(usage: DataFrame) -> DataFrame:
    return usage.where(total_tokens() > 0)


def used(aggregates: DataFrame) -> DataFrame:
    return aggregates.where("records > 0")


def provider_dimension(spark: SparkSession) -> DataFrame:
    rows = [(p, name, k) for k, (p, name) in enumerate(PROVIDERS.items())]
    return spark.createDataFrame(rows, "provider string, display_name string, registry_order int")


def normalize_selection(selection: DataFrame, providers: DataFrame) -> DataFrame:
    """(provider, enabled, position) without repeats (the first stays), missing providers appended enabled."""
    first = Window.partitionBy("provider").orderBy("position")
    s = selection.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    both = providers.join(s, "provider", "left")
    order = Window.orderBy(F.col("position").isNull(), "position", "registry_order")
    return both.select("provider", F.coalesce("enabled", F.lit(True)).alias("enabled"), (F.row_number().over(order) - 1).alias("position"))


def set_enabled(selection: DataFrame, provider: str, enabled: bool) -> DataFrame:
    return selection.withColumn("enabled", F.when(F.col("provider") == provider, F.lit(enabled)).otherwise(F.col("enabled")))


def move_entry(selection: DataFrame, provider: str, to: int) -> DataFrame:
    """The provider at position `to`, the others in order around it."""
    mine = F.col("provider") == provider
    order = Window.orderBy(F.when(mine, F.lit(2 * to)).otherwise(2 * F.col("rest") + F.when(F.col("rest") >= to, 1).otherwise(-1)), "provider")
    others = Window.partitionBy(mine).orderBy("position")
    ranked = selection.withColumn("rest", F.row_number().over(others) - 1)
    return ranked.select("provider", "enabled", (F.row_number().over(order) - 1).alias("position"))


def tracked(usage: DataFrame, selection: DataFrame) -> DataFrame:
    return usage.join(selection.where("enabled").select("provider"), "provider", "left_semi")
