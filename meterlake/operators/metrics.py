"""Metrics of aggregated usage, and rankings by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import hit_rate


def metric(name: str) -> Column:
    return {
        "total": F.col("total_tokens").cast("double"),
        "output": F.col("output_tokens").cast("double"),
        "input": F.col("input_tokens").cast("double"),
        "cache_read": F.col("cache_read_tokens").cast("double"),
        "hit_rate": hit_rate(F.col("cache_read_tokens"), F.col("input_tokens")),
        "cost_usd": F.col("cost_micros") / 1e6,
    }[name]


METRICS = ("total", "output", "input", "cache_read", "hit_rate", "cost_usd")


def unpivoted(aggregates: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value): every metric from one aggregation."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("value")) for m in METRICS])
    return aggregates.select(*keys, F.inline(pairs))


def ranked(aggregates: DataFrame, key: str, name: str) -> DataFrame:
    return aggregates.select(key, metric(name).alias("value")).orderBy(F.desc("value"), key)


def shares(aggregates: DataFrame, key: str, name: str) -> DataFrame:
    """Share of each row in the whole; no rows if the whole is 0. The hit rate weighs by all input."""
    weight = F.col("cache_read_tokens") + F.col("input_tokens") if name == "hit_rate" else metric(name)
    v = aggregates.select(key, weight.cast("double").alias("value"))
    return v.withColumn("share", F.col("value") / F.nullif(F.sum("value").over(Window.partitionBy()), F.lit(0.0))).where("share is not null")


def top(aggregates: DataFrame, key: str, n: int = 8) -> DataFrame:
    return aggregates.orderBy(F.desc("total_tokens"), key).limit(n)


def top_per(aggregates: DataFrame, group: str, key: str, n: int = 8) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("total_tokens"), key)
    return aggregates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def model_counts(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(F.countDistinct("model").alias("models"))
