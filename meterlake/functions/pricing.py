"""Prices in USD per million tokens, resolution of model names, and costs in whole micro-USD.

Names are resolved on the distinct (provider, model) pairs only, and the few results are joined back to
the facts; cost is rounded for each record and then summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import normalize_model

PRICE = "id string, input double, output double, cache_read double, cache_write double"

#: Default prices: id, input, output, cache read, cache write (fixed values).
DEFAULTS = [
    ("anthropic/claude-opus-4.8", 5.0, 25.0, 0.5, 6.25),
    ("anthropic/claude-sonnet-4.6", 3.0, 15.0, 0.3, 3.75),
    ("anthropic/claude-haiku-4.5", 1.0, 5.0, 0.1, 1.25),
    ("openai/gpt-5.5", 5.0, 30.0, 0.5, 0.0),
    ("qwen/qwen3.7-max", 1.25, 3.75, 0.25, 1.5625),
    ("deepseek/deepseek-v4-pro", 0.435, 0.87, 0.0036, 0.0),
    ("google/gemini-3.5-flash", 1.5, 9.0, 0.15, 0.0833),
    ("google/gemini-3.1-pro-preview", 2.0, 12.0, 0.2, 0.375),
    ("x-ai/grok-4.5", 2.0, 6.0, 0.3, 0.0),
    ("tencent/hy3", 0.14, 0.58, 0.035, 0.0),
    ("tencent/hy3-preview", 0.063, 0.21, 0.021, 0.0),
]
#: Overriding prices and aliases (fixed values).
OVERRIDES = [
    ("qwen/qwen3.7-plus", 0.39, 1.16, 0.078, 0.49),
    ("deepseek/deepseek-v4-flash", 0.14, 0.28, 0.0028, 0.0),
]
ALIASES = {
    "qwen3.7-plus": "qwen/qwen3.7-plus",
    "qwen-latest-series-invite-beta-v23": "qwen/qwen3.7-plus",
    "gemini-3-pro-preview": "google/gemini-3.1-pro-preview",
}
#: Keywords of model families in order, and the id that stands for each (fixed values).
FAMILIES = {
    "opus": "anthropic/claude-opus-4.8",
    "sonnet": "anthropic/claude-sonnet-4.6",
    "haiku": "anthropic/claude-haiku-4.5",
    "gpt-5": "openai/gpt-5.5",
    "qwen": "qwen/qwen3.7-max",
    "deepseek": "deepseek/deepseek-v4-pro",
    "glm": "z-ai/glm-5",
    "mimo": "xiaomi/mimo-v2.5-pro",
    "hy3": "tencent/hy3",
}
#: Input (cached part included) beyond which one provider charges more (fixed value).
HIGH_CONTEXT = 272_000


def price_table(spark: SparkSession, base: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Defaults, under `base` prices, under overrides: one row an id."""
    parts = [(spark.createDataFrame(DEFAULTS, PRICE), 2)]
    if base is not None:
        parts.append((base, 1))
    parts.append((overrides if overrides is not None else spark.createDataFrame(OVERRIDES, PRICE), 0))
    rows = None
    for df, prio in parts:
        df = df.withColumn("prio", F.lit(prio))
        rows = df if rows is None else rows.unionByName(df)
    best = Window.partitionBy("id").orderBy("prio")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "prio")


def resolve(models: DataFrame, prices: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """provider, model, price_id, price_source and prices of the distinct (provider, model) of `models`."""
    m = models.select("provider", "model").distinct()
    name = F.regexp_replace(F.col("model"), r"^\s+|\s+$", "")
    low = F.lower(name)
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[name] if aliases else F.lit(None)
    m = m.withColumns({"alias_id": alias, "norm_id": normalize_model(F.col("model"))})
    known = prices.select(F.col("id").alias("norm_id"), F.lit(True).alias("is_known"))
    m = m.join(known, "norm_id", "left")
    family = F.when(low.contains("gemini") & low.contains("pro"), F.lit("google/gemini-3.1-pro-preview")).when(low.contains("gemini"), F.lit("google/gemini-3.5-flash"))
    keyword = F.lit(None)
    for k, v in reversed(FAMILIES.items()):
        keyword = F.when(low.contains(k), F.lit(v)).otherwise(keyword)
    default = F.when(F.col("provider") == "codex", F.lit("openai/gpt-5.5")).otherwise(F.lit("anthropic/claude-opus-4.8"))
    none = F.col("norm_id").isNull()
    exact = F.when(F.col("is_known"), F.col("norm_id"))
    m = m.withColumns(
        {
            "price_id": F.when(~none, F.coalesce("alias_id", exact, family, keyword, default)),
            "price_source": F.when(none, "none").when(F.col("alias_id").isNotNull(), "alias").when(exact.isNotNull(), "exact").when(family.isNotNull(), "gemini").when(keyword.isNotNull(), "family").otherwise("default"),
        }
    )
    p = prices.select(F.col("id").alias("price_id"), *[F.col(c).alias(f"price_{c}") for c in ("input", "output", "cache_read", "cache_write")])
    return m.join(p, "price_id", "left").select("provider", "model", "price_id", "price_source", *p.columns[1:])


def cost_micros() -> Column:
    """Cost of one record beside its price_* columns; without a price 0."""
    t = lambda c: F.col(c).cast("double")
    high = (F.col("provider") == "codex") & (F.col("input_tokens") + F.col("cache_read_tokens") > HIGH_CONTEXT)
    p_in = F.col("price_input") * F.when(high, 2.0).otherwise(1.0)
    p_read = F.col("price_cache_read") * F.when(high, 2.0).otherwise(1.0)
    p_out = F.col("price_output") * F.when(high, 1.5).otherwise(1.0)
    codex = t("input_tokens") * p_in + t("cache_read_tokens") * p_read + t("output_tokens") * p_out
    other = t("input_tokens") * F.col("price_input") + t("output_tokens") * F.col("price_output") + t("cache_read_tokens") * F.col("price_cache_read") + t("cache_write_tokens") * F.col("price_cache_write")
    micros = F.when(F.col("provider") == "codex", codex).otherwise(other)
    return F.coalesce(F.greatest(F.round(micros), F.lit(0.0)), F.lit(0.0)).cast("long")


def price(usage: DataFrame, prices: DataFrame | None = None, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """`usage` with cost_micros computed anew (also the re-pricing of stored history)."""
    prices = price_table(usage.sparkSession) if prices is None else prices
    r = resolve(usage, prices, aliases).select(F.col("provider").alias("p"), F.col("model").alias("m"), *[f"price_{c}" for c in ("input", "output", "cache_read", "cache_write")])
    # A row a name of a model, broadcast: dealt by their names, all facts would be shuffled into as many tasks as names are in use.
    joined = usage.join(F.broadcast(r), F.col("provider").eqNullSafe(F.col("p")) & F.col("model").eqNullSafe(F.col("m")), "left")
    return joined.withColumn("cost_micros", cost_micros()).select(*[c for c in usage.columns if c != "cost_micros"], "cost_micros")
