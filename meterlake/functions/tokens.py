"""Scalar functions on token counts, paths, names and timestamps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BUCKETS


def total_tokens(*columns: str) -> Column:
    a, *rest = columns or BUCKETS
    out = F.col(a)
    for c in rest:
        out = out + F.col(c)
    return out


def count(c: Column) -> Column:
    """A token count: null and negative count 0."""
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")


def fresh_input(total: Column, *cached: Column) -> Column:
    """Input without its cached parts; never negative."""
    for c in cached:
        total = total - c
    return F.greatest(total, F.lit(0)).cast("long")


def split_cached(total: Column, cached: Column) -> tuple[Column, Column]:
    """(fresh, cache_read) of a total of which at most all is cached."""
    read = F.least(total, cached)
    return total - read, read


def leaf(path: Column) -> Column:
    """Last component of a path with either separator; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), F.lit(""))


def project_of(path: Column) -> Column:
    return F.coalesce(leaf(path), F.lit("unknown"))


def launch_project(path: Column) -> Column:
    """Folders named by their launch time take their parent's name."""
    name = leaf(path)
    parent = leaf(F.regexp_replace(path, r"[/\\]*[^/\\]+[/\\]*$", ""))
    return F.coalesce(F.when(name.rlike(r"^\d{4}(-\d{2}){5}$"), F.coalesce(parent, name)).otherwise(name), F.lit("unknown"))


def workspace_name(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^file:///(?:.*/)?([^/]+)/*$", 1), F.lit(""))


def hit_rate(cache_read: Column, fresh: Column) -> Column:
    """Percent of input that came from cache, of aggregated counts; 0 without input."""
    whole = cache_read + fresh
    return F.when(whole == 0, F.lit(0.0)).otherwise(cache_read.cast("double") / whole * 100)


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def from_rfc3339(c: Column) -> Column:
    """UTC wall clock of an RFC 3339 text, else null, whatever the session's time zone."""
    whole = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1)
    clock = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 2)
    sign = F.when(F.regexp_extract(c, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    minutes = F.coalesce(F.nullif(F.regexp_extract(c, r"[+-](\d{2}):\d{2}$", 1), F.lit("")).cast("int"), F.lit(0)) * 60 + F.coalesce(
        F.nullif(F.regexp_extract(c, r"[+-]\d{2}:(\d{2})$", 1), F.lit("")).cast("int"), F.lit(0)
    )
    at = F.concat(whole, F.lit(" "), clock).try_cast("timestamp_ntz")
    return F.when(c.rlike(RFC3339), at - F.make_dt_interval(mins=F.when(c.rlike(r"[+-]\d{2}:\d{2}$"), sign * minutes).otherwise(0)))


def from_millis(c: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(c.cast("decimal(18,3)") / 1000).cast("decimal(18,6)"))


def from_seconds(c: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))


#: Display names of models of one tool and their canonical ids (fixed values).
TRAE_MODELS = {
    "gpt-5.3": "gpt-5.3-codex",
    "gpt-5.3 codex": "gpt-5.3-codex",
    "gpt-5.2": "gpt-5.2-codex",
    "gpt-5.2 codex": "gpt-5.2-codex",
    "gpt-5.1": "gpt-5.1-codex",
    "gpt-5.1 codex": "gpt-5.1-codex",
    "gemini 3.1 pro": "gemini-3.1-pro",
    "gemini 3.1": "gemini-3.1",
    "glm 5.1": "glm-5.1",
    "claude sonnet 4.6": "claude-sonnet-4.6",
    "claude sonnet 4.5": "claude-sonnet-4.5",
}


def trae_model(name: Column) -> Column:
    low = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for pair in TRAE_MODELS.items() for x in pair])
    return F.coalesce(known[low], low)


def normalize_model(model: Column) -> Column:
    """Canonical id of a model name; null for empty names and <synthetic>."""
    m = F.lower(F.trim(model))
    empty = (m == "") | (m == "<synthetic>")
    m = F.regexp_replace(F.regexp_replace(m, r"^\s+|\s+$", ""), r"\s+", "-")
    m = F.regexp_replace(m, "(:free|-free)$", "")
    dotted = F.regexp_replace(m, r"-(\d+)-(\d+)$", "-$1.$2")
    vendor = lambda name: F.concat(F.lit(name + "/"), m)
    return (
        F.when(model.isNull() | empty, F.lit(None))
        .when(m.contains("/"), m)
        .when(m.startswith("claude"), F.concat(F.lit("anthropic/"), dotted))
        .when(m.rlike("^(gpt|chatgpt|o[0-9])"), vendor("openai"))
        .when(m.startswith("gemini"), vendor("google"))
        .when(m.startswith("grok"), vendor("x-ai"))
        .when(m.startswith("qwen"), vendor("qwen"))
        .when(m.startswith("deepseek"), vendor("deepseek"))
        .when(m.startswith("glm"), vendor("z-ai"))
        .when(m.startswith("mimo"), vendor("xiaomi"))
        .when(m.isin("hy3", "hy3-preview"), vendor("tencent"))
        .otherwise(m)
    )
