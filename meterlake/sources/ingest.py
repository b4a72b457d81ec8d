"""One job a tool: raw logs to usage rows. Each takes (spark, roots, run_ts); `run_ts` stands in for missing times.

State that lines of a file hand on (session, project, model) is a window over the file's lines in order;
a file is a bounded partition. Number columns with a wrong type read as null and count 0; strict tools
drop such lines instead. Rows without tokens are dropped; cost is left 0 for the pricing step.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.tokens import count, fresh_input, from_millis, from_rfc3339, from_seconds, launch_project, leaf, project_of, split_cached, total_tokens, trae_model, workspace_name
from ..schema import USAGE
from .files import MAX_DEPTH, Root, compressed_lines, database_rows, documents, json_lines
from .wire import generation, workspace_uri

#: Files of the desktop tool's requests, and of the ledger of sessions.
DESKTOP, LEDGER = r"[^/]+/[^/]+/index\.json$", r"workbuddy\.db$"
COLUMNS = [c.strip().split()[0] for c in USAGE.split(",")]
_JSON = {"columnNameOfCorruptRecord": "_corrupt"}

parent_name = lambda rel: F.coalesce(F.nullif(F.regexp_extract(rel, r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit("unknown"))
stem = lambda rel: F.regexp_extract(rel, r"([^/]+?)(\.[^./]*)?$", 1)


def with_json(rows: DataFrame, j: Column) -> DataFrame:
    """Rows with `j`, parsed once: as a plain column Spark would parse it again for each use of a field."""
    return rows.select("*", F.explode(F.array(j)).alias("j"))


def parsed(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    if strict:
        schema += ", _corrupt string"
    out = with_json(lines, F.from_json("line", schema, _JSON if strict else None))
    return out.where("j._corrupt is null") if strict else out


def carry(state: Column) -> Column:
    """The last non-null state of the file's lines up to this one."""
    in_file = Window.partitionBy("rel").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(state, ignorenulls=True).over(in_file)


def finish(rows: DataFrame, provider: str, run_ts: datetime, **columns) -> DataFrame:
    """Usage rows from expressions; missing ones are empty, 0 or `run_ts`. Rows with an `error` stay, with it and their `rel`. `ord`, in jobs whose rows may share a key: the row's place, the first of which counts."""
    values = {
        "provider": F.lit(provider), "project": F.lit("unknown"), "session_id": F.lit(""), "model": F.lit(""), "started_at": F.lit(None).cast("timestamp_ntz"),
        "input_tokens": F.lit(0), "output_tokens": F.lit(0), "cache_read_tokens": F.lit(0), "cache_write_tokens": F.lit(0), "cost_micros": F.lit(0), "raw_bytes": F.lit(0),
    } | columns
    values["started_at"] = F.coalesce(values["started_at"], calendar.literal(run_ts))
    text = ("provider", "project", "session_id", "model", "fingerprint")
    cast = {c: values[c].cast("string") if c in text else values[c] if c == "started_at" else values[c].cast("long") for c in COLUMNS}
    order = [values["ord"].cast("long").alias("ord")] if "ord" in values else []
    if "error" not in rows.columns:
        return rows.select(*[cast[c].alias(c) for c in COLUMNS], *order).where(total_tokens() > 0)
    return rows.select(*[cast[c].alias(c) for c in COLUMNS], *order, "rel", "error").where((total_tokens() > 0) | F.col("error").isNotNull())


def kept(rows: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that a job bills, and those that hold an error."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return rows.where(condition | F.col("error").isNotNull()) if "error" in rows.columns else rows.where(condition)


def line_key(*parts: Column) -> Column:
    return F.concat_ws(":", F.col("rel"), *[p.cast("string") for p in parts])


def claude(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    j = parsed(json_lines(spark, roots) if lines is None else lines, "type string, timestamp string, message struct<model: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint>>")
    u = F.col("j.message.usage")
    return finish(
        j.where((F.col("j.type") == "assistant") & u.isNotNull()), "claude", run_ts,
        project=parent_name(F.col("rel")), session_id=stem(F.col("rel")), model=F.coalesce("j.message.model", F.lit("")), started_at=from_rfc3339(F.col("j.timestamp")),
        input_tokens=count(u["input_tokens"]), output_tokens=count(u["output_tokens"]), cache_read_tokens=count(u["cache_read_input_tokens"]), cache_write_tokens=count(u["cache_creation_input_tokens"]),
        raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.col("line_idx")),
    )


def codex(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    """Lines of a stream bring the state as of each line along (sid, cwd, model); others carry it from line to line."""
    j = parsed(
        json_lines(spark, roots) if lines is None else lines,
        "type string, timestamp string, payload struct<type: string, session_id: string, id: string, cwd: string, model: string, info: struct<last_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint, output_tokens: bigint>>>",
    )
    p = F.col("j.payload")
    session = F.when((F.col("j.type") == "session_meta") & p.isNotNull(), F.struct(F.coalesce(p["session_id"], p["id"], F.lit("")).alias("id"), project_of(p["cwd"]).alias("project")))
    model = F.when(F.col("j.type") == "turn_context", p["model"])
    if "sid" in j.columns:
        j = j.withColumns({"s": F.when(F.col("sid").isNotNull(), F.struct(F.col("sid").alias("id"), project_of(F.col("cwd")).alias("project"))), "m": F.col("model")})
    else:
        j = j.withColumns({"s": carry(session), "m": carry(model)})
    u = p["info"]["last_token_usage"]
    read, write = count(u["cached_input_tokens"]), count(u["cache_write_input_tokens"])
    return finish(
        j.where((F.col("j.type") == "event_msg") & (p["type"] == "token_count") & u.isNotNull()), "codex", run_ts,
        project=F.coalesce("s.project", F.lit("")), session_id=F.coalesce("s.id", F.lit("")), model=F.coalesce("m", F.lit("")), started_at=from_rfc3339(F.col("j.timestamp")),
        input_tokens=fresh_input(count(u["input_tokens"]), read), output_tokens=count(u["output_tokens"]), cache_read_tokens=read, cache_write_tokens=write,
        raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.col("line_idx")),
    )


_RAW = "prompt_tokens: bigint, completion_tokens: bigint, prompt_cache_hit_tokens: bigint, prompt_tokens_details: struct<cached_tokens: bigint>, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, prompt_cache_write_tokens: bigint"
_CODEBUDDY = (
    "type string, role string, timestamp bigint, sessionId string, cwd string, message struct<usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint>>, "
    "providerData struct<model: string, requestModelId: string, messageId: string, traceId: string, conversationRequestId: string, usage: struct<inputTokens: bigint, outputTokens: bigint, inputTokensDetails: array<struct<cached_tokens: bigint>>>, "
    f"rawUsage: struct<{_RAW}>>"
)


def codebuddy(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    j = parsed(json_lines(spark, roots) if lines is None else lines, _CODEBUDDY, strict=True)
    mu, pd, pu, raw = F.col("j.message.usage"), F.col("j.providerData"), F.col("j.providerData.usage"), F.col("j.providerData.rawUsage")
    total_in = count(F.coalesce(mu["input_tokens"], pu["inputTokens"], raw["prompt_tokens"]))
    out = count(F.coalesce(mu["output_tokens"], pu["outputTokens"], raw["completion_tokens"]))
    rich = F.coalesce(F.get(pu["inputTokensDetails"], F.lit(0))["cached_tokens"], F.lit(0))
    read = count(F.coalesce(raw["prompt_cache_hit_tokens"], raw["cache_read_input_tokens"], F.when(pu.isNotNull(), rich), raw["prompt_tokens_details"]["cached_tokens"], mu["cache_read_input_tokens"]))
    write = count(F.coalesce(raw["cache_creation_input_tokens"], raw["prompt_cache_write_tokens"]))
    ident = F.nullif(F.coalesce(pd["messageId"], pd["traceId"], pd["conversationRequestId"]), F.lit(""))
    assistant = ((F.col("j.type") == "message") & (F.col("j.role") == "assistant")) | (F.col("j.type") == "function_call")
    model = F.coalesce(F.regexp_replace(pd["requestModelId"], "^custom-local:", ""), pd["model"], F.lit(""))
    return finish(
        j.where(assistant), "codebuddy", run_ts,
        project=project_of(F.col("j.cwd")), session_id=F.coalesce("j.sessionId", F.lit("")), model=model, started_at=from_millis(F.col("j.timestamp")),
        input_tokens=fresh_input(total_in, read, write), output_tokens=out, cache_read_tokens=read, cache_write_tokens=write,
        raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.coalesce(ident, F.col("line_idx").cast("string"))), ord=F.col("line_idx"),
    )


def codebuddy_desktop(spark: SparkSession, roots: list[Root], run_ts: datetime, folders: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Requests of <workspace>/<conversation>/index.json; `folders` (conversation, cwd) names projects."""
    notes = docs
    if docs is None:  # messages are looked up in all files, changed or not
        docs, notes = documents(spark, roots, DESKTOP, depth=12), documents(spark, list(roots), r"[^/]+/[^/]+/messages/[^/]+\.json$", depth=12)
    at = r"([^/]+)/([^/]+)/(?:index\.json|messages/[^/]+\.json)$"
    docs, notes = (d.withColumns({"ws": F.regexp_extract("rel", at, 1), "conv": F.regexp_extract("rel", at, 2)}) for d in (docs, notes))
    req = "struct<id: string, startedAt: bigint, usage: struct<inputTokens: bigint, outputTokens: bigint, cacheTokens: bigint, cachedWriteTokens: bigint>>"
    index = docs.where(F.col("rel").endswith("/index.json")).select("ws", "conv", "size", F.explode(F.from_json("doc", f"requests array<{req}>")["requests"]).alias("r"))
    extra = F.from_json(F.get_json_object("doc", "$.extra"), "requestId string, modelId string")
    models = notes.where(F.col("rel").contains("/messages/")).select("ws", "conv", "rel", extra.alias("e")).where("e.requestId is not null and e.modelId is not null")
    models = models.groupBy("ws", "conv", F.col("e.requestId").alias("req")).agg(F.min_by("e.modelId", "rel").alias("model"))
    rows = index.withColumn("req", F.col("r.id")).join(models, ["ws", "conv", "req"], "left")
    if folders is None:
        folders = spark.createDataFrame([], "conv string, cwd string")
    rows = rows.join(folders.select(F.col("conv"), "cwd"), "conv", "left")
    read, write = count(F.col("r.usage.cacheTokens")), count(F.col("r.usage.cachedWriteTokens"))
    return finish(
        rows, "codebuddy", run_ts,
        project=F.coalesce(leaf(F.col("cwd")), F.col("ws")), session_id=F.col("conv"), model=F.coalesce("model", F.lit("")), started_at=from_millis(F.col("r.startedAt")),
        input_tokens=fresh_input(count(F.col("r.usage.inputTokens")), read, write), output_tokens=count(F.col("r.usage.outputTokens")), cache_read_tokens=read, cache_write_tokens=write,
        raw_bytes=F.col("size"), fingerprint=F.concat_ws(":", F.lit("desktop"), "ws", "conv", "r.id"),
    )


def conversation_folders(spark: SparkSession, roots: list[Root], stores: DataFrame | None = None) -> DataFrame:
    """(conv, cwd) from the key-value table of the desktop tool."""
    kv = database_rows(spark, list(roots), r"\.vscdb$", "SELECT CAST(key AS TEXT), CAST(value AS TEXT) FROM ItemTable", "key string, value string", files=stores)
    kv = kv.where(F.col("key").startswith("session:")).select(F.substring_index("key", ":", -1).alias("conv"), F.get_json_object("value", "$.cwd").alias("cwd"))
    return kv.where("cwd is not null").groupBy("conv").agg(F.min("cwd").alias("cwd"))


def workbuddy(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    shape = "struct<input_tokens: bigint, inputTokens: bigint, output_tokens: bigint, outputTokens: bigint, cache_read_input_tokens: bigint, cacheReadInputTokens: bigint, inputTokensDetails: array<struct<cached_tokens: bigint>>>"
    j = parsed(
        json_lines(spark, roots) if lines is None else lines,
        f"type string, role string, timestamp bigint, sessionId string, cwd string, message struct<usage: {shape}>, providerData struct<model: string, requestModelId: string, usage: {shape}, rawUsage: struct<{_RAW}>>",
    )
    mu, pu, raw = F.col("j.message.usage"), F.col("j.providerData.usage"), F.col("j.providerData.rawUsage")
    pick = lambda a, b, c: F.when(mu.isNotNull(), a(mu)).when(pu.isNotNull(), a(pu)).otherwise(c)
    both = lambda snake, camel: lambda u: F.coalesce(u[snake], u[camel])
    total_in = count(pick(both("input_tokens", "inputTokens"), None, raw["prompt_tokens"]))
    out = count(pick(both("output_tokens", "outputTokens"), None, raw["completion_tokens"]))
    cached = lambda u: F.coalesce(u["cache_read_input_tokens"], u["cacheReadInputTokens"], F.get(u["inputTokensDetails"], F.lit(0))["cached_tokens"])
    raw_read = F.coalesce(raw["prompt_cache_hit_tokens"], raw["cache_read_input_tokens"], raw["prompt_tokens_details"]["cached_tokens"])
    read = count(F.coalesce(pick(cached, None, raw_read), raw_read))
    write = count(F.coalesce(raw["prompt_cache_write_tokens"], raw["cache_creation_input_tokens"]))
    assistant = ((F.col("j.type") == "message") & (F.col("j.role") == "assistant")) | (F.col("j.type") == "function_call")
    return finish(
        j.where(assistant), "workbuddy", run_ts,
        project=launch_project(F.col("j.cwd")), session_id=F.coalesce("j.sessionId", F.lit("")), model=F.coalesce("j.providerData.requestModelId", "j.providerData.model", F.lit("")), started_at=from_millis(F.col("j.timestamp")),
        input_tokens=fresh_input(total_in, read), output_tokens=out, cache_read_tokens=read, cache_write_tokens=write,
        raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.col("line_idx")),
    )


def workbuddy_ledger(spark: SparkSession, roots: list[Root], run_ts: datetime, covered: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Session totals of the ledger for sessions that `covered` (session_id of all stored rows) lacks."""
    sql = "SELECT s.id, s.cwd, s.model, s.created_at, u.used FROM session_usage u JOIN sessions s ON u.session_id = s.id WHERE u.used > 0"
    rows = database_rows(spark, roots, LEDGER, sql, "id string, cwd string, model string, created_at long, used long", files=stores)
    rows = rows.join(covered.select(F.col("session_id").alias("id")).distinct(), "id", "left_anti")
    return finish(
        rows, "workbuddy", run_ts, project=launch_project(F.col("cwd")), session_id=F.col("id"), model=F.coalesce("model", F.lit("")), started_at=from_millis(F.col("created_at")),
        input_tokens=count(F.col("used")), fingerprint=F.concat_ws(":", F.concat_ws("/", "label", F.lit("workbuddy.db")), "id"),
    )


_MESSAGE = "id string, role string, sessionID string, modelID string, path struct<cwd: string>, tokens struct<input: bigint, output: bigint, reasoning: bigint, cache: struct<read: bigint, write: bigint>>, time struct<created: bigint>, _corrupt string"


def _messages(rows: DataFrame, provider: str, run_ts: datetime, store: str) -> DataFrame:
    """Rows (label, id, session_id, time_created, data) of assistant messages."""
    rows = kept(with_json(rows, F.from_json("data", _MESSAGE, _JSON)), "j._corrupt is null and j.role = 'assistant'")
    t = F.col("j.tokens")
    return finish(
        rows, provider, run_ts,
        project=project_of(F.col("j.path.cwd")), session_id=F.coalesce("session_id", "j.sessionID", F.lit("")), model=F.coalesce("j.modelID", F.lit("")),
        started_at=from_millis(F.coalesce("j.time.created", "time_created")),
        input_tokens=count(t["input"]) + count(t["reasoning"]), output_tokens=count(t["output"]), cache_read_tokens=count(t["cache"]["read"]), cache_write_tokens=count(t["cache"]["write"]),
        raw_bytes=F.octet_length("data"), fingerprint=F.concat_ws(":", F.concat_ws("/", "label", F.lit(store)), "id"), ord=F.col("place"),
    )


_MESSAGE_SQL = "SELECT CAST(id AS TEXT), session_id, time_created, data FROM message ORDER BY id"


def opencode(spark: SparkSession, roots: list[Root], run_ts: datetime, stores: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Both stores and the older one-file-a-message layout, in this order; one key for a message in any of them."""
    rows = database_rows(spark, roots, r"opencode(-stable)?\.db$", _MESSAGE_SQL, "id string, session_id string, time_created long, data string", files=stores)
    docs = documents(spark, roots, r"(^|/)storage/message/.*\.json$") if docs is None else docs
    old = docs.select("rel", "label", F.coalesce(F.get_json_object("doc", "$.id"), stem(F.col("rel"))).alias("id"), F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("time_created"), F.col("doc").alias("data"))
    place = F.when(F.col("rel").endswith("-stable.db"), 1).otherwise(0)
    return _messages(rows.withColumn("place", place).unionByName(old.withColumn("place", F.lit(2)), allowMissingColumns=True), "opencode", run_ts, "opencode.db")


def qoder(spark: SparkSession, roots: list[Root], run_ts: datetime, stores: DataFrame | None = None) -> DataFrame:
    rows = database_rows(spark, roots, r"local\.db$", _MESSAGE_SQL, "id string, session_id string, time_created long, data string", files=stores)
    return _messages(rows.withColumn("place", F.lit(0)), "qoder", run_ts, "local.db")


#: Candidate JSON paths of each bucket, in order of preference (fixed values).
USAGE_PATHS = {
    "cache_read": ["cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"],
    "cache_write": ["cacheWrite", "cache_write", "cache_creation_input_tokens", "input_tokens_details.cache_write_tokens", "prompt_tokens_details.cache_write_tokens"],
    "input": ["input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens", "prompt_n", "timings.prompt_n"],
    "output": ["output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens", "predicted_n", "timings.predicted_n"],
    "reasoning": ["reasoningTokens", "reasoning_tokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens", "output_tokens_details.thinking_tokens"],
}
#: Fields that say cached tokens are part of the input (fixed values).
CACHED_INSIDE = ["cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"]
CACHED_INSIDE_UNLESS_DIRECT = ["cached_input_tokens", "cached"]
WRITTEN_INSIDE = ["input_tokens_details.cache_write_tokens", "prompt_tokens_details.cache_write_tokens", "cache_write_input_tokens", "cached_input_tokens"]


def usage_buckets(u: Column) -> dict[str, Column]:
    """Disjoint buckets of a usage object (JSON text) in any of its spellings."""
    raw = lambda path: F.get_json_object(u, f"$.{path}")
    is_number = lambda c: c.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")

    def number(path: str) -> Column:
        return F.when(is_number(raw(path)), F.coalesce(raw(path).try_cast("bigint"), raw(path).try_cast("double").try_cast("bigint")))

    first = {k: F.coalesce(*[number(p) for p in paths]) for k, paths in USAGE_PATHS.items()}
    present = lambda paths: reduce(lambda a, b: a | b, [raw(p).isNotNull() for p in paths])
    direct = raw("input").rlike(r"^-?\d+$")
    direct = F.coalesce(direct, F.lit(False))
    read, write = count(first["cache_read"]), count(first["cache_write"])
    less = F.when(present(CACHED_INSIDE) | (~direct & present(CACHED_INSIDE_UNLESS_DIRECT)), read).otherwise(0)
    less_write = F.when(~direct & present(WRITTEN_INSIDE), write).otherwise(0)
    return {
        "input_tokens": fresh_input(F.coalesce(first["input"], F.lit(0)), less, less_write),
        "output_tokens": count(first["output"]) + count(first["reasoning"]),
        "cache_read_tokens": read,
        "cache_write_tokens": write,
    }


def openclaw(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    lines = json_lines(spark, roots, r"(?i)^(?!.*\.trajectory\.jsonl$)(.*/)?sessions/[^/]+\.jsonl$") if lines is None else lines
    j = parsed(lines, "type string, id string, timestamp string, cwd string, message struct<role: string, model: string, timestamp: bigint, usage: string>")
    session = F.when(F.col("j.type") == "session", F.struct(F.coalesce("j.id", F.lit("")).alias("id"), project_of(F.col("j.cwd")).alias("project")))
    j = j.withColumn("s", carry(session))
    ts = F.col("j.timestamp")
    at = F.coalesce(F.when(ts.rlike(r"^-?\d+$"), from_millis(ts.try_cast("bigint"))), from_rfc3339(ts), from_millis(F.col("j.message.timestamp")))
    return finish(
        j.where("j.type = 'message' and j.message.role = 'assistant' and j.message.usage is not null"), "openclaw", run_ts,
        project=F.coalesce("s.project", F.lit("unknown")), session_id=F.coalesce("s.id", F.lit("")), model=F.coalesce("j.message.model", F.lit("")), started_at=at,
        **usage_buckets(F.col("j.message.usage")), raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.coalesce(F.nullif(F.col("j.id"), F.lit("")), F.col("line_idx").cast("string"))), ord=F.col("line_idx"),
    )


DEEPSEEK_MODEL = "deepseek-v4-pro"


def deepseek(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    j = parsed(
        compressed_lines(spark, roots) if lines is None else lines,
        "type string, time bigint, id string, cwd string, data struct<turn: bigint, step: bigint, usage: struct<inputTokens: bigint, outputTokens: bigint, cacheReadTokens: bigint, cacheWriteTokens: bigint>, message: struct<source: struct<model: string>>, header: struct<config: struct<model: string>>>",
    )
    some = lambda c: F.nullif(c, F.lit(""))
    is_session = F.col("j.type") == "session"
    j = j.withColumns(
        {
            "sid": carry(F.when(is_session, some(F.col("j.id")))),
            "cwd": carry(F.when(is_session, some(F.col("j.cwd")))),
            "m": carry(F.when(F.col("j.type") == "request/header", some(F.col("j.data.header.config.model")))),
        }
    )
    u = F.col("j.data.usage")
    return finish(
        kept(j, "j.type = 'assistant/message' and j.data.turn is not null and j.data.step is not null and j.time is not null and j.data.usage is not null"), "deepseek", run_ts,
        project=F.when(F.col("cwd").isNull(), "").otherwise(project_of(F.col("cwd"))), session_id=F.coalesce("sid", F.regexp_replace(F.regexp_extract("rel", r"([^/]+)$", 1), r"(?i)\.jsonl(\.zstd)?$", "")),
        model=F.coalesce(some(F.col("j.data.message.source.model")), "m", F.lit(DEEPSEEK_MODEL)), started_at=from_millis(F.col("j.time")),
        input_tokens=count(u["inputTokens"]), output_tokens=count(u["outputTokens"]), cache_read_tokens=count(u["cacheReadTokens"]), cache_write_tokens=count(u["cacheWriteTokens"]),
        fingerprint=line_key(F.col("j.data.turn"), F.col("j.data.step")), ord=F.col("line_idx"),
    )


def pi(spark: SparkSession, roots: list[Root], run_ts: datetime, lines: DataFrame | None = None) -> DataFrame:
    u = "struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint>"
    j = parsed(json_lines(spark, roots) if lines is None else lines, f"type string, id string, timestamp string, cwd string, modelId string, usage {u}, message struct<role: string, model: string, timestamp: bigint, usage: {u}>", strict=True)
    kind, msg = F.col("j.type"), F.col("j.message")
    model = F.when(kind == "model_change", F.col("j.modelId")).when((kind == "message") & (msg["role"] == "assistant"), F.nullif(msg["model"], F.lit("")))
    j = j.withColumns({"m": carry(model), "sid": carry(F.when(kind == "session", F.col("j.id"))), "project": carry(F.when(kind == "session", project_of(F.col("j.cwd"))))})
    is_message = (kind == "message") & msg["role"].isin("assistant", "toolResult")
    usage = F.when(is_message, msg["usage"]).when(kind.isin("compaction", "branch_summary"), F.col("j.usage"))
    j = j.withColumn("u", usage).where("u is not null and j.id is not null")
    return finish(
        j, "pi", run_ts,
        project=F.coalesce("project", F.lit("")), session_id=F.coalesce("sid", F.lit("")), model=F.coalesce("m", F.lit("")),
        started_at=F.coalesce(F.when(is_message, from_millis(msg["timestamp"])), from_rfc3339(F.col("j.timestamp"))),
        input_tokens=count(F.col("u.input")), output_tokens=count(F.col("u.output")), cache_read_tokens=count(F.col("u.cacheRead")), cache_write_tokens=count(F.col("u.cacheWrite")),
        raw_bytes=F.col("raw_bytes"), fingerprint=line_key(F.col("j.id")), ord=F.col("line_idx"),
    )


def antigravity(spark: SparkSession, roots: list[Root], run_ts: datetime, stores: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Generation steps of conversation stores; model from the root's settings, project from the trajectory."""
    steps = "SELECT idx, metadata, NULL FROM steps WHERE step_type = 15"
    with_folder = f"{steps} UNION ALL SELECT * FROM (SELECT NULL, NULL, data FROM trajectory_metadata_blob WHERE id = 'main' LIMIT 1)"
    rows = database_rows(spark, roots, r"conversations/[^/]+\.db$", (with_folder, steps), "idx long, metadata binary, data binary", files=stores)
    rows = rows.withColumn("workspace", F.max(workspace_name(workspace_uri("data"))).over(Window.partitionBy("rel")))
    settings = documents(spark, list(roots), r"^([^/]+/)?settings\.json$") if docs is None else docs
    settings = settings.select(F.coalesce("label", F.lit("")).alias("root"), F.nullif(F.trim(F.get_json_object("doc", "$.model")), F.lit("")).alias("set_model"))
    rows = kept(rows.withColumn("g", generation("metadata")), "g.seconds is not null").withColumn("root", F.coalesce("label", F.lit("")))
    rows = rows.join(settings, "root", "left")
    fresh, read = split_cached(F.col("g.input"), F.col("g.cached"))
    return finish(
        rows, "antigravity", run_ts,
        project=F.coalesce("workspace", F.lit("unknown")), session_id=stem(F.col("rel")), model=F.coalesce("set_model", F.lit("gemini")), started_at=from_seconds(F.col("g.seconds")) + F.make_dt_interval(secs=(F.col("g.nanos") / 1e9).cast("decimal(18,6)")),
        input_tokens=fresh, output_tokens=F.col("g.output"), cache_read_tokens=read,
        fingerprint=F.concat_ws(":", F.concat_ws("/", "label", F.regexp_extract("rel", r"([^/]+)$", 1)), "idx"),
    )


def find_usages(docs: DataFrame) -> DataFrame:
    """rel, ordinal, obj: every object with usageMetadata anywhere in a document, in order of sorted keys."""
    import json

    def walk(value, out):
        if isinstance(value, dict):
            if isinstance(value.get("usageMetadata"), dict):
                keep = {k: value.get(k) for k in ("usageMetadata", "model", "modelVersion", "timestamp", "time") if k in value}
                out.append(json.dumps(keep))
            for k in sorted(value):
                walk(value[k], out)
        elif isinstance(value, list):
            for v in value:
                walk(v, out)

    def run(batches):
        for batch in batches:
            for rel, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[str] = []
                try:
                    walk(json.loads(doc), found)
                except (ValueError, RecursionError):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([rel] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["rel", "seen", "obj"])

    return docs.select("rel", "doc").mapInArrow(run, "rel string, seen long, obj string")


def gemini(spark: SparkSession, roots: list[Root], run_ts: datetime, docs: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, roots, r"(^|/)chats/.*\.json$", depth=6) if docs is None else docs
    j = with_json(find_usages(docs), F.from_json("obj", "usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint, cachedContentTokenCount: bigint>, model string, modelVersion string, timestamp bigint, time bigint"))
    u = F.col("j.usageMetadata")
    prompt, out, read = count(u["promptTokenCount"]), count(u["candidatesTokenCount"]), count(u["cachedContentTokenCount"])
    j = j.where(fresh_input(prompt, read) + out + read > 0)
    ordinal = F.row_number().over(Window.partitionBy("rel").orderBy("seen")) - 1  # counts emitted objects only
    return finish(
        j.withColumn("ordinal", ordinal), "gemini", run_ts,
        project=parent_name(F.col("rel")), session_id=stem(F.col("rel")), model=F.coalesce("j.model", "j.modelVersion", F.lit("gemini")), started_at=from_millis(F.coalesce("j.timestamp", "j.time")),
        input_tokens=fresh_input(prompt, read), output_tokens=out, cache_read_tokens=read, fingerprint=line_key(F.col("ordinal")),
    )


def trae(spark: SparkSession, roots: list[Root], run_ts: datetime, docs: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, roots, r"(^|/)sessions/[^/]+\.json$") if docs is None else docs
    row = "struct<model_name: string, mode: string, session_id: string, usage_time: bigint, extra_info: struct<input_token: bigint, output_token: bigint, cache_read_token: bigint, cache_write_token: bigint>>"
    wrapped = F.concat(F.lit('{"rows":'), F.col("doc"), F.lit("}"))  # so that one bad number spoils its whole file, as it should
    j = docs.withColumn("w", F.from_json(wrapped, f"rows array<{row}>, _corrupt string", _JSON)).where("w._corrupt is null").select("rel", F.explode("w.rows").alias("j"))
    e = F.col("j.extra_info")
    mode = F.lower(F.trim(F.coalesce("j.mode", F.lit(""))))
    model = F.coalesce(F.nullif(trae_model(F.col("j.model_name")), F.lit("")), F.when(mode != "", F.concat(F.lit("trae-"), mode)), F.lit("trae-unknown"))
    return finish(
        j.where("j.session_id <> '' and j.usage_time > 0"), "trae", run_ts,
        project=F.lit("Trae"), session_id=F.col("j.session_id"), model=model, started_at=from_seconds(F.col("j.usage_time")),
        input_tokens=count(e["input_token"]), output_tokens=count(e["output_token"]), cache_read_tokens=count(e["cache_read_token"]), cache_write_tokens=count(e["cache_write_token"]),
        fingerprint=line_key(F.col("j.session_id"), F.col("j.usage_time")),
    )


def all_codebuddy(spark: SparkSession, roots: list[Root], run_ts: datetime) -> DataFrame:
    """Sessions of the command line and requests of the desktop tool."""
    return codebuddy(spark, roots, run_ts).unionByName(codebuddy_desktop(spark, roots, run_ts, conversation_folders(spark, roots)), allowMissingColumns=True)


def all_workbuddy(spark: SparkSession, roots: list[Root], run_ts: datetime, stored: DataFrame | None = None) -> DataFrame:
    """Sessions, and ledger totals of those that neither these nor `stored` rows (session_id) cover."""
    rows = workbuddy(spark, roots, run_ts)
    covered = rows.select("session_id")
    return rows.unionByName(workbuddy_ledger(spark, roots, run_ts, covered if stored is None else covered.union(stored.select("session_id"))))


JOBS: dict[str, Callable[[SparkSession, list[Root], datetime], DataFrame]] = {
    "claude": claude, "codex": codex, "gemini": gemini, "antigravity": antigravity, "codebuddy": all_codebuddy, "workbuddy": all_workbuddy,
    "opencode": opencode, "qoder": qoder, "openclaw": openclaw, "deepseek": deepseek, "pi": pi, "trae": trae,
}
#: Files whose change makes a tool's job run: pattern and depth.
FILES = {p: (r"(?i)\.jsonl$", MAX_DEPTH) for p in JOBS} | {
    "gemini": (r"(^|/)chats/.*\.json$", 6), "antigravity": (r"conversations/[^/]+\.db$", MAX_DEPTH), "codebuddy": (rf"(?i)(\.jsonl|{DESKTOP})$", 12), "workbuddy": (rf"(?i)(\.jsonl|{LEDGER})$", MAX_DEPTH),
    "opencode": (r"opencode(-stable)?\.db$|(^|/)storage/message/.*\.json$", MAX_DEPTH), "qoder": (r"local\.db$", MAX_DEPTH), "deepseek": (r"(?i)\.jsonl(\.zstd)?$", MAX_DEPTH), "trae": (r"(^|/)sessions/[^/]+\.json$", MAX_DEPTH),
}


def scan_all(spark: SparkSession, roots: dict[str, list[Root]], run_ts: datetime, enabled: list[str] | None = None) -> DataFrame:
    """Usage of all tools that have roots and are enabled, in registry order."""
    jobs = [JOBS[p](spark, roots[p], run_ts).select(COLUMNS) for p in JOBS if roots.get(p) and (enabled is None or p in enabled)]
    return reduce(DataFrame.unionByName, jobs) if jobs else spark.createDataFrame([], USAGE)
