"""Ingestion jobs on small generated logs."""

import json
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.sources import files, ingest

RUN = datetime(2026, 8, 14)


def write(path, *lines, raw=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    if raw is not None:
        path.write_bytes(raw)
    else:
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def rows(df):
    return sorted((r.fingerprint, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.cache_write_tokens, r.model, r.project, r.session_id) for r in df.collect())


def test_claude_and_listing(spark, tmp_path):
    u = {"input_tokens": 10, "output_tokens": 20, "cache_creation_input_tokens": 5, "cache_read_input_tokens": 7}
    write(tmp_path / "proj" / "sess.jsonl", {"type": "assistant", "timestamp": "2026-08-07T01:02:03Z", "message": {"model": "m", "usage": u}}, "", "no json", {"type": "assistant", "message": {"usage": {"input_tokens": "12"}}}, {"type": "user"})
    roots = [(str(tmp_path), None), (str(tmp_path / "missing"), "x")]
    got = ingest.claude(spark, roots, RUN)
    assert rows(got) == [("proj/sess.jsonl:0", 10, 20, 7, 5, "m", "proj", "sess")]
    assert got.first().started_at == datetime(2026, 8, 7, 1, 2, 3)
    two = ingest.claude(spark, [(str(tmp_path), "a"), (str(tmp_path), "b")], RUN)
    assert {r[0] for r in rows(two)} == {"a/proj/sess.jsonl:0", "b/proj/sess.jsonl:0"}
    assert ingest.claude(spark, [(str(tmp_path / "missing"), None)], RUN).count() == 0
    listing = files.listing(spark, "claude", roots)
    assert files.snapshot(listing).first().fingerprint.startswith("1:")
    assert files.oversized(spark, "claude", roots).count() == 0


def test_codex_carries_state(spark, tmp_path):
    tok = lambda i, c, o: {"type": "event_msg", "timestamp": "2026-08-07T01:02:03Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    write(tmp_path / "r.jsonl", {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w/app"}}, {"type": "turn_context", "payload": {"model": "model-one"}}, tok(900, 350, 41), tok(1700, 1200, 52), {"type": "session_meta", "payload": {}}, tok(1, 0, 0))
    assert rows(ingest.codex(spark, [(str(tmp_path), None)], RUN)) == [
        ("r.jsonl:2", 550, 41, 350, 0, "model-one", "app", "s1"), ("r.jsonl:3", 500, 52, 1200, 0, "model-one", "app", "s1"), ("r.jsonl:5", 1, 0, 0, 0, "model-one", "unknown", ""),
    ]


def test_codebuddy_shapes(spark, tmp_path):
    msg = {"type": "message", "role": "assistant", "sessionId": "s", "cwd": "/w/x", "timestamp": 1}
    rich = {"model": "a", "requestModelId": "custom-local:own-model", "messageId": "call-7", "usage": {"inputTokens": 610, "outputTokens": 17, "inputTokensDetails": [{"cached_tokens": 405}]}}
    raw = {"rawUsage": {"prompt_tokens": 880, "completion_tokens": 23, "prompt_cache_hit_tokens": 130, "prompt_cache_write_tokens": 70}, "traceId": "t"}
    write(tmp_path / "f.jsonl", {"type": "user"}, msg | {"message": {"usage": {"input_tokens": 710, "output_tokens": 9, "cache_read_input_tokens": 200}}}, {"type": "function_call", "providerData": rich}, {"type": "function_call", "providerData": raw})
    got = [r[:6] for r in rows(ingest.codebuddy(spark, [(str(tmp_path), None)], RUN))]
    assert got == [("f.jsonl:1", 510, 9, 200, 0, ""), ("f.jsonl:call-7", 205, 17, 405, 0, "own-model"), ("f.jsonl:t", 680, 23, 130, 70, "")]
    desk = tmp_path / "d" / "ws1" / "conv1"
    write(desk / "index.json", {"requests": [{"id": "r1", "startedAt": 5, "usage": {"inputTokens": 4400, "outputTokens": 81, "cacheTokens": 3900}}]})
    write(desk / "messages" / "1.json", {"extra": json.dumps({"requestId": "r1", "modelId": "lookup-model"})})
    kv = files.sqlite_bytes(["CREATE TABLE ItemTable(key, value)", """INSERT INTO ItemTable VALUES ('session:conv1', '{"cwd": "/home/u/app"}')"""])
    write(tmp_path / "kv" / "state.vscdb", raw=kv)
    folders = ingest.conversation_folders(spark, [(str(tmp_path / "kv"), None)])
    assert rows(ingest.codebuddy_desktop(spark, [(str(tmp_path / "d"), None)], RUN, folders)) == [("desktop:ws1:conv1:r1", 500, 81, 3900, 0, "lookup-model", "app", "conv1")]


def test_workbuddy(spark, tmp_path):
    raw = {"rawUsage": {"prompt_tokens": 990, "completion_tokens": 31, "prompt_cache_hit_tokens": 640, "prompt_cache_write_tokens": 55}}
    write(tmp_path / "f.jsonl", {"type": "message", "role": "assistant", "sessionId": "s", "cwd": "/w/WorkBuddy/2026-08-07-10-11-12", "providerData": raw})
    assert rows(ingest.workbuddy(spark, [(str(tmp_path), None)], RUN)) == [("f.jsonl:0", 350, 31, 640, 55, "", "WorkBuddy", "s")]
    db = files.sqlite_bytes(["CREATE TABLE sessions(id, cwd, model, created_at)", "CREATE TABLE session_usage(session_id, used)", "INSERT INTO sessions VALUES ('sess-x','/w/p','m',1),('s','/w/p','m',1)", "INSERT INTO session_usage VALUES ('sess-x',777),('s',5)"])
    write(tmp_path / "workbuddy.db", raw=db)
    covered = spark.createDataFrame([("s",)], "session_id string")
    assert rows(ingest.workbuddy_ledger(spark, [(str(tmp_path), None)], RUN, covered)) == [("workbuddy.db:sess-x", 777, 0, 0, 0, "m", "p", "sess-x")]


def test_embedded_stores(spark, tmp_path):
    data = json.dumps({"role": "assistant", "modelID": "m", "path": {"cwd": "/w/p"}, "tokens": {"input": 100, "output": 20, "reasoning": 5, "cache": {"read": -3}}, "time": {"created": 1000}})
    db = files.sqlite_bytes(["CREATE TABLE message(id, session_id, time_created, data)", f"INSERT INTO message VALUES ('msg_1','s',1,'{data}'),('msg_2','s',1,'bad')"])
    write(tmp_path / "opencode.db", raw=db[:18] + b"\x02\x02" + db[20:])
    write(tmp_path / "storage" / "message" / "msg_1.json", data)
    write(tmp_path / "other" / "opencode-stable.db", raw=b"not a database")
    got = rows(ingest.opencode(spark, [(str(tmp_path), None)], RUN))
    assert [r[:6] for r in got] == [("opencode.db:msg_1", 105, 20, 0, 0, "m")] * 2
    write(tmp_path / "q" / "local.db", raw=db)
    assert [r[:5] for r in rows(ingest.qoder(spark, [(str(tmp_path / "q"), None)], RUN))] == [("local.db:msg_1", 105, 20, 0, 0)]


def test_openclaw(spark, tmp_path):
    at = tmp_path / "agents" / "a" / "sessions"
    msg = lambda i, u: {"type": "message", "id": i, "timestamp": 1000, "message": {"role": "assistant", "model": "m", "usage": u}}
    write(at / "x.jsonl", {"type": "session", "id": "s", "cwd": "/w/p"}, msg("a", {"input": 100, "output": 20, "cacheRead": 5, "cacheWrite": 3}), msg("b", {"prompt_tokens": 110, "completion_tokens": 20, "cached_tokens": 90}), msg("c", {"output": 5, "reasoningTokens": 4}), msg("d", {"input": 0}))
    write(at / "x.trajectory.jsonl", msg("z", {"input": 1}))
    write(tmp_path / "agents" / "a" / "y.jsonl", msg("z", {"input": 1}))
    got = [(r[0].rsplit(":")[-1], *r[1:5], r[7]) for r in rows(ingest.openclaw(spark, [(str(tmp_path), None)], RUN))]
    assert got == [("a", 100, 20, 5, 3, "s"), ("b", 20, 20, 90, 0, "s"), ("c", 0, 9, 0, 0, "s")]


def test_deepseek_compressed_and_pi(spark, tmp_path):
    lines = [{"type": "session", "id": "s", "cwd": "/w/p"}, {"type": "request/header", "data": {"header": {"config": {"model": "hm"}}}}, {"type": "assistant/message", "time": 1000, "data": {"turn": 1, "step": 2, "usage": {"inputTokens": 100, "outputTokens": 40, "cacheReadTokens": 1000, "cacheWriteTokens": 5}}}, {"type": "assistant/chunk", "data": {}}]
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as z:
        z.write("\n".join(map(json.dumps, lines)).encode())
    write(tmp_path / "ds" / "a.jsonl.zstd", raw=out.getvalue().to_pybytes())
    assert rows(ingest.deepseek(spark, [(str(tmp_path / "ds"), None)], RUN)) == [("a.jsonl.zstd:1:2", 100, 40, 1000, 5, "hm", "p", "s")]
    write(tmp_path / "pi" / "a.jsonl", {"type": "session", "id": "s", "cwd": "/w/p"}, {"type": "message", "id": "1", "message": {"role": "assistant", "model": "m1", "timestamp": 5, "usage": {"input": 321, "output": 12}}},
          {"type": "model_change", "modelId": "m2"}, {"type": "message", "id": "2", "message": {"role": "toolResult", "usage": {"input": 50, "output": 5}}}, {"type": "compaction", "id": "3", "usage": {"input": 30, "output": 3}}, {"type": "message", "message": {"role": "assistant", "usage": {"input": 1}}})
    assert [r[:6] for r in rows(ingest.pi(spark, [(str(tmp_path / "pi"), None)], RUN))] == [("a.jsonl:1", 321, 12, 0, 0, "m1"), ("a.jsonl:2", 50, 5, 0, 0, "m2"), ("a.jsonl:3", 30, 3, 0, 0, "m2")]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, v):
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def test_antigravity(spark, tmp_path):
    meta = field(1, field(1, 1_776_000_000) + field(2, 500_000_000)) + field(9, field(2, 100) + field(3, 7) + field(5, 60))
    uri = field(2, field(1, b"file:///home/u/app"))
    db = files.sqlite_bytes(["CREATE TABLE steps(idx, step_type, metadata)", "CREATE TABLE trajectory_metadata_blob(id, data)", f"INSERT INTO steps VALUES (3, 15, x'{meta.hex()}'), (4, 15, x'ff'), (5, 14, x'{meta.hex()}')", f"INSERT INTO trajectory_metadata_blob VALUES ('main', x'{uri.hex()}')"])
    write(tmp_path / "conversations" / "u1.db", raw=db)
    write(tmp_path / "settings.json", {"model": "gemini-3"})
    got = ingest.antigravity(spark, [(str(tmp_path), "ide")], RUN)
    assert rows(got) == [("ide/u1.db:3", 40, 7, 60, 0, "gemini-3", "app", "u1")]
    assert got.first().started_at == datetime(2026, 4, 12, 13, 20, 0, 500000)


def test_documents(spark, tmp_path):
    write(tmp_path / "tmp" / "h" / "chats" / "c.json", {"b": [{"usageMetadata": {"promptTokenCount": 100, "candidatesTokenCount": 20, "cachedContentTokenCount": 10}, "model": "g", "timestamp": 1}], "a": {"usageMetadata": {"promptTokenCount": 0}}})
    assert rows(ingest.gemini(spark, [(str(tmp_path), None)], RUN)) == [("tmp/h/chats/c.json:0", 90, 20, 10, 0, "g", "chats", "c")]
    row = {"model_name": "", "mode": "Auto", "session_id": "s1", "usage_time": 1776000000, "extra_info": {"input_token": -5, "output_token": 10, "cache_read_token": -2}}
    write(tmp_path / "t" / "sessions" / "a.json", [row, row | {"session_id": ""}, row | {"usage_time": 0}])
    write(tmp_path / "t" / "sessions" / "bad.json", [row | {"usage_time": "x"}])
    assert rows(ingest.trae(spark, [(str(tmp_path / "t"), None)], RUN)) == [("sessions/a.json:s1:1776000000", 0, 10, 0, 0, "trae-auto", "Trae", "s1")]


def test_union(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", {"type": "assistant", "message": {"usage": {"input_tokens": 1}}})
    got = ingest.scan_all(spark, {"claude": [(str(tmp_path), None)], "pi": []}, RUN, ["claude", "pi"])
    assert got.select(F.collect_set("provider")).first()[0] == ["claude"] and got.first().started_at == RUN


@pytest.mark.parametrize("name, job, limit", [("ing_15_trae", "trae", "TRAE_ROWS"), ("ing_14_gemini", "gemini", "GEMINI_ROWS")])
def test_made_up_documents_stay_small(spark, monkeypatch, name, job, limit):
    from meterlake import queries

    given = []
    real = getattr(queries.ingest, job)
    monkeypatch.setattr(queries.ingest, job, lambda s, roots, now, docs: (given.append(docs), real(s, roots, now, docs))[1])
    monkeypatch.setattr(queries, limit, 100)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = [r.doc.count('"model') for r in given[0].collect()]
    assert max(rows) <= 100 and len(rows) >= 10 and sum(rows) == queries.unpriced(spark, "/root/testdata/sf0.001").count()


def test_collect_reads_what_changed(spark, tmp_path):
    """Skip of unchanged tools, changed files only, errors that are tried again, both sources of two tools, a log by tool."""
    from meterlake.operators.store import UsageStore
    from meterlake.plans.collect import collect

    logs, store = tmp_path / "logs", UsageStore(spark, str(tmp_path / "store"))
    line = lambda n: {"type": "assistant", "message": {"model": "claude-opus-4-8", "usage": {"input_tokens": n}}}
    write(logs / "claude" / "p" / "a.jsonl", line(10), line(20))
    write(logs / "ds" / "bad.jsonl.zstd", raw=b"no zstd")
    write(logs / "ds" / "good.jsonl", {"type": "assistant/message", "time": 1000, "data": {"turn": 1, "step": 1, "usage": {"inputTokens": 7}}})
    request = {"requests": [{"id": "r1", "startedAt": 5, "usage": {"inputTokens": 40, "outputTokens": 2}}]}
    write(logs / "buddy" / "ws" / "conv" / "index.json", request)
    write(logs / "buddy" / "cli" / "s.jsonl", {"type": "message", "role": "assistant", "message": {"usage": {"input_tokens": 5}}})
    db = files.sqlite_bytes(["CREATE TABLE sessions(id, cwd, model, created_at)", "CREATE TABLE session_usage(session_id, used)", "INSERT INTO sessions VALUES ('x','/w/p','m',1),('s','/w/p','m',1)", "INSERT INTO session_usage VALUES ('x',60),('s',5)"])
    write(logs / "work" / "workbuddy.db", raw=db)
    write(logs / "work" / "f.jsonl", {"type": "message", "role": "assistant", "sessionId": "s", "message": {"usage": {"input_tokens": 3}}})
    roots = {"claude": [(str(logs / "claude"), None)], "deepseek": [(str(logs / "ds"), None)], "codebuddy": [(str(logs / "buddy"), None)], "workbuddy": [(str(logs / "work"), None)], "pi": [(str(tmp_path / "none"), None)]}
    scan = lambda k: {r.provider: (r.found, r.inserted, r.skipped) for r in collect(spark, store, roots, RUN, k).collect()}
    assert scan(1) == {"claude": (2, 2, 0), "deepseek": (1, 1, 0), "codebuddy": (2, 2, 0), "workbuddy": (2, 2, 0)}
    assert [(r.provider, r.rel, r.message[:10]) for r in store.scan_errors().collect()] == [("deepseek", "bad.jsonl.zstd", "unreadable")]
    assert {r.cost_micros for r in store.usage().where("provider = 'claude'").collect()} == {50, 100}
    # Nothing changed: only the tool with a failed file is looked at, and its good file isn't read again.
    assert scan(2) == {"deepseek": (0, 0, 0)}
    write(logs / "claude" / "p" / "b.jsonl", line(30))
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as z:
        z.write(json.dumps({"type": "assistant/message", "time": 1000, "data": {"turn": 2, "step": 1, "usage": {"inputTokens": 9}}}).encode())
    write(logs / "ds" / "bad.jsonl.zstd", raw=out.getvalue().to_pybytes())
    assert scan(3) == {"claude": (1, 1, 0), "deepseek": (1, 1, 0)}
    write(logs / "claude" / "p" / "a.jsonl", line(10), line(20), line(40))  # a file that grew is read whole, what is known is skipped
    assert scan(4) == {"claude": (3, 1, 2)} and scan(5) == {}
    store.delete_provider("claude")
    assert scan(6) == {"claude": (4, 4, 0)}


def test_each_changed_file_is_opened_once(spark, tmp_path):
    """Rows and errors of stores and compressed files come from one read each; nothing of a scan is left behind."""
    import os
    import sqlite3

    import pyarrow as pa

    from meterlake.operators.store import UsageStore
    from meterlake.plans.collect import collect

    junk = os.urandom(3 << 20)
    (tmp_path / "d").mkdir()
    line = '{"type":"assistant/message","time":1755129600000,"data":{"turn":1,"step":1,"usage":{"inputTokens":3}}}'
    (tmp_path / "d" / "a.jsonl.zstd").write_bytes(pa.compress((line + "\n" + junk.hex()).encode(), "zstd", asbytes=True))
    (tmp_path / "d" / "bad.jsonl.zstd").write_bytes(junk)
    for tool, name, sql in (("q", "local.db", "INSERT INTO message VALUES ('m', 's', 1, '{\"role\":\"assistant\",\"tokens\":{\"input\":5}}')"), ("o", "opencode.db", "INSERT INTO message VALUES ('m', 's', 1, '{\"role\":\"assistant\",\"tokens\":{\"input\":7}}')")):
        (tmp_path / tool).mkdir()
        with sqlite3.connect(tmp_path / tool / name) as db:
            db.execute("CREATE TABLE message(id, session_id, time_created, data)")
            db.execute(sql)
            db.execute("CREATE TABLE more(x)")
            db.execute("INSERT INTO more VALUES (?)", (junk,))
        db.close()
    (tmp_path / "q" / "x").mkdir()
    (tmp_path / "q" / "x" / "local.db").write_bytes(junk)
    roots = {p: [(str(tmp_path / d), None)] for p, d in (("deepseek", "d"), ("qoder", "q"), ("opencode", "o"))}
    store = UsageStore(spark, str(tmp_path / "store"))
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    before = stats.getLong("bytesRead")
    collect(spark, store, roots, RUN, 1)
    size = sum(os.path.getsize(os.path.join(f, n)) for d in "dqo" for f, _, names in os.walk(tmp_path / d) for n in names)
    assert size < stats.getLong("bytesRead") - before < 1.3 * size
    assert sorted((r.provider, r.input_tokens) for r in store.usage().collect()) == [("deepseek", 3), ("opencode", 7), ("qoder", 5)]
    assert sorted((r.provider, r.rel, r.message[:10]) for r in store.scan_errors().collect()) == [("deepseek", "bad.jsonl.zstd", "unreadable"), ("qoder", "x/local.db", "unreadable")]
    assert sorted(r.rel for r in store.file_state().collect()) == ["a.jsonl.zstd", "local.db", "opencode.db"]
    from meterlake.sources.paths import work_folder

    here = os.path.dirname(work_folder(spark, "x").removeprefix("file:"))
    assert not [n for n in os.listdir(here) if n.startswith("scan-")]


def test_rows_that_wait_in_a_sidecar(spark, tmp_path):
    """A live store: rows that aren't in its file yet are read, also when only the sidecar has changed since."""
    import shutil
    import sqlite3

    from meterlake.operators.store import UsageStore
    from meterlake.plans.collect import collect
    from meterlake.sources import files

    live, logs = tmp_path / "live", tmp_path / "logs"
    live.mkdir()
    (logs / "x").mkdir(parents=True)
    db = sqlite3.connect(live / "local.db", isolation_level=None)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE message(id, session_id, time_created, data)")
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    add = lambda k: db.execute("INSERT INTO message VALUES (?, 's', 1, ?)", (f"m{k}", '{"role":"assistant","tokens":{"input":%d}}' % k))
    add(1)
    copy = lambda: [shutil.copy(live / n, logs / "x" / n) for n in ("local.db", "local.db-wal")]
    copy()
    assert (logs / "x" / "local.db-wal").stat().st_size > 0
    store, roots = UsageStore(spark, str(tmp_path / "store")), {"qoder": [(str(logs), None)]}
    scan = lambda k: [(r.found, r.inserted) for r in collect(spark, store, roots, RUN, k).collect()]
    assert scan(1) == [(1, 1)] and scan(2) == []
    before = (logs / "x" / "local.db").stat()
    add(2)
    shutil.copy(live / "local.db-wal", logs / "x" / "local.db-wal")
    assert (logs / "x" / "local.db").stat().st_mtime == before.st_mtime
    assert scan(3) == [(2, 1)] and scan(4) == []
    assert sorted(r.input_tokens for r in store.usage().collect()) == [1, 2]
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    shutil.copy(live / "local.db", logs / "x" / "local.db")
    (logs / "x" / "local.db-wal").write_bytes(b"no such thing")  # not of this store: passed over
    (logs / "y.db-wal").write_bytes(b"alone")
    assert scan(5) == [(2, 0)] and store.scan_errors().isEmpty()
    rows = files.database_rows(spark, [(str(logs), "l")], r"local\.db$", "SELECT id FROM message", "id string")
    assert sorted((r.rel, r.id) for r in rows.collect()) == [("l/x/local.db", "m1"), ("l/x/local.db", "m2")]
    db.close()


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("p/s.jsonl", 0, "{}", 2)], "rel string, line_idx long, line string, raw_bytes long")
    for job in (ingest.claude, ingest.codebuddy, ingest.workbuddy, ingest.codex, ingest.pi):
        plan = job(spark, [], RUN, lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, job.__name__


def test_stores_are_read_one_at_a_time(spark):
    stores = spark.createDataFrame([("a.db", None, files.sqlite_bytes(["CREATE TABLE t(x)", "INSERT INTO t VALUES (1), (2)"])), ("b.db", None, b"none")], "rel string, label string, content binary")
    rows = files.database_rows(spark, files.Roots([], tagged=True), "", "SELECT x FROM t", "x long", files=stores)
    assert sorted((r.rel, r.x or 0, r.error is None) for r in rows.collect()) == [("a.db", 1, True), ("a.db", 2, True), ("b.db", 0, False)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [rel" in plan and "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "")
