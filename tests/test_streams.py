"""Streams of changing files: growing, replaced and removed ones, and state by file."""

import json
import os
from datetime import datetime

import pytest

from meterlake.operators.store import UsageStore
from meterlake.sources import ingest
from meterlake.streaming import file_state, usage_stream
from meterlake.streaming.file_changes import FileChanges, _Reader, file_changes

RUN = datetime(2026, 8, 14)


def claude_line(n):
    return json.dumps({"type": "assistant", "timestamp": "2026-08-14T00:00:00Z", "message": {"model": "claude-opus-4-8", "usage": {"input_tokens": n, "output_tokens": 1}}})


def changes(reader, start, end):
    return sorted((*r[:2], r[4], r[5] if r[5] is None else bytes(r[5])) for p in reader.partitions(start, end) for r in reader.read(p))


@pytest.mark.parametrize("tail", ["false", "true"])
def test_differences_of_listings(tmp_path, tail):
    logs, deep = tmp_path / "logs", tmp_path / "logs" / "/".join("abcdefgh")
    deep.mkdir(parents=True)
    (logs / "x.jsonl").write_text("one\n")
    (logs / "a" / "y.JSONL").write_text("two\n")
    (deep / "below.jsonl").write_text("too deep\n")
    (logs / "z.txt").write_text("other\n")
    r = FileChanges({"path": str(logs), "state": str(tmp_path / "state"), "tail": tail}).streamReader(None)
    first = r.latestOffset()
    assert changes(r, r.initialOffset(), first) == [("a/y.JSONL", "create", 0, b"two\n"), ("x.jsonl", "create", 0, b"one\n")]
    assert r.latestOffset() == first  # nothing changed, no batch
    with open(logs / "x.jsonl", "a") as f:
        f.write("more\n")
    os.remove(logs / "a" / "y.JSONL")
    second = r.latestOffset()
    grown = ("x.jsonl", "modify", 4, b"more\n") if tail == "true" else ("x.jsonl", "modify", 0, b"one\nmore\n")
    assert changes(r, first, second) == [("a/y.JSONL", "remove", 0, None), grown]
    again = _Reader({"path": str(logs), "state": str(tmp_path / "state"), "tail": tail})  # after a restart
    assert changes(again, first, second) == changes(r, first, second) and again.latestOffset() == second
    (logs / "x.jsonl").write_text("new\n")
    third = r.latestOffset()
    assert changes(r, second, third) == [("x.jsonl", "modify", 0, b"new\n")]
    r.commit(third)
    assert len([n for n in os.listdir(tmp_path / "state") if n.startswith("listing")]) == 1


def test_growing_and_removed_files(spark, tmp_path):
    logs, t = tmp_path / "logs", UsageStore(spark, str(tmp_path / "t"))
    (logs / "proj").mkdir(parents=True)

    def scan():
        feed = file_changes(spark, str(logs), str(tmp_path / "listings"))
        usage_stream.ingest_changes(feed, "claude", ingest.claude, t, str(tmp_path / "state"), RUN).awaitTermination()
        return sorted((r.fingerprint, r.input_tokens) for r in t.usage().collect())

    (logs / "proj" / "s.jsonl").write_text(claude_line(1) + "\n")
    assert scan() == [("proj/s.jsonl:0", 1)]
    with open(logs / "proj" / "s.jsonl", "a") as f:
        f.write(claude_line(2) + "\n")
    (logs / "proj" / "b.jsonl").write_text(claude_line(9) + "\n")
    grown = [("proj/b.jsonl:0", 9), ("proj/s.jsonl:0", 1), ("proj/s.jsonl:1", 2)]
    assert scan() == grown
    os.remove(logs / "proj" / "b.jsonl")
    assert scan() == grown and [(r.provider, r.rel, r.message) for r in t.scan_errors().collect()] == [("claude", "proj/b.jsonl", "removed")]
    log = {r.scan_id: (r.found, r.inserted, r.skipped) for r in t.scan_log().collect()}
    assert log[1] == (1, 1, 0) and log[2] == (3, 2, 1) and sorted(log) == [1, 2]


def test_state_by_file_in_pieces(spark, tmp_path):
    """Rollout files fed in three pieces, cut inside lines too, give what the whole files give."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = lambda *x: "".join(json.dumps(j) + "\n" for j in x)
    meta = lambda s, c: {"type": "session_meta", "payload": {"id": s, "cwd": c}}
    turn = lambda m: {"type": "turn_context", "payload": {"model": m}}
    bill = lambda n: {"type": "event_msg", "timestamp": "2026-08-14T00:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1}}}}
    texts = {
        "a.jsonl": lines(bill(1), meta("s1", "/w/app"), turn("m1"), bill(2)) + "no json\r\n\n" + lines(bill(3), turn("m2"), meta("s2", None), bill(4)),
        "d/b.jsonl": lines(turn("é"), bill(5), meta("s3", "/w/x/"), bill(6), bill(7)),
    }
    logs, t = tmp_path / "logs", UsageStore(spark, str(tmp_path / "t"))
    (logs / "d").mkdir(parents=True)
    for k in range(3):
        for rel, text in texts.items():
            raw = text.encode()
            with open(logs / rel, "ab") as f:
                f.write(raw[len(raw) * k // 3 : len(raw) * (k + 1) // 3])
        feed = file_changes(spark, str(logs), str(tmp_path / "listings"), tail=True)
        usage_stream.ingest_pieces(feed, t, str(tmp_path / "state"), RUN).awaitTermination()
    whole = ingest.codex(spark, [(str(logs), None)], RUN)
    columns = ["project", "session_id", "model", "started_at", "input_tokens", "output_tokens", "raw_bytes", "fingerprint"]
    got = sorted(map(tuple, t.usage().select(columns).collect()))
    assert got == sorted(map(tuple, whole.select(columns).collect())) and len(got) == 7
    assert file_state.state_of('{"type": "session_meta", "payload": 3}') == file_state.state_of('["session_meta"]') == {}


def test_a_file_costs_few_calls():
    """Pieces come as plain rows, in any order; the state is asked for once a file and batch and set once."""
    from pyspark.sql import Row

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    state = State()
    processor = file_state._Lines()
    processor.init(type("Handle", (), {"getValueState": lambda self, name, schema: state})())
    piece = Row("rel", "kind", "mtime_micros", "start", "value")

    def fed(*pieces):
        calls.clear()
        return [tuple(r) for r in processor.handleInputRows(("a",), iter([piece("a", *p) for p in pieces]), None)]

    turn, meta = '{"type": "turn_context", "payload": {"model": "m"}}', '{"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}'
    # The later piece comes first; the cut is inside a letter of two bytes.
    raw = f"é\n{turn}\r\n\nlast".encode()
    assert fed(("modify", 2, 1, raw[1:]), ("create", 1, 0, raw[:1])) == [("a", 0, "é", 2, None, None, None), ("a", 1, turn, len(turn), None, None, "m")]
    assert calls == ["get", "update"] and state.value == (3, b"last", None, None, "m")
    assert fed(("modify", 3, len(raw), f" one\n{meta}\n".encode())) == [("a", 3, "last one", 8, None, None, "m"), ("a", 4, meta, len(meta), "s", "/w", "m")]
    assert calls == ["get", "update"] and state.value == (5, b"", "s", "/w", "m")
    assert fed(("modify", 4, 0, b"new\n")) == [("a", 0, "new", 3, None, None, None)]  # replaced: read from its beginning
    assert fed(("remove", 5, 0, None)) == [] and calls == ["get", "clear"] and state.value is None


def test_pieces_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """A piece of all files isn't one task's, and is one batch; the stream goes on from its state."""
    from pyspark.sql import functions as F

    from meterlake import queries

    monkeypatch.setattr(queries, "work_folder", lambda s, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would join partitions as small as these
    try:
        got = queries.QUERIES["str_04_codex_pieces"](spark, "/root/testdata/sf0.001").collect()
        whole = queries.QUERIES["ing_02_codex_carry"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and got
    written = spark.read.parquet(str(tmp_path / "pieces" / "in")).groupBy("mtime_micros").agg(F.countDistinct("_metadata.file_name").alias("files")).collect()
    assert len(written) == 3 and min(r.files for r in written) > 1
    assert sorted(os.listdir(tmp_path / "pieces" / "out")) == ["batch=0", "batch=1", "batch=2"]
