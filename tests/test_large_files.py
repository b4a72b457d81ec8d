"""Files of lines over the cap of one row."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlake.sources import files, ingest

RUN = datetime(2026, 8, 14)


@pytest.fixture
def small_cap(spark, monkeypatch):
    """A cap of 300 bytes, and blocks of 64."""
    monkeypatch.setattr(files, "MAX_BYTES", 300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _write(path, raw):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


def test_lines_of_large_files(spark, tmp_path, small_cap):
    """Empty lines count, returns at the end go, bytes that are no text are replaced, long lines run over blocks; two roots hold a file of one name."""
    some = [b"a%d" % k * (1 + 40 * (k % 17 == 3)) for k in range(90)] + [b"", b"  ", b"x\r", b"\xff\xc3", "zäh".encode(), b"", b"last"]
    bodies = {"one/big.jsonl": b"\n".join(some), "two/big.jsonl": b"\n".join(some[::-1]) + b"\n", "two/small.jsonl": b"s\n\nt"}
    for name, body in bodies.items():
        _write(tmp_path / name, body)
    roots = [(f"{tmp_path}/one", None), (f"{tmp_path}/two", None)]
    got = sorted((r.rel, r.line_idx, r.line, r.raw_bytes) for r in files.json_lines(spark, roots).collect())
    want = [(name.split("/")[1], k, x.rstrip("\r")) for name, body in bodies.items() for k, x in enumerate(body.decode("utf-8", "replace").split("\n")) if x.strip(" ")]
    assert got == sorted((rel, k, x, len(x.encode())) for rel, k, x in want)
    assert files.oversized(spark, "x", roots).count() == 0
    assert files.listing(spark, "x", roots).agg(F.sum("size")).first()[0] == sum(map(len, bodies.values()))


def test_jobs_read_large_files(spark, tmp_path, small_cap):
    """The ingest job takes them as it takes others; what can only be read whole is still reported."""
    from meterlake.operators.store import UsageStore
    from meterlake.plans.collect import collect

    line = lambda n: json.dumps({"type": "assistant", "message": {"model": "claude-opus-4-8", "usage": {"input_tokens": n}}})
    step = lambda n: json.dumps({"type": "assistant/message", "time": 1000, "data": {"turn": n, "step": 1, "usage": {"inputTokens": n}}})
    _write(tmp_path / "claude" / "p" / "big.jsonl", "\n".join(line(n) for n in range(1, 31)).encode())
    _write(tmp_path / "claude" / "p" / "small.jsonl", line(7).encode())
    _write(tmp_path / "ds" / "big.jsonl", "\n".join(step(n) for n in range(1, 21)).encode())
    _write(tmp_path / "gemini" / "chats" / "c.json", json.dumps({"pad": "x" * 400}).encode())
    roots = {p: [(f"{tmp_path}/{d}", None)] for p, d in (("claude", "claude"), ("deepseek", "ds"), ("gemini", "gemini"))}
    store = UsageStore(spark, f"{tmp_path}/store")
    scan = lambda k: {r.provider: (r.found, r.inserted, r.skipped) for r in collect(spark, store, roots, RUN, k).collect()}
    assert scan(1) == {"claude": (31, 31, 0), "deepseek": (20, 20, 0)}
    assert {r.provider: r.n for r in store.usage().groupBy("provider").agg(F.sum("input_tokens").alias("n")).collect()} == {"claude": 31 * 15 + 7, "deepseek": 21 * 10}
    assert files.errors(spark, "gemini", roots["gemini"], *ingest.FILES["gemini"]).count() == 1
    assert scan(2) == {}
