"""Long texts in parts, bounded caches, and columns of any name in the pipeline."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from meterlake.llm import bpe, fingerprints


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    with open(bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_texts_in_stretches(library, monkeypatch):
    rng = random.Random(6)
    codec = bpe.Codec(bpe.vocabulary())
    text = "".join(rng.choice("ab  \n\t'sltd!é中\U0001f600 1٣<>") for _ in range(5000)) + "x" * 3000 + "".join(rng.choice("thereining中文é") for _ in range(9000))
    want = ",".join(map(str, library.encode_ordinary(text)))
    for block in (1, 9, 200, 1 << 18):
        monkeypatch.setattr(bpe, "BLOCK", block)
        ids, n, raw = codec.encode([text])
        assert ids == [want] and n == [want.count(",") + 1] and raw == [text.encode()]


def test_cache_is_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 30_000)
    codec = bpe.Codec(bpe.vocabulary())
    for k in range(30):
        text = " ".join(f"word{k}x{j}" for j in range(60)) + "z" * 4000
        assert codec.encode([text])[0][0] == ",".join(map(str, library.encode_ordinary(text)))
        assert codec.held < 90_000 and max(map(len, codec.cache)) < bpe.LONG


def test_fingerprints_in_parts(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab cd.\n!é") for _ in range(n)) for n in (0, 1, 7, 8, 9, 40, 3000)] + ["x" * 500, "\n" * 9, "a\n\n" * 40]
    whole = [str(fingerprints.Fingerprint.of(t)) for t in texts]
    for part in (1, 5, 64):
        monkeypatch.setattr(fingerprints, "PART", part)
        assert [str(fingerprints.Fingerprint.of(t)) for t in texts] == whole


def test_other_columns_of_any_name(spark):
    """Columns named like those that stages make keep their values through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared = line(12)
    texts = ["\n".join([line(30), *([shared] if i % 2 else []), line(25)]) for i in range(30)]
    names = ["n_lines", "n_dropped", "__drop", "__lines", "__version", "__copies", "version", "drop", "k", "salt", "copies", "other_columns", "a.b"]
    rows = [(i, t, "en", "s", len(t), *[100 * i + k for k in range(len(names))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[1:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[5:] == tuple(100 * r.doc_id + k for k in range(len(names))) for r in rows)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in stage(spark, plain, "").select("doc_id", "text", "n_chars").collect())
    assert docs.where(F.col("n_dropped") == 1).count() == 1
