"""BPE by contiguous rank arrays against the tokenizers library."""

import hashlib
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from meterlake.llm import bpe, pair_bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pair_bpe.vocabulary())


@pytest.fixture(scope="module")
def codec():
    return pair_bpe.Codec(pair_bpe.vocabulary())


def ids_of(codec, text):
    parts = list(codec.encode([text])[0])
    return np.concatenate(parts).tolist() if parts else []


def odd_texts(rng):
    letters = "ab  \n\t'sltd!é中\U0001f600 1٣"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    special = ["<|endoftext|>", "a<|endoftext|>  b", "<|endoftext|", "  <|endoftext|><|endoftext|> \n", "don't <|endoftext|>'ll"]
    return [*out, *special, "", " ", "x" * 5000, "ab" * 3000 + " q", "ththe" * 900, "don't we'll 12ab\r\n  x"]


def test_equal_to_the_library(codec, library):
    for text in odd_texts(random.Random(3)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec, text) == want
        assert codec.decode(want).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_every_code_point():
    """In front of, between and behind letters, numbers and others, a code point splits as in the library."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} a" for c in points[k : k + 20_000])
        begins = bpe.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]), pair_bpe.classes())
        assert np.flatnonzero(begins).tolist() == [a for _, (a, _) in split.pre_tokenize_str(text)]


def test_long_words_and_blocks(codec, library, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("thereining") for _ in range(n)) for n in (255, 256, 257, 3000, 40_000)]
    for w in words:
        ids, bounds = codec.merges.long(w.encode())
        short, cuts = codec.merges.short(w.encode()[:3000])
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids
        assert codec.merges.long(w.encode()[:3000])[0].tolist() == short
        assert [codec.bytes[i] for i in ids[:50]] == [w.encode()[a:b] for a, b in zip(bounds[:50], bounds[1:])]
        assert [codec.bytes[i] for i in short[:-1]] == [w.encode()[a:b] for a, b in zip(cuts, cuts[1:])]
    text = " ".join(odd_texts(rng)[-30:])[:6000]
    for block in (5, 64, 1000):
        monkeypatch.setattr(pair_bpe, "BLOCK", block)
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pair_bpe, "CACHE_BYTES", 20_000)
    codec = pair_bpe.Codec(pair_bpe.vocabulary())
    for k in range(60):
        text = " ".join(f"word{k}x{j}" for j in range(50)) + "z" * 5000
        assert ids_of(codec, text) == library.encode(text, add_special_tokens=False).ids
        assert codec.held < 60_000


def test_documents(spark, library):
    rng = random.Random(5)
    texts = [*odd_texts(rng)[:60], None, "", "same", "same", "word " * 60_000]
    rows = [(None if k == 3 else k % 50, t, "x", "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = pair_bpe.vocabulary()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(decoded.encode())))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, pair_bpe.encode_documents(docs, path).collect()), key=order) == sorted(want, key=order)
    back = pair_bpe.decode_ids(pair_bpe.encode_documents(docs, path, with_ids=True), path)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for t in texts)
    assert pair_bpe.encode_documents(docs.limit(0), path).count() == 0


def test_boundaries_of_other_classes():
    """Classes of a newer Unicode only change what their code points split."""
    points = np.array([ord("a"), 0x1C89, ord("b")], np.uint32)
    assert bpe.boundaries(points, np.array([0]), pair_bpe.classes()).tolist() == [True, False, False]


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"added_tokens": [], "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="byte-level"):
        pair_bpe.Codec(str(path))
