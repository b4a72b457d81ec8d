"""BPE encoding and decoding by a tokenizer file (JSON) of vocabulary, merges and special tokens.

A word is merged in contiguous arrays: its parts' ids, their boundaries and the ranks of adjacent pairs. The least rank is
found by a scan, its boundary deleted, and the ranks left and right of it looked up anew. Words of `LONG` bytes or more,
for which scans would be quadratic, keep their pairs in buckets by rank instead: a merge only makes pairs of higher rank,
so buckets are emptied in order. Merged words are cached up to a bound in bytes. Special tokens of the file that stand
in a text are one token each, as the library does by default; the text between them is split into words by boundaries
over code points. Texts are read in blocks cut where any word ends, so memory is bounded by the longest word.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from .common import slices, text_buffers

#: Letters (1) and numbers (2) of Unicode 16 that Python's tables lack (fixed values): first, last, class.
UNICODE_16 = [
    (0x1C89, 0x1C8A, 1), (0xA7CB, 0xA7CD, 1), (0xA7DA, 0xA7DC, 1), (0x105C0, 0x105F3, 1), (0x10D40, 0x10D49, 2), (0x10D4A, 0x10D65, 1), (0x10D6F, 0x10D85, 1),
    (0x10EC2, 0x10EC4, 1), (0x11380, 0x11389, 1), (0x1138B, 0x1138B, 1), (0x1138E, 0x1138E, 1), (0x11390, 0x113B5, 1), (0x113B7, 0x113B7, 1), (0x113D1, 0x113D1, 1),
    (0x113D3, 0x113D3, 1), (0x116D0, 0x116E3, 2), (0x11BC0, 0x11BE0, 1), (0x11BF0, 0x11BF9, 2), (0x13460, 0x143FA, 1), (0x16100, 0x1611D, 1), (0x16130, 0x16139, 2),
    (0x16D40, 0x16D6C, 1), (0x16D70, 0x16D79, 2), (0x18CFF, 0x18CFF, 1), (0x1CCF0, 0x1CCF9, 2), (0x1E5D0, 0x1E5ED, 1), (0x1E5F0, 0x1E5F0, 1), (0x1E5F1, 0x1E5FA, 2),
]
#: Bytes from which a word is merged by buckets and not cached.
LONG = 256
#: Bytes of words and tokens that a worker's cache holds before it starts anew.
CACHE_BYTES = 32 << 20
#: Code points encoded at once.
BLOCK = 1 << 18


@lru_cache(1)
def classes() -> np.ndarray:
    out = bpe.classes().copy()
    for first, last, kind in UNICODE_16:
        out[first : last + 1] = kind
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches `which` of `flat`, end to end."""
    n = count[which].astype(np.int64)
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Merges:
    """Ranks of pairs of token ids, and the ids that they make."""

    def __init__(self, byte_ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]], size: int):
        """`pairs`: (left, right) to (rank, id); of ids below `size`."""
        self.size, self.byte = size, np.array(byte_ids, np.int64)
        self.rank_of = {a * size + b: r for (a, b), (r, _) in pairs.items()}
        self.made = {r: x for r, x in pairs.values()}
        self.keys = np.array(sorted(self.rank_of), np.int64)
        self.ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], np.int64)

    def short(self, word: bytes) -> tuple[list[int], list[int]]:
        """Token ids of a word, and the byte at which each begins."""
        get, size, never = self.rank_of.get, self.size, len(self.rank_of) + self.size
        ids, bounds = self.byte[np.frombuffer(word, np.uint8)].tolist(), list(range(len(word)))
        ranks = [get(a * size + b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != never:
            k = ranks.index(least)
            ids[k] = self.made[least]
            del ids[k + 1], bounds[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] * size + ids[k], never)
            if k < len(ranks):
                ranks[k] = get(ids[k] * size + ids[k + 1], never)
        return ids, bounds

    def long(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for a word of any length: pairs in buckets by rank, each emptied from left to right."""
        return bpe.merge_long(self.byte[np.frombuffer(word, np.uint8)], self.size, self.keys, self.ranks, self.rank_of, self.made.__getitem__)


class Codec:
    """A tokenizer file: byte-level BPE whose special tokens are plain strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = model["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]))
        for token, k in vocab.items():
            self.bytes[k] = bytes(byte_of[c] for c in token)
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"a special token with options: {t['content']}")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.merges = Merges([vocab[c] for c in byte_letters()], pairs, len(self.bytes))
        self.width = np.array([len(x) for x in self.bytes], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.start, self.count, self.held = array("i"), array("q"), array("i"), 0
        for text, k in self.special.items():
            self._keep(text, [k])

    def _keep(self, word: str, ids: list[int]) -> int:
        self.known[word] = k = len(self.start)
        self.start.append(len(self.tokens))
        self.count.append(len(ids))
        self.tokens.extend(ids)
        self.held += 120 + 4 * len(word) + 4 * len(ids)
        return k

    def _segments(self, text: str) -> list[str]:
        """Stretches of ordinary text and special tokens, in order."""
        return [x for x in self.split.split(text) if x] if self.split else [text]

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches (ordinary or special) end to end, and how many each has."""
        whole = "".join(stretches)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(x) for x in stretches])
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        begins = bpe.boundaries(points, starts, classes())
        for k, x in enumerate(stretches):
            if x in self.special:
                begins[starts[k] + 1 : ends[k]] = False
        cut = np.flatnonzero(begins)
        first = np.searchsorted(cut, np.r_[starts, len(points)])
        at = cut.tolist()
        words = [whole[x:y] for x, y in zip(at, [*at[1:], len(whole)])]
        if self.held > CACHE_BYTES:
            self._forget()
        get = self.known.get
        which = [get(w, -1) for w in words]
        long: dict[int, np.ndarray] = {}
        for k, w in enumerate(words):
            if which[k] < 0 and (found := get(w, -1)) < 0:
                raw = w.encode("utf-8", "surrogatepass")
                if len(raw) < LONG:
                    which[k] = self._keep(w, self.merges.short(raw)[0])
                else:
                    long[k] = self.merges.long(raw)[0]
            elif which[k] < 0:
                which[k] = found
        tokens, start, count = (np.array(x) for x in (self.tokens, self.start, self.count))
        which = np.array(which, np.int64)
        if long:  # laid behind the cached ones, for this block only
            extra = list(long.values())
            start = np.r_[start, len(tokens) + np.cumsum([0, *[len(x) for x in extra[:-1]]])]
            which[list(long)] = len(count) + np.arange(len(extra))
            count, tokens = np.r_[count, [len(x) for x in extra]], np.concatenate([tokens, *extra])
        total = np.r_[0, np.cumsum(count[which])]
        return gather(tokens, start, count, which), total[first[1:]] - total[first[:-1]]

    def encode(self, texts: list[str]):
        """A list of arrays of ids for each text, block by block for the long ones; texts of a call are small or one alone."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            segments = [y for x in self._segments(texts[0]) for y in ([x] if x in self.special else bpe.stretches(x, classes(), BLOCK))]
            return [(self._encode([x])[0] for x in segments)]
        parts = [self._segments(x) if x else [] for x in texts]
        stretches = [x for p in parts for x in p]
        if not stretches:
            return [[] for _ in texts]
        ids, n = self._encode(stretches)
        ends = np.r_[0, np.cumsum(n)][np.cumsum([0, *[len(p) for p in parts]])].tolist()
        return [[ids[a:b]] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens; those that are no UTF-8 are for the caller to replace."""
        return gather(self.flat, self.begin, self.width, np.asarray(ids, np.int64)).tobytes()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str, with_ids: bool):
    def run(batches):
        c = codec(path)
        for batch in batches:
            offsets, _ = text_buffers(batch.column(1))
            texts = pc.fill_null(batch.column(1), "")
            for i, j in slices(offsets, BLOCK):
                out = []
                for parts in c.encode(texts.slice(i, j - i).to_pylist()):
                    n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids in parts:
                        n += len(ids)
                        ids_hash.update(ids.astype("<u4").tobytes())
                        text_hash.update(c.decode(ids).decode("utf-8", "replace").encode())
                        kept.append(ids)
                    out.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), np.concatenate(kept) if with_ids and kept else np.zeros(0, np.int32)))
                columns = [batch.column(0).slice(i, j - i), *[pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x[3] for x in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit), decoded_sha256, and with `with_ids` the ids.

    `path`: a tokenizer file that every executor has. Null and empty texts give no ids and the hash of nothing. Rows are
    independent, also those that repeat an id or have none; no shuffle. Other columns aren't read. No rows: no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, with_ids), schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that its `ids` stand for; bytes that are no UTF-8 become U+FFFD, null ids no text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
