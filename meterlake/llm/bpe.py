"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of code points, without regex. Each code point becomes a symbol: its class
(letter, number, blank, other white space, other) with what a glance at the next ones adds (the last of a run of white space,
an apostrophe that may begin 's or 'll). A symbol is a transition function of the splitting automaton, a map of its nine
states; the functions that compositions can reach are a small monoid, whose product table is built once. An associative
scan over a whole batch of texts (a text's first symbol forgets what came before) multiplies them out in blocks, and
boundaries follow from the state before and the symbol. The slices between boundaries are looked up in a cache of
merged slices, bounded in bytes; short new ones are merged all at once, in rounds in which each merges its pair of least rank,
long ones by buckets of pairs of one rank. Byte offsets of the tokens are kept, so ids decode to the exact bytes of each slice.
A long text is encoded in stretches that end where any slice ends, so memory is bounded by its longest slice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, text_buffers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of slices, ids and decoded bytes that a worker's cache holds before it starts anew; bytes of a batch encoded at once.
CACHE_BYTES = 24 << 20
BLOCK = 1 << 18


@lru_cache(1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


#: States: nothing yet, a run of letters, numbers or others, white space that ends in a blank or otherwise,
#: an apostrophe with one or two letters to come, and behind those letters.
START, LETTERS, NUMBERS, OTHERS, BLANK, WHITES, ONE, TWO, ENDED = range(9)
#: Symbols: classes, with apostrophes before one or two letters, and white space within a run and last before a word.
SYMBOLS = ["letter", "number", "other", "one", "two", "blank", "last blank", "white", "last white"]


def _step(state: int, symbol: str) -> tuple[int, bool]:
    """Next state, and whether a slice begins at the symbol."""
    white = state in (BLANK, WHITES)
    match symbol:
        case "letter":
            if state in (ONE, TWO):
                return (ONE if state == TWO else ENDED), False
            return LETTERS, state not in (LETTERS, BLANK)
        case "number":
            return NUMBERS, state not in (NUMBERS, BLANK)
        case "other" | "one" | "two":
            begins = state not in (OTHERS, BLANK)
            return {"one": ONE, "two": TWO}.get(symbol, OTHERS) if begins else OTHERS, begins
        case _:
            return (BLANK if "blank" in symbol else WHITES), not white or "last" in symbol


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Product table of the monoid, the functions of symbols (then of symbols that begin a text), each function's
    value at START, and whether a slice begins at (state, symbol)."""
    maps = [tuple(_step(s, x)[0] for s in range(9)) for x in SYMBOLS]
    maps += [(_step(START, x)[0],) * 9 for x in SYMBOLS]
    known = {tuple(range(9)): 0}
    todo = list(known)
    for f in todo:  # grows while it runs
        for g in maps:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    table = np.array([[known[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    cuts = np.array([[_step(s, x)[1] for x in SYMBOLS] for s in range(9)])
    return table, np.array([known[f] for f in maps], np.uint16), np.array([f[START] for f in todo], np.uint8), cuts


def scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Products of all functions up to each place: within blocks side by side, then over the blocks."""
    n = len(functions)
    step = max(1, int(np.sqrt(n)))
    blocks = -(-n // step)
    p = np.zeros(blocks * step, np.uint16)
    p[:n] = functions
    p = np.ascontiguousarray(p.reshape(blocks, step).T)
    for k in range(1, step):
        p[k] = table[p[k - 1], p[k]]
    carry, before = np.zeros(blocks, np.uint16), 0
    for k, x in enumerate(p[-1].tolist()):
        carry[k] = before
        before = table[before, x]
    return table[carry[None], p].T.reshape(-1)[:n]


def symbols(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Index in SYMBOLS of each code point. `first`: it begins a text; also True behind the last. `kinds`: class of every code point."""
    n = len(points)
    kind = kinds[points]
    p = np.concatenate([points, np.zeros(3, points.dtype)])
    open1, open2 = ~first[1 : n + 1], ~(first[1 : n + 1] | first[2 : n + 2])  # the next one or two belong to the text
    one, two = p[1 : n + 1], p[2 : n + 2]
    after = np.concatenate([kind, [0]])[1:]
    last = open1 & (after != SPACE)
    out = np.array([0, 0, 1, 7, 2], np.uint8)[kind]
    white, gap = kind == SPACE, points == 0x20
    out[gap] = 5
    out[white & last] += 1
    quote = np.flatnonzero(points == 0x27)
    a, b = one[quote], two[quote]
    short = open1[quote] & np.isin(a, [ord(c) for c in "stmd"])
    long = open2[quote] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    out[quote[short]], out[quote[long]] = 3, 4
    return out


def boundaries(points: np.ndarray, starts: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """True where a slice begins. `points`: code points of texts laid end to end; `starts`: first of each; `kinds`: other classes than `classes`."""
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[starts[starts < n]] = True
    first[n:] = True
    table, functions, at_start, cuts = automaton()
    symbol = symbols(points, first, classes() if kinds is None else kinds)
    state = at_start[scan(functions[symbol + len(SYMBOLS) * first[:n]], table)]
    before = np.concatenate([[START], state[:-1]])
    before[first[:n]] = START
    return cuts[before, symbol] | first[:n]


#: Bytes from which a slice is merged by buckets and not cached.
LONG = 256


def stretches(text: str, kinds: np.ndarray, size: int):
    """Stretches of a long text of about `size` code points, cut behind a letter where another class follows, or before white space."""
    at = 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text):
            ahead = kinds[np.frombuffer(text[to - 1 : to + 65536].encode("utf-32-le", "surrogatepass"), np.uint32)]
            here = (ahead[:-1] == LETTER) & (ahead[1:] != LETTER) | (ahead[:-1] != SPACE) & (ahead[1:] == SPACE)
            if here.any():
                to += int(here.argmax())
                break
            to += len(ahead) - 1
        yield text[at:to]
        at = to


def merge_long(first: np.ndarray, size: int, keys: np.ndarray, ranks: np.ndarray, rank_of: dict[int, int], made) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a slice of any length (`first`: ids of its bytes), and the byte at which each begins.

    Pairs (left * size + right, with their ranks in `keys` and `ranks`) lie in buckets by rank, each emptied from left to right; `made(rank)`
    is the token of a pair. A merge that makes a pair of lower rank puts the rest of its bucket off.
    """
    n = len(first)
    key = first[:-1] * size + first[1:]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    some = np.flatnonzero(keys[at] == key)
    rank = ranks[at[some]]
    order = np.argsort(rank, kind="stable")
    some, rank = some[order].astype(np.int32), rank[order]
    cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
    whole = dict(zip(rank[cut].tolist(), np.split(some, cut[1:])))  # pairs of bytes, by rank
    later: dict[int, array] = {}  # pairs that merges have made
    del key, at, order, rank, some
    heap = list(whole)
    heapq.heapify(heap)
    ids, after, before = array("i", first.astype(np.int32).tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    get = rank_of.get
    while heap:
        r = heapq.heappop(heap)
        new, lower = made(r), False
        places = np.unique(np.r_[np.array(later.pop(r, ()), np.int32), whole.pop(r, np.zeros(0, np.int32))])
        for k, a in enumerate(places.tolist()):
            b = after[a]
            if ids[a] < 0 or b >= n or get(ids[a] * size + ids[b]) != r:
                continue
            c, z = after[b], before[a]
            ids[a], ids[b], after[a] = new, -1, c
            if c < n:
                before[c] = a
            for x, y in ((z, a), (a, c)):
                if x >= 0 and y < n and (q := get(ids[x] * size + ids[y])) is not None:
                    if q not in whole and q not in later:
                        heapq.heappush(heap, q)
                    later.setdefault(q, array("i")).append(x)
                    lower |= q < r
            if lower:
                whole[r] = places[k + 1 :]
                heapq.heappush(heap, r)
                break
    left = np.frombuffer(ids, np.int32)
    bounds = np.flatnonzero(left >= 0)
    return left[bounds].copy(), bounds


class Codec:
    """Ranks of a vocabulary file, and a cache of merged slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.size = len(self.bytes)
        self.width = np.array([len(x) for x in self.bytes], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.rank_of = pairs
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[x] for x in self.pair.tolist()], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.pair * 0x9E3779B1 >> 20) & (len(self.maybe) - 1)] = True
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.held = 0

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each slice; every round merges each slice's first pair of least rank."""
        never = np.int64(self.size)
        size = np.array([len(x) for x in pieces], np.int64)
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        done: list[list[int]] = [[] for _ in pieces]

        def ranks(left: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at `left`."""
            right = np.minimum(left + 1, len(ids) - 1)
            key = ids[left] * never + ids[right]
            some = np.flatnonzero(self.maybe[(key * 0x9E3779B1 >> 20) & (len(self.maybe) - 1)] & (owner[left] == owner[right]) & (right > left))
            out = np.full(len(left), never)
            at = np.minimum(np.searchsorted(self.pair, key[some]), len(self.pair) - 1)
            out[some] = np.where(self.pair[at] == key[some], self.rank[at], never)
            return out

        rank = ranks(np.arange(len(ids)))
        while True:
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, start)
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(ids)]))
            out = (least == never)[group]
            if out.any():  # slices that are whole leave
                who, what = owner[out], ids[out].tolist()
                cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                ends = [*cut[1:].tolist(), len(what)]
                for w, s, e in zip(who[cut].tolist(), cut.tolist(), ends):
                    done[w] = what[s:e]
                ids, owner, rank, group = ids[~out], owner[~out], rank[~out], group[~out]
                if not len(ids):
                    return done
            hit = np.flatnonzero(rank == least[group])
            g = group[hit]
            hit = hit[np.r_[True, g[1:] != g[:-1]]]
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            hit -= np.arange(len(hit))  # where the merged ones are now
            touched = np.r_[hit, hit[hit > 0] - 1]
            rank[touched] = ranks(touched)

    def _merged(self, words: list[str]) -> dict[str, tuple[str, int, bytes]]:
        """Ids in decimal, their number and their bytes, of words that the cache doesn't hold; the long ones stay out of it."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        short = [k for k, b in enumerate(raw) if len(b) < LONG]
        merged: list[list[int]] = [[]] * len(raw)
        for k, ids in zip(short, self.merge([raw[k] for k in short]) if short else []):
            merged[k] = ids
        out = {}
        for x, b, ids in zip(words, raw, merged):
            if b in self.ranks:
                ids = [self.ranks[b]]
            elif len(b) >= LONG:
                ids = merge_long(self.byte[np.frombuffer(b, np.uint8)], self.size, self.pair, self.rank, self.rank_of, int)[0].tolist()
            out[x] = ",".join(map(str, ids)), len(ids), self.decode(ids)
            if len(b) < LONG:
                self.cache[x] = out[x]
                self.held += 250 + 6 * len(b)
        return out

    def encode(self, texts: list[str]) -> tuple[list[str], list[int], list[bytes]]:
        """For each text its ids in decimal, comma-joined, their number, and the bytes they decode to."""
        if len(texts) == 1 and len(texts[0]) > BLOCK:
            parts = [self._encode([x]) for x in stretches(texts[0], classes(), BLOCK)]
            return [",".join(p[0][0] for p in parts)], [sum(p[1][0] for p in parts)], [b"".join(p[2][0] for p in parts)]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[list[str], list[int], list[bytes]]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        starts = np.r_[0, np.cumsum(length)]
        if not len(points):
            return [""] * len(texts), [0] * len(texts), [b""] * len(texts)
        cut = np.flatnonzero(boundaries(points, starts[:-1][length > 0]))
        at = cut.tolist()
        words = [whole[x:y] for x, y in zip(at, [*at[1:], len(whole)])]
        if self.held > CACHE_BYTES:
            self.cache, self.held = {}, 0
        new = self._merged([x for x in dict.fromkeys(words) if x not in self.cache])
        cache = self.cache
        found = [new[x] if x in new else cache[x] for x in words]
        first = np.searchsorted(cut, starts).tolist()
        spans = list(zip(first, first[1:]))
        return [",".join([f[0] for f in found[x:y]]) for x, y in spans], [sum([f[1] for f in found[x:y]]) for x, y in spans], [b"".join([f[2] for f in found[x:y]]) for x, y in spans]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


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
                joined, counts, raw = c.encode(texts.slice(i, j - i).to_pylist())
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ids = [np.fromstring(x, np.int32, sep=",") for x in joined]
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    columns.append(pa.array([np.cumsum(np.r_[0, c.width[x]])[:-1] for x in ids], pa.list_(pa.int64())))
                    names += ["ids", "offsets"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids and their byte offsets.

    `path`: a rank file that every executor has. Null and empty texts give no ids and the hash of
    nothing. Rows are independent; no shuffle. Texts are taken whole, in blocks of bounded bytes.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, offsets array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, with_ids), schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that its `ids` stand for."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x).decode("utf-8", "replace") for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
