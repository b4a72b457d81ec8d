"""Collocations by set-oriented mining over persisted relations of word occurrences.

A relation holds the occurrences of frequent phrases of one length, sorted by piece and position. It is stored in chunks of
whole texts of one language, a chunk as one array of word codes in which -1 stands between pieces and wherever the relation has
a gap, so that the merge join of a relation with itself, on the same piece and adjacent positions, is a look at neighbours in
that array. Each length goes through three steps: join to phrases of one word more, count groups (summed a chunk first), and
keep the occurrences of frequent groups (semi-join) as the next relation. Words meet their frequent groups by an exact
join. Longer phrases meet them by a bitmap of fixed size: a phrase that passes it by chance can't make a frequent one,
as counts are of all its occurrences and compared with the threshold again, so results are exact at any load of the bitmap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, discard, materialize, mix, text_buffers

#: Bytes of text of a chunk (a longer text is one alone), and bytes split into words at once.
CHUNK, PART = 8 << 20, 1 << 20
#: Bits of the bitmap of frequent groups, and of one of its pages, as powers of two.
BITS, PAGE = 27, 18
#: Kinds of bytes: word, blank, end of a piece (fixed values).
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK

RELATION = "chunk long, lang string, ids binary, codes binary"


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the code of each occurrence in order, with -1 between pieces. Splits `PART` bytes at once."""
    data = np.frombuffer(text, np.uint8)
    parts, breaks, at, broken = [], [], 0, False
    while at < len(data):
        to = at + PART
        while to < len(data):  # not inside a word
            ahead = np.flatnonzero(KIND[data[to : to + PART]] != WORD)
            if len(ahead):
                to += int(ahead[0])
                break
            to += PART
        low = LOWER[data[at:to]]
        kind = KIND[low]
        inside = kind == WORD
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        ends_before = np.cumsum(kind == BREAK, dtype=np.int32)
        if len(start):
            seen = ends_before[start]
            breaks.append(np.r_[broken or seen[0] > 0, seen[1:] != seen[:-1]])
            offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
            parts.append(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside])))
            broken = bool(ends_before[-1] != seen[-1])
        else:
            broken = broken or bool(ends_before[-1])
        at = to
    if not parts:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    coded = pa.chunked_array(parts).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    cut = np.concatenate(breaks)
    out = np.full(len(cut) + int(cut.sum()), -1, np.int32)
    out[np.arange(len(cut)) + np.cumsum(cut)] = coded.indices.to_numpy()
    return coded.dictionary.cast(pa.string()), out


def _chunks(batches):
    """Rows (lang, text) as chunks: (chunk, lang, words, counts, codes)."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    context, n = TaskContext.get(), 0

    def chunk(lang: str) -> pa.RecordBatch:
        nonlocal n
        size.pop(lang)
        words, codes = words_of(b"\n".join(held.pop(lang)))
        counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
        ends = pa.array([0, len(words)], pa.int32())
        columns = [pa.array([(context.partitionId() << 32 if context else 0) + n]), pa.array([lang]), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array([codes.tobytes()], pa.binary())]
        n += 1
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "words", "counts", "codes"])

    for batch in batches:
        offsets, data = text_buffers(batch.column(1))
        for k, lang in enumerate(batch.column(0).to_pylist()):
            if offsets[k] == offsets[k + 1]:
                continue
            held.setdefault(lang, []).append(data[offsets[k] : offsets[k + 1]].tobytes())
            size[lang] = size.get(lang, 0) + int(offsets[k + 1] - offsets[k]) + 100
            if size[lang] >= CHUNK:
                yield chunk(lang)
            elif len(size) > 1 and sum(size.values()) > 4 * CHUNK:  # many languages: the fullest goes
                yield chunk(max(size, key=size.__getitem__))
    for lang in sorted(held):
        yield chunk(lang)


def restricted(codes: np.ndarray, k: int, good: np.ndarray) -> np.ndarray:
    """The relation of the phrases of k words that begin at `good`: stretches in which every k words are one, a gap between them."""
    if not len(good):
        return np.zeros(0, np.int32)
    first = np.flatnonzero(np.r_[True, good[1:] != good[:-1] + 1])
    start, last = good[first], good[np.r_[first[1:], len(good)] - 1]
    length = last - start + k
    to = np.cumsum(length + 1)
    out = np.full(to[-1], -1, np.int32)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to - length - 1, length) + within] = codes[np.repeat(start, length) + within]
    return out


def groups(codes: np.ndarray, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of k words in a relation's stretches: where they begin, the group of each, and a first place of each group."""
    here = codes >= 0
    good = here[: len(codes) - k + 1].copy() if len(codes) >= k else np.zeros(0, bool)
    for j in range(1, k):
        good &= here[j : len(codes) - k + 1 + j]
    at = np.flatnonzero(good)
    group, one = codes[at].astype(np.int64), np.zeros(0, np.int64)
    for j in range(1, k):
        _, one, group = np.unique(group * n_words + codes[at + j], return_index=True, return_inverse=True)
    return at, group, at[one]


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each phrase; `ids` has a row for each of its words."""
    out = np.zeros(ids.shape[1], U64)
    for row in ids:
        out = mix(out * U64(0x9E3779B97F4A7C15) + row.astype(U64) + U64(1))
    return (out & U64((1 << bits) - 1)).astype(np.int64)


def _pages(k: int, bits: int):
    def run(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(k)])
            slot = slots(ids, bits)
            for page in np.unique(slot >> PAGE).tolist():
                bit = slot[slot >> PAGE == page] & ((1 << PAGE) - 1)
                np.bitwise_or.at(pages.setdefault(page, np.zeros(1 << PAGE - 3, np.uint8)), bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        for page, held in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["page", "bits"])

    return run


def _one_page(pages: pa.Table) -> pa.Table:
    held = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in pages.column("bits")])
    return pa.table({"page": pages.column("page").slice(0, 1), "bits": pa.array([held.tobytes()], pa.binary())})


def _bitmap(frequent: DataFrame, k: int) -> np.ndarray:
    """The bitmap of the frequent groups, 2^BITS bits at any size (16 MB)."""
    names = [f"w{j}" for j in range(k)]
    shape = "page int, bits binary"
    pages = frequent.select(names).mapInArrow(_pages(k, BITS), shape).groupBy("page").applyInArrow(_one_page, shape).collect()
    out = np.zeros((1 << BITS - PAGE, 1 << PAGE - 3), np.uint8)
    for r in pages:
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _relations(batches):
    """(chunk, lang, ids, codes) of each row of a relation."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, lang, ids, codes = (batch.column(j)[row].as_py() for j in range(4))
            yield chunk, lang, np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int32)


def _counts(k: int):
    """Counts of the phrases of k words of each chunk: (w0, .., c)."""

    def run(batches):
        names = [*[f"w{j}" for j in range(k)], "c"]
        for _, _, ids, codes in _relations(batches):
            _, group, first = groups(codes, k, len(ids))
            c = np.bincount(group, minlength=len(first)).astype(np.int64)
            for at in range(0, len(first), 100_000):
                some = first[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([*[pa.array(ids[codes[some + j]]) for j in range(k)], pa.array(c[at : at + 100_000])], names=names)

    return run


def _kept(k: int, bitmap):
    """Each chunk's occurrences of phrases of k words that the bitmap holds."""

    def run(batches):
        bits = bitmap.value
        for chunk, lang, ids, codes in _relations(batches):
            at, group, first = groups(codes, k, len(ids))
            slot = slots(np.stack([ids[codes[first + j]] for j in range(k)]), BITS)
            good = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            out = restricted(codes, k, at[good[group]])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([lang]), pa.array([ids.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "lang", "ids", "codes"])

    return run


def _frequent_words(chunks: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's occurrences of its frequent words (code, id); `ids` are by the codes that stay."""
    shape = {"chunk": pa.int64(), "lang": pa.string(), "ids": pa.binary(), "codes": pa.binary()}
    if not len(chunks) or not len(words):
        return pa.table({n: pa.array([], t) for n, t in shape.items()})
    codes = np.frombuffer(chunks.column("codes")[0].as_py(), np.int32)
    code, ids = words.column("code").to_numpy(), words.column("id").to_numpy()
    new = np.full(max(int(codes.max()), int(code.max())) + 2, -1, np.int32)  # the last is for -1
    new[code] = np.arange(len(code), dtype=np.int32)
    codes = new[codes]
    out = restricted(codes, 1, np.flatnonzero(codes >= 0))
    return pa.table({"chunk": chunks.column("chunk"), "lang": chunks.column("lang"), "ids": pa.array([ids.tobytes()], pa.binary()), "codes": pa.array([out.tobytes()], pa.binary())})


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of 2 to `longest` words that occur `least` times in a language.

    a, l and r are the occurrences of the phrase and of both parts of its lowest-scoring cut, n those of all words; the score is
    floor(1000000 * a * a / (l * r)), ties of cuts to the shorter first part. Phrases that a longer candidate contains with
    at least `within` percent of their occurrences are dropped. Higher scores come first, then higher a, then the phrase by bytes; `top` None
    ranks all. A null language is `und`, a null text empty; rows without an id or that repeat count as they are,
    other columns aren't read. No phrase that is frequent enough, or no rows: no rows.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    all_words = materialize(texts.mapInArrow(_chunks, "chunk long, lang string, words array<string>, counts array<long>, codes binary"), "occurrences")
    n = all_words.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    each = all_words.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("chunk", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    words = each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    frequent = {1: materialize(words.withColumn("w0", F.monotonically_increasing_id()), "frequent-1")}
    found = each.select("chunk", "lang", "word", "code").join(frequent[1].select("lang", "word", F.col("w0").alias("id")).hint("shuffle_hash"), ["lang", "word"]).select("chunk", "code", "id")
    again = docs.sparkSession.read.schema(all_words.schema).parquet(all_words.written_to)  # a frame of its own, as both sides stem from these chunks
    relation = materialize(again.select("chunk", "lang", "codes").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_frequent_words, RELATION), "relation-1")
    for k in range(2, longest + 1):
        names = [f"w{j}" for j in range(k)]
        counts = relation.mapInArrow(_counts(k), ", ".join(f"{x} long" for x in [*names, "c"]))
        frequent[k] = materialize(counts.repartition(*names).groupBy(names).agg(F.sum("c").alias("f")).where(F.col("f") >= least), f"frequent-{k}")
        before = relation
        if k < longest:
            bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(frequent[k], k))
            relation = materialize(before.mapInArrow(_kept(k, bitmap), RELATION), f"relation-{k}")
            bitmap.unpersist()
            discard(before)
    discard(relation)
    scored = None
    for k in range(2, longest + 1):
        some = _scored(_outer(frequent, k, longest, within), frequent, k)
        scored = some if scored is None else scored.unionByName(some)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if scored is None:
        scored = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long")
    if top is not None:  # a language may hold most rows: first the best of each of its parts
        dealt = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        scored = dealt.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= top).drop("k", "salt")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    out = materialize(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(all_words, *frequent.values())
    return out


def _outer(frequent: dict[int, DataFrame], k: int, longest: int, within: int) -> DataFrame:
    """Candidates of k words that no longer one contains too often. One word more is enough to look at: what contains a phrase contains one of those, as often at least."""
    names = [f"w{j}" for j in range(k)]
    if k == longest:
        return frequent[k]
    longer = frequent[k + 1]
    first = longer.select(*names, F.col("f").alias("g"))
    last = longer.select(*[F.col(f"w{j + 1}").alias(f"w{j}") for j in range(k)], F.col("f").alias("g"))
    most = first.union(last).groupBy(names).agg(F.max("g").alias("g"))
    return frequent[k].join(most, names, "left").where(F.col("g").isNull() | (F.col("g") * 100 < F.col("f") * within)).drop("g")


def _scored(candidates: DataFrame, frequent: dict[int, DataFrame], k: int) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates of k words."""
    out = candidates.withColumnRenamed("f", "a")
    for j in range(k):  # the words themselves
        one = frequent[1].select(F.col("w0").alias(f"w{j}"), F.col("word").alias(f"word{j}"), F.col("f").alias(f"f{j}_1"), *([F.col("lang")] if j == 0 else []))
        out = out.join(one, f"w{j}")
    for size in range(2, k):  # parts of several words, at the beginning and the end
        for at in {0, k - size}:
            part = frequent[size].select(*[F.col(f"w{i}").alias(f"w{at + i}") for i in range(size)], F.col("f").alias(f"f{at}_{size}"))
            out = out.join(part, [f"w{at + i}" for i in range(size)])
    big = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for j in range(1, k):
        left, right = F.col(f"f0_{j}"), F.col(f"f{j}_{k - j}")
        out = out.withColumns({f"num{j}": big(F.lit(1_000_000)) * big(F.col("a")) * big(F.col("a")), f"den{j}": big(left) * big(right)})
        cuts.append(F.struct(F.expr(f"num{j} div den{j}").alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r")))
    out = out.withColumn("best", F.array_min(F.array(*cuts)))
    return out.select("lang", F.concat_ws(" ", *[f"word{j}" for j in range(k)]).alias("phrase"), "a", "best.l", "best.r", "best.score")


#: The query's results in DuckDB SQL.
ORACLE = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece, w FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
      FROM documents)) WHERE len(w) > 0),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
    FROM pieces CROSS JOIN (VALUES (1), (2), (3)) sizes(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 10),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
inside AS (
  SELECT lang, phrase, max(a) AS g FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE k = 3)
  GROUP BY ALL),
cuts AS (
  SELECT c.*, j, array_to_string(w[1 : j], ' ') AS first_part, array_to_string(w[j + 1 : k], ' ') AS last_part
  FROM candidates c CROSS JOIN (VALUES (1), (2)) cut(j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, j
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = first_part JOIN f y ON y.lang = c.lang AND y.phrase = last_part),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE g IS NULL OR 100 * g < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
