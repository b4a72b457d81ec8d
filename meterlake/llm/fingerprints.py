"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A section is a run of paragraphs that ends at a blank line or where a paragraph's hash says so (about
every eighth), a paragraph is a line, a piece a sentence or less: sentences are cut where the hash of the
`WINDOW` code points before says so, and what is still longer than `MOST` at every `MOST` code points, so
that texts without blanks or full stops, or of one repeated word, have pieces too (some 12 code points on average).
Cuts depend on content alone, so an edit changes only the branches above it. A node's hash is
that of its children's; equal roots mean equal texts, and differing branches locate edits.

The fingerprint is of bounded size: the root and the lowest level of the tree that fits. Level 0 are the pieces; the boundary
behind a piece has a height that its last two pieces say (one in `RATIO` reaches each further level), a node of level q are the nodes of
level q - 1 up to the next boundary of height q, and its hash is that of their hashes in order. So each level is found from any lower one.
Texts of up to `KEPT` pieces (some 1,300 code points) have level 0 in it, longer ones the level of at most `NODES` nodes.
Fingerprints are compared from the root down: equal roots are 1; else both are brought to the higher of their two
levels, where equal branches count with all their text, as multisets, and differing ones not at all. That is exact on level 0; above it an edit costs the
nodes that it falls in. The branches of lines and sections, which locate edits, are made from a text where they are asked for (`differing`), or as a column by `trees`.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, materialize, mix

WINDOW = 8
#: Odds of a cut at a place within a sentence are one in so many; greatest length of a piece.
ODDS, MOST = 16, 32
#: Code points hashed at once, so that a long text costs little more than itself.
PART = 1 << 20
#: Pieces that a fingerprint holds at most, six characters each; nodes of a higher level in the same room, four each behind eight of its own.
KEPT = 112
NODES = (6 * KEPT - 8) // 4
#: Nodes of a level for each of the next, on average, and the highest level.
RATIO, HIGHEST = 1.3, 63
_MIXED = mix(np.arange(1, 0x110001, dtype=U64))


def _hash(x: bytes) -> str:
    return hashlib.blake2b(x, digest_size=8).hexdigest()


def _pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of 32 bits and lengths of the pieces in order, and how many go before each line, and in all."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    breaks = np.flatnonzero(c == 10)
    if len(breaks) == n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n + 2, np.int64)
    end = np.zeros(n, bool)
    stop = (c == 46) | (c == 33) | (c == 63)
    end[:-1] = stop[:-1] & ~stop[1:]
    for lo in range(0, max(0, n - WINDOW + 1), PART):  # windows that begin in this part
        part = c[lo : lo + PART + WINDOW - 1]
        total, ip = _sums(part)
        at = lo + np.flatnonzero((total[WINDOW:] - total[:-WINDOW]) * ip[: len(part) + 1 - WINDOW] < U64(2**64 // ODDS))
        k = np.searchsorted(breaks, at + WINDOW - 1)
        first = np.r_[0, breaks + 1][k]
        end[at[at >= first] + WINDOW - 1] = True
    end[breaks] = True
    end[breaks[breaks > 0] - 1] = True
    end[-1] = True
    stops = np.flatnonzero(end) + 1
    starts = np.r_[0, stops[:-1]]
    more = (stops - starts - 1) // MOST
    if more.any():
        starts = np.repeat(starts, more + 1)
        starts += MOST * (np.arange(len(starts)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
        stops = np.r_[starts[1:], n]
    words = c[starts] != 10
    starts, stops = starts[words], stops[words]
    size = stops - starts
    x = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):  # pieces of about a part
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + PART, "right")))
        a, b = starts[i:j] - starts[i], stops[i:j] - starts[i]
        total, ip = _sums(c[starts[i] : stops[j - 1]])
        x[i:j] = mix((total[b] - total[a]) * ip[a] + size[i:j].astype(U64)) >> U64(32)
        i = j
    return x, size, np.searchsorted(starts, np.r_[0, breaks + 1, n])


def _sums(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes of the code points before each place, and what brings a stretch's sum back to place 0."""
    p, ip = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, U64)
    np.cumsum(_MIXED[c] * p[: len(c)], out=total[1:])
    return total, ip


def _heights(x: np.ndarray) -> np.ndarray:
    """Height of the boundary behind each piece: from this piece and the one before, and how many equal pairs went before."""
    pair = x.copy()
    pair[1:] += mix(x[:-1])
    pair = mix(pair)
    order = np.argsort(pair, kind="stable")
    ordered = pair[order]
    at = np.arange(len(x))
    first = np.r_[True, ordered[1:] != ordered[:-1]][: len(x)]
    before = np.empty(len(x), U64)
    before[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    u = (mix(pair + before * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(float) + 0.5
    return np.minimum((53 * np.log(2) - np.log(u)) / np.log(RATIO), HIGHEST).astype(np.int64)


def _above(nodes: tuple[np.ndarray, np.ndarray, np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes (hash, height behind, length) of a level from those of the one below; an only child is its own parent."""
    h, height, size = nodes
    ends = np.r_[np.flatnonzero(height[:-1] >= level), len(h) - 1]
    if len(ends) == len(h):
        return nodes
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(1, len(h) + 1) - np.repeat(starts, ends - starts + 1)
    children = mix((place.astype(U64) << U64(32)) + (h << U64(6)) + height.astype(U64))
    parents = mix(np.add.reduceat(children, starts)) >> U64(51)
    return np.where(starts == ends, h[ends], parents), height[ends], np.add.reduceat(size, starts)


def _raised(nodes: tuple[np.ndarray, np.ndarray, np.ndarray], level: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    for k in range(level + 1, to + 1):
        nodes = _above(nodes, k)
    return nodes


def _level(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (hash of 31 bits, length) as nodes of level 0."""
    return mix(x) >> U64(51), _heights(x), size


def _equal(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of text in nodes that both have, as multisets."""
    total = float(sizes[0].sum() + sizes[1].sum())
    if not total:
        return 0.0
    keyed, orders = [], []
    for v, size in zip((a, b), sizes):
        order = np.lexsort((size, v))
        v = v[order]
        at = np.arange(len(v))
        first = np.r_[True, v[1:] != v[:-1]][: len(v)]
        keyed.append(v * U64(1 << 20) + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(U64))
        orders.append(order)
    _, i, j = np.intersect1d(*keyed, assume_unique=True, return_indices=True)
    return float(sizes[0][orders[0][i]].sum() + sizes[1][orders[1][j]].sum()) / total


class Fingerprint:
    """Root of a text's tree, the lowest level that fits with its number, and, made from a text, the tree itself.

    `held` are pieces (hash, length) on level 0, else nodes (hash, height, length code) and the text's length.
    `sections` is a list of (hash, [(hash, [(piece, length)])]); one read back from its string has none.
    """

    __slots__ = ("root", "level", "held", "total", "_branches", "_found")

    def __init__(self, root: str, level: int, held: tuple, total: int, branches: list = (), found=None):
        self.root, self.level, self.held, self.total, self._branches, self._found = root, level, held, total, branches, found

    @property
    def whole(self) -> bool:
        return self.level == 0

    @staticmethod
    def of(text: str) -> Fingerprint:
        sections, paragraphs = [], []

        def close():
            if paragraphs:
                sections.append((_hash("".join(paragraphs).encode()), paragraphs.copy()))
                paragraphs.clear()

        for line in text.split("\n"):
            h = _hash(line.encode("utf-8", "surrogatepass"))
            paragraphs.append(h)
            if not line.strip() or int(h[:4], 16) % 8 == 0:
                close()
        close()
        x, size, at = _pieces(text)
        root, total = hashlib.sha256("".join(h for h, _ in sections).encode()).hexdigest()[:32], int(size.sum())
        if len(x) <= KEPT:
            return Fingerprint(root, 0, (x >> U64(1), size), total, sections, (x, size, at))
        nodes = _level(x >> U64(1), size)
        # Nodes of each level: boundaries of its height, and the text's end.
        counts = np.cumsum(np.bincount(nodes[1][:-1], minlength=HIGHEST + 1)[::-1])[::-1] + 1
        level = int(np.argmax(counts[1:] <= NODES)) + 1 if counts[-1] <= NODES else HIGHEST + 1
        h, height, size_of = _raised(nodes, 0, level)
        code = np.clip(np.rint(16 + 3.5 * np.log2(size_of * (len(h) / total))), 0, 31).astype(np.int64)
        return Fingerprint(root, level, (h, height, code), total, sections, (x, size, at))

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, height and length of the nodes of a level, not below the one that is held."""
        if self.level == 0:
            return _raised(_level(*self.held), 0, level) if len(self.held[0]) else (self.held[0], self.held[1], self.held[1].astype(float))
        h, height, code = self.held
        size = 2.0 ** ((code - 16) / 3.5)
        return _raised((h, height, size * (self.total / size.sum())), self.level, level)

    @property
    def sections(self) -> list[tuple[str, list[tuple[str, list[tuple[str, int]]]]]]:
        if not self._branches:
            return []
        x, size, at = self._found
        pieces = list(zip([f"{h:08x}" for h in x.tolist()], size.tolist()))
        lines = iter([pieces[i:j] for i, j in zip(at.tolist(), at.tolist()[1:])])
        return [(h, [(p, next(lines)) for p in paragraphs]) for h, paragraphs in self._branches]

    def tree(self) -> str:
        """The whole tree: root, then per section its hash and, per paragraph, its hash and pieces (hash and length)."""
        return self.root + "".join(f"/{h}" + "".join(f";{p}" + "".join(f",{x}{n:x}" for x, n in pieces) for p, pieces in paragraphs) for h, paragraphs in self.sections)

    def __str__(self) -> str:
        """Root, `:` before all pieces (31 bits of hash, 5 of length less one) or `~` before nodes (13 bits of hash, 6 of height, 5 of length) with level and length of the text, in base 64."""
        if self.level == 0:
            x, size = self.held
            bits = np.unpackbits((x << U64(5) | (size - 1).astype(U64)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 28:]
            return self.root + ":" + base64.b64encode(np.packbits(bits.reshape(-1)).tobytes()).decode()[: 6 * len(x)]
        h, height, code = self.held
        packed = (h << U64(11)) | (height.astype(U64) << U64(5)) | code.astype(U64)
        return self.root + "~" + base64.b64encode((self.level << 41 | self.total).to_bytes(6) + packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 5:].tobytes()).decode()

    @staticmethod
    def parse(s: str) -> Fingerprint:
        root, rest = s[:32], s[33:]
        raw = np.frombuffer(base64.b64decode(rest + "A" * (-len(rest) % 4)), np.uint8)
        if s[32] == "~":
            top = int.from_bytes(raw[:6].tobytes())
            v = np.zeros((len(raw) // 3 - 2, 8), np.uint8)
            v[:, 5:] = raw[6:].reshape(-1, 3)
            v = v.view(">u8").reshape(-1).astype(U64)
            return Fingerprint(root, top >> 41, (v >> U64(11), (v >> U64(5) & U64(63)).astype(np.int64), (v & U64(31)).astype(np.int64)), top & (1 << 41) - 1)
        bits = np.unpackbits(raw)[: 6 * len(rest)].reshape(-1, 36)
        padded = np.zeros((len(bits), 64), np.uint8)
        padded[:, 28:] = bits
        v = np.packbits(padded, axis=1).view(">u8").reshape(-1).astype(U64)
        size = (v & U64(31)).astype(np.int64) + 1
        return Fingerprint(root, 0, (v >> U64(5), size), int(size.sum()))

    def likeness(self, other: Fingerprint) -> float:
        if self.root == other.root:
            return 1.0
        level = max(self.level, other.level)
        if level == 0:
            (a, m), (b, n) = self.held, other.held
            return _equal(a << U64(5) | (m - 1).astype(U64), b << U64(5) | (n - 1).astype(U64), (m, n))
        (a, g, m), (b, k, n) = self.nodes(level), other.nodes(level)
        return _equal(a << U64(6) | g.astype(U64), b << U64(6) | k.astype(U64), (m, n))

    def differing(self, other: Fingerprint) -> list[tuple[int, int]]:
        """(section, paragraph) of this text that the other doesn't have: where the edits are. Both must be made from texts."""
        sections, lines = {h for h, _ in other._branches}, {p for _, ps in other._branches for p in ps}
        return [(i, j) for i, (h, ps) in enumerate(self._branches) if h not in sections for j, p in enumerate(ps) if p not in lines]


def trees(docs: DataFrame) -> DataFrame:
    """doc_id and `tree`, the whole tree spelled out (about as long as the text), one row per row; null counts as ''. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for k in range(len(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([Fingerprint.of(texts[k].as_py()).tree()])], names=["doc_id", "tree"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tree string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BLOCK = 64
#: Ranges of doc_id that are looked up by comparison, and the parts that each falls into at most.
RANGES, PARTS = 1024, 64


def _compare(batches):
    """Rows (place, doc_id, text, halo, copies) in order: each row against the next of its place."""
    held = None

    def step(row, nxt, tree, after):
        text, n = row[2], len(row[2])
        k = n // 3
        edited = text[: n - k] + nxt[2][:k]
        changed = Fingerprint.of(edited)
        return row[1], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(tree), str(changed), tree.likeness(changed), tree.likeness(after), row[4]

    names = [*(x.split()[0] for x in SCHEMA.split(", ")), "copies"]
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            out = []
            b = batch.slice(at, BLOCK)
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(k).to_pylist() for k in (2, 3, 4))):
                tree = Fingerprint.of(row[2])
                if held is not None and held[0][0] == row[0]:
                    out.append(step(held[0], row, held[1], tree))
                held = None if row[3] else (row, tree)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 1, 7) else pa.string() if k < 5 else pa.float64()) for k, c in enumerate(zip(*out))], names=names)


def fingerprints(docs: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """Fingerprint of each text and of its edited text (see SCHEMA).

    The next document is the one before it by doc_id, after the last comes the first; ties of doc_id go by the
    text's hash, then text, rows without a doc_id come last, and a document alone is its own next. Null counts as ''.

    Rows are dealt to places, runs of the order of about `rows_per_bucket` rows: ranges between quantiles of doc_id, cut
    evenly by value into up to `PARTS`; an id (or none) that holds more than a place and a `RANGES`th of all rows
    has ranges of the hash to itself, and of more equal rows than a place takes two stand for all. Each place also
    gets the first row of the one after, so every text is shuffled once. A row is streamed past with the one
    before it held, so memory stays that of two texts also where a place is larger (from `RANGES` * `PARTS` places on, places grow).
    Row keys (id, hash) alone are counted, and a row a place reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("version"), "text")
    keys = materialize(docs.groupBy("k", "version").agg(F.count("*").alias("n")), "keys")
    rows, least, most = keys.agg(F.sum("n"), F.min("k"), F.max("k")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    per = max(rows_per_bucket, -(-rows // (RANGES * PARTS)))
    places = -(-rows // per)
    ranges = min(RANGES, places)
    hot = {r.k: -(-r.rows // per) for r in keys.groupBy("k").agg(F.sum("n").alias("rows")).where((F.col("rows") > per) & (F.col("rows") * RANGES > rows)).collect()}
    share = [i / ranges for i in range(1, ranges)]
    quantiles = {int(c) for c in keys.approxQuantile("k", share, 0.2 / ranges)} if share else set()
    cuts = sorted(c for c in quantiles | set(hot) | {k + 1 for k in hot} if least < c <= most)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("range", _position(F.col("k"), cuts)).withColumn("place", _place(cuts, least, most, -(-places // ranges), hot))

    # The first row of a place follows the last row of the place before; places are numbered in order.
    heads = placed(keys).groupBy("place").agg(F.min(F.struct(F.bitwise_not("k").alias("nk"), "version")).alias("r")).select("place", "r.*").collect()
    order = sorted((r.place, ~r.nk, r.version) for r in heads)
    head_rows = spark.createDataFrame([(*x, order[i - 1][0]) for i, x in enumerate(order)], "place long, k long, version long, goes_to long")
    everything = placed(docs).select("place", "k", "doc_id", "version", "text")
    halo = everything.join(F.broadcast(head_rows), ["place", "k", "version"]).groupBy("goes_to").agg(F.min(F.struct("text", "doc_id", "k", "version")).alias("r"))
    halo = halo.select(F.col("goes_to").alias("place"), "r.k", "r.doc_id", "r.version", "r.text", F.lit(True).alias("halo"), F.lit(0).alias("turn"), F.lit(1).cast("long").alias("copies"))
    # At most one row a place, as each holds more than a place's rows.
    equal = spark.createDataFrame(keys.where(F.col("n") > per).select("k", "version").collect(), "k long, version long")
    plain = [F.lit(False).alias("halo"), F.lit(0).alias("turn"), F.lit(1).cast("long").alias("copies")]
    repeats = not equal.isEmpty()
    if repeats:
        # Each of equal rows is followed by another, but for the last.
        runs = everything.join(F.broadcast(equal), ["k", "version"]).groupBy("place", "k", "doc_id", "version", "text").agg(F.count("*").alias("n"))
        turns = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1, 1).otherwise(0)))
        runs = runs.withColumns({"halo": F.lit(False), "turn": turns}).withColumn("copies", F.when((F.col("turn") == 0) & (F.col("n") > 1), F.col("n") - 1).otherwise(1)).drop("n")
        everything = everything.join(F.broadcast(equal), ["k", "version"], "left_anti").select("*", *plain).unionByName(runs)
    else:
        everything = everything.select("*", *plain)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = everything.unionByName(halo).repartition(n, "place").sortWithinPartitions("place", "halo", F.desc("k"), "version", "text", "turn")
    out = ordered.select("place", "doc_id", "text", "halo", "copies").mapInArrow(_compare, SCHEMA + ", copies long")
    return (out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) if repeats else out).drop("copies")


def _place(cuts: list[int], least: int, most: int, parts: int, hot: dict[int, int]) -> Column:
    """Number of a row's place, in descending order of k: from its `range`, and the part by value within, or by hash for a hot k."""
    bounds = [least, *cuts, most + 1]
    spread = [hot.get(a, parts) for a in bounds[:-1]]
    at = F.col("range")
    if max(spread) == 1:
        return -at.cast("long")
    pick = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), at)
    by_hash = F.col("version") / F.lit(2.0**64) + 0.5
    by_value = (pick(bounds[1:]) - F.col("k").cast("double")) / pick([b - a for a, b in zip(bounds, bounds[1:])])
    share = F.when(pick([a in hot for a in bounds[:-1]]) == 1, by_hash).otherwise(by_value)
    part = F.least(F.greatest(F.floor(share * pick(spread)), F.lit(0)), pick(spread) - 1)
    return (F.lit(0) - at) * (1 << 20) + part.cast("long")


def _position(k: Column, cuts: list[int], block: int = 32) -> Column:
    """Number of `cuts` that k has reached: among the firsts of blocks, then within one."""
    blocks = [cuts[i : i + block] for i in range(0, len(cuts), block)] or [[]]
    lists = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<long>")
    reached = lambda xs: F.size(F.filter(xs, lambda c: c <= k))
    b = reached(lists([x[0] for x in blocks[1:]]))
    return b * block + reached(F.get(F.array(*[lists(x) for x in blocks]), b))
