"""Mixing sources to target weights (pivotal dependent rounding), DataFrame functions only.

Every document of a source has the same expected number of copies, target / size of the source. Its
whole part is taken; the fraction is rounded by the pivotal method on word masses: two documents with
fractional copies exchange mass, in a random direction whose odds keep both expectations, until one of
them is whole. What is left of a pair goes on to the next document. Groups of about `FAN` documents
are rounded at once by a fold inside Spark's `aggregate`; each leaves at most one fractional document,
and these meet in the groups of the next level, so that a source with n documents takes log(n) levels,
each with a shuffle of 1/FAN of the rows before. A hot source is many groups. The one document that is
left of a source gives the rest of its mass as a part (its first words), so that words taken equal the
target up to half a word; `copies` has it rounded to a whole copy by the same odds.

A row is named by its doc_id (which may be missing or repeat), a hash of text and source and a number among rows
that agree in both; rows are counted before they are numbered, so that no group of equal rows meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, join_rows, materialize, maybe_broadcast

FAN = 32
#: Equal rows that are numbered in one task.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, docs, target from (source, size, rows); one row a source.

    Targets are weight * level, or `cap` times the source's size where that is less; the level spends
    `share` of all sizes. Sources with the least cap by weight fill first, so the level is found by
    running sums over the sources. Only that table, one row a source, is ordered in one task.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("w").over(after))
    # The first source that its cap doesn't stop sets the level for all after it.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", "docs", F.coalesce(F.least("most", F.col("level") * F.col("w")), "most").alias("target"))


_FIELDS = ("id", "version", "n", "size", "base")
_EMPTY = "id: bigint, version: bigint, n: bigint, size: bigint, base: bigint"
_STEP = """
aggregate(items,
  named_struct('done', cast(array() as array<struct<{empty}, got: bigint>>), 'cur', cast(null as struct<{empty}, mass: double>)),
  (acc, x) -> CASE WHEN acc.cur IS NULL THEN named_struct('done', acc.done, 'cur', {first}) ELSE {pair} END)
"""
_UP = "least(acc.cur.size - acc.cur.mass, x.mass)"
_DOWN = "least(acc.cur.mass, x.size - x.mass)"
_U = "(shiftrightunsigned(xxhash64(acc.cur.id, acc.cur.version, acc.cur.n, x.id, x.version, x.n, {seed}L), 11) / 9007199254740992D)"


def _keep(row: str, mass: str) -> str:
    return f"named_struct({', '.join(f"'{c}', {row}.{c}" for c in _FIELDS)}, 'mass', {mass})"


def _done(row: str, got: str) -> str:
    return f"concat(acc.done, array(named_struct({', '.join(f"'{c}', {row}.{c}" for c in _FIELDS)}, 'got', cast({got} as bigint))))"


def _fold(seed: int) -> str:
    i, j = "acc.cur", "x"
    pair = f"""CASE
      WHEN {_U.format(seed=seed)} * ({_UP} + {_DOWN}) < {_DOWN} THEN
        CASE WHEN {i}.size - {i}.mass <= {j}.mass
          THEN named_struct('done', {_done(i, i + ".size")}, 'cur', {_keep(j, f"{j}.mass - ({i}.size - {i}.mass)")})
          ELSE named_struct('done', {_done(j, "0")}, 'cur', {_keep(i, f"{i}.mass + {j}.mass")}) END
      ELSE
        CASE WHEN {i}.mass <= {j}.size - {j}.mass
          THEN named_struct('done', {_done(i, "0")}, 'cur', {_keep(j, f"{j}.mass + {i}.mass")})
          ELSE named_struct('done', {_done(j, j + ".size")}, 'cur', {_keep(i, f"{i}.mass - ({j}.size - {j}.mass)")}) END
      END"""
    return _STEP.format(empty=_EMPTY, first=_keep("x", "x.mass"), pair=pair)


def _numbered(counted: DataFrame, most: int) -> DataFrame:
    """A row for each of `rows` equal ones, numbered `n`; long runs are numbered by many tasks."""
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / RUN))))
    if most > RUN:
        runs = runs.repartition("id", "version", "run")
    to = F.least(F.col("rows"), (F.col("run") + 1) * RUN) - 1
    return runs.withColumn("n", F.explode(F.sequence(F.col("run") * RUN, to))).drop("run", "rows")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, version (hash of text and source), size, source_size, target, taken (words), copies (whole).

    Sources by code point, null last, take `weights` in turn. Null and empty texts have size 0 and are
    taken 0 times; a source of size 0 has target 0. Repeated rows are documents of their own, with a
    row each; a missing doc_id stays null. The random choices are hashes of id, text and number, so reruns
    agree whatever the partitioning. No rows: no rows.
    """
    sizes = docs.select("doc_id", F.xxhash64("text", "source").alias("version"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes.groupBy(*ROW, "source", "size").agg(F.count("*").alias("rows")), "sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "targets").withColumnRenamed("source", "src")
    sources, largest = targets.agg(F.count("*"), F.max("docs")).first()
    most = sizes.agg(F.max("rows")).first()[0] or 0
    counted = sizes.join(maybe_broadcast(targets, sources), F.col("source").eqNullSafe(F.col("src")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keys = ["src", "source_size", "target"]
    rows = _numbered(counted.select(
        F.col("doc_id").alias("id"), "version", *keys, "size", "rows",
        F.floor(ratio).alias("base"), ((ratio - F.floor(ratio)) * F.col("size")).alias("mass"), F.ceil(F.col("docs") / FAN).alias("groups"),
    ), most)
    out = [F.col("id").alias("doc_id"), "version", "size", "source_size", "target", "taken", "copies"]
    parts = [rows.where("mass <= 0").withColumns({"taken": F.col("base") * F.col("size"), "copies": F.col("base")}).select(out)]
    level = rows.where("mass > 0").select(*_FIELDS, "mass", "groups", *keys)
    number, groups = 0, largest or 0
    while groups:
        number += 1
        groups = -(-groups // FAN)
        folded = materialize(
            level.groupBy(*keys, "groups", F.pmod(F.xxhash64("id", "version", "n", F.lit(seed + number)), "groups").alias("g"))
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), *_FIELDS, "mass"))).alias("items"))
            .select(*keys, "groups", F.expr(_fold(seed + number)).alias("f")),
            "mix",
        )
        done = folded.select(*keys, F.explode("f.done").alias("r")).select(*keys, "r.*")
        parts.append(done.withColumns({"taken": F.col("base") * F.col("size") + F.col("got"), "copies": F.col("base") + (F.col("got") > 0).cast("long")}).select(out))
        left = folded.where("f.cur is not null").select(*keys, "groups", "f.cur.*")
        odds = F.shiftrightunsigned(F.xxhash64("id", "version", "n", F.lit(seed)), 11) / F.lit(2.0**53)
        last = left.where("groups = 1").withColumns(
            {"taken": F.col("base") * F.col("size") + F.round("mass").cast("long"), "copies": F.col("base") + (odds * F.col("size") < F.col("mass")).cast("long")}
        )
        parts.append(last.select(out))
        level = left.where("groups > 1").withColumn("groups", F.ceil(F.col("groups") / FAN))
        if groups == 1:
            break
    return reduce(DataFrame.unionByName, parts)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it has whole copies; documents with none are left out.

    Rows that agree in doc_id, text and source are equal; their copies add up on one of them.
    """
    columns = docs.columns
    taken = mix(docs.select("doc_id", "source", "text"), **options)
    copies = materialize(taken.groupBy(*ROW).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "copies")
    joined = join_rows(docs.withColumn("__version", F.xxhash64("text", "source")), copies)
    if not copies.where("rows > 1").isEmpty():
        joined = joined.dropDuplicates(["doc_id", "__version"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(columns)
