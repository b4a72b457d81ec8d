"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage gets all that its predecessor kept, written as Parquet to the shared checkpoint folder and
read again. All but the last return the columns of `documents`. Rows may lack a doc_id or repeat one: they are told
apart by their texts in every stage. Null and empty texts pass all stages but the mix, which takes them as often as
whole copies say (size 0: as its source's share). No rows: no rows.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from meterlake.llm.common import discard, materialize, table, with_version


#: Columns that stages read or change; all others travel through a stage in one struct, so that no name of theirs can clash.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_others(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in KNOWN]
        if not others:
            return stage(spark, docs, sf_dir)
        plain = lambda c: F.col(f"`{c}`")
        packed = docs.select(*[plain(c) for c in docs.columns if c in KNOWN], F.struct(*[plain(c) for c in others]).alias("other_columns"))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col("other_columns").getField(c).alias(c) if c in others else plain(c) for c in docs.columns])

    return run


@keeping_others
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. It learns from the labels of the stage's own documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@keeping_others
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur, as a template or word by word, go, but for the first; n_chars follows the text."""
    return _as_before(line_dedup.drop_recurring_lines(docs, exact=True), docs)


def _as_before(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with n_chars of the text as it is now where lines went."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.selectExpr("* except (n_chars)", "CASE WHEN n_dropped > 0 THEN length(text) ELSE n_chars END AS n_chars")
        cleaned = cleaned.withColumn("n_chars", cleaned["n_chars"].cast(kind))
    return cleaned.select(docs.columns)


@keeping_others
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays; passages that still recur go, but for the first.

    What stays and what it loses is found on row keys first, so that each text is shuffled once for both.
    """
    kept = jaccard_join.representatives(docs)
    passages = line_dedup.recurring_passages(docs, kept)
    drops = passages.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "drop")
    plan = materialize(kept.join(drops.hint("merge"), kept["doc_id"].eqNullSafe(F.col("id")) & (F.col("version") == F.col("v")), "left").drop("id", "v"), "plan")
    discard(kept, passages)
    blank = jaccard_join.blank(docs)
    rows = jaccard_join.one_of_each(with_version(docs, "__version").where(~blank), plan)
    return _as_before(line_dedup.without_lines(rows), docs).union(docs.where(blank))


@keeping_others
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte offsets and digests."""
    return bpe.encode_documents(docs, bpe.vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The trained model and the hashed choices of the mix have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
