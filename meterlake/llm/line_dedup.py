"""Line dedup (log-template tree), DataFrame functions only.

Every line is parsed into a tree of fixed depth: first the number of its tokens, then its leading
tokens, in which a token with a digit counts as the variable field <*>. In a leaf, lines share a
template if they agree on all further tokens but one quarter of them (the tail is cut into four
segments; a template may have one segment as a variable field). A template found in `min_docs`
documents or more recurs: its lines are dropped, but for the first (least doc_id, missing ones last, then hash of the text,
then position), so that no text is lost from the corpus. Lines with fewer than `min_tokens` constant tokens
aren't templates: neither short lines nor rows of numbers are. With `exact`, a line whose words are all the
same, digits included, recurs whatever its length (lines without a word never do). A passage is a line of over
50 words; with `passages` it recurs, word by word, from two documents of different texts on.

At scale: a leaf that holds fewer lines than `min_docs` can't hold a recurring template, so after one
aggregation of leaf hashes only the lines of frequent leaves go on; documents, counts and firsts are
aggregated with map-side combine, so that a line in a third of all documents costs one row a task. Texts
are shuffled once, to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, join_rows, materialize, maybe_broadcast, with_version

SEGMENTS = 4
#: Words from which a line is a passage, and documents that it takes to recur.
PASSAGE_WORDS, PASSAGE_DOCS = 51, 2


def _tokens(lines: DataFrame) -> DataFrame:
    """`raw`: the words of each line. Rare cases are looked for first, so that most lines meet one cheap search each."""
    blanks = F.when(F.col("line").rlike(r"[\t\x0B\f\r]"), F.translate("line", "\t\x0b\f\r", "    ")).otherwise(F.col("line"))
    return lines.withColumn("raw", F.array_remove(F.split(blanks, " "), ""))


def _template(tokens: Column, depth: int) -> tuple[Column, Column]:
    """Hash of the leaf, and the hashes of the line's five templates."""
    n = F.size(tokens)
    tail = F.greatest(n - depth, F.lit(0))
    cut = [F.floor(tail * k / SEGMENTS).cast("int") for k in range(SEGMENTS + 1)]
    leaf = F.xxhash64(n, F.slice(tokens, 1, depth))
    parts = [F.xxhash64(F.slice(tokens, cut[k] + depth + 1, cut[k + 1] - cut[k])) for k in range(SEGMENTS)]
    return leaf, F.array(*parts)


def line_keys(docs: DataFrame, min_docs: int, depth: int, min_tokens: int, exact: bool, passages: bool, templates: bool = True) -> DataFrame:
    """doc_id, version, pos, leaf, templates (hashes) and the documents that each `need`s, a row for each way in which a line may recur."""
    lines = _tokens(docs.select(*ROW, F.posexplode(F.split("text", "\n")).alias("pos", "line")))
    lines = lines.select(*ROW, "pos", "line", "raw", F.size("raw").alias("words"))
    kinds = []
    if exact or passages:
        whole = F.xxhash64(F.lit(-2), "raw")
        need = F.when(F.col("words") >= PASSAGE_WORDS, PASSAGE_DOCS if passages else min_docs).otherwise(min_docs if exact else None)
        found = F.struct(whole.alias("leaf"), F.array(whole).alias("templates"), need.cast("int").alias("need"))
        kinds.append(F.when((F.col("words") > 0) & need.isNotNull(), found))
    if templates:
        mask = F.array_remove(F.split(F.regexp_replace(F.array_join("raw", " "), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>"), " "), "")
        t = F.when(F.col("line").rlike("[0-9]"), mask).otherwise(F.col("raw"))
        lines = lines.select(*ROW, "pos", "raw", "words", t.alias("t"))
        lines = lines.select("*", F.when(F.col("words") >= min_tokens, F.size(F.array_remove("t", "<*>"))).otherwise(0).alias("constant"), *(c.alias(x) for c, x in zip(_template(F.col("t"), depth), ("tree", "parts"))))
        s = [F.col("parts")[k] for k in range(SEGMENTS)]
        five = F.array(F.xxhash64(F.lit(-1), "tree", *s), *[F.xxhash64(F.lit(w), "tree", *[x for k, x in enumerate(s) if k != w]) for w in range(SEGMENTS)])
        kinds.append(F.when(F.col("constant") >= min_tokens, F.struct(F.col("tree").alias("leaf"), five.alias("templates"), F.lit(min_docs).alias("need"))))
    # A way that isn't open is null and filtered behind the explode, so that no condition repeats the parsing.
    return lines.select(*ROW, "pos", F.explode(F.array(*kinds)).alias("k")).where("k is not null").select(*ROW, "pos", "k.*")


def recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, min_tokens: int = 6, exact: bool = False, passages: bool = False) -> DataFrame:
    """Written (doc_id, version, drop): the positions (from 0) of the lines to drop; documents without such lines have no row."""
    return _recurring(line_keys(with_version(docs.select("doc_id", "text")), min_docs, depth, min_tokens, exact, passages))


def _recurring(lines: DataFrame) -> DataFrame:
    lines = materialize(lines, "lines")
    leaves = materialize(lines.groupBy("leaf", "need").count().where(F.col("count") >= F.col("need")).select("leaf", "need"), "leaves")
    rows = materialize(lines.join(maybe_broadcast(leaves), ["leaf", "need"]).select(*ROW, "pos", "need", F.explode("templates").alias("template")), "templates")
    discard(lines, leaves)
    order = F.struct(F.col("doc_id").isNull().alias("last"), *ROW, "pos")  # a missing id comes last
    by_doc = rows.groupBy("template", "need", *ROW).agg(F.min("pos").alias("pos"))
    found = by_doc.groupBy("template", "need").agg(F.count("*").alias("docs"), F.min("version").alias("lo"), F.max("version").alias("hi"), F.min(order).alias("first"))
    enough = (F.col("docs") >= F.col("need")) & ((F.col("need") > PASSAGE_DOCS) | (F.col("lo") != F.col("hi")))
    recurring = materialize(found.where(enough).select("template", "need", "first"), "recurring")
    hits = rows.join(maybe_broadcast(recurring), ["template", "need"]).where(~order.eqNullSafe(F.col("first")))
    drops = materialize(hits.groupBy(*ROW).agg(F.collect_set("pos").alias("drop")), "drops")
    discard(rows, recurring)
    return drops


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, min_tokens: int = 6, exact: bool = False, passages: bool = False) -> DataFrame:
    """`docs` with its columns, recurring lines taken out of `text`, and n_lines, n_dropped.

    Null text stays null with 0 lines; a text all of whose lines recur elsewhere becomes ''. Rows
    that repeat a doc_id (or have none) and the text count as one document and lose the same lines; with
    another text they are a document of their own. No rows: no rows.
    """
    drops = recurring_lines(docs, min_docs, depth, min_tokens, exact, passages)
    return without_lines(join_rows(with_version(docs, "__version"), drops, "left")).drop("__version")


def recurring_passages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Like recurring_lines, for passages of the documents whose rows (doc_id, version) `kept` names."""
    lines = line_keys(with_version(docs.select("doc_id", "text")), PASSAGE_DOCS, 0, 0, exact=False, passages=True, templates=False)
    return _recurring(join_rows(lines, kept.select(*ROW), "left_semi", version="version"))


def without_lines(docs: DataFrame) -> DataFrame:
    """`docs` with an array `__drop` of positions (or null): `text` without those lines, n_lines and n_dropped; `__drop` goes."""
    docs = docs.withColumn("__lines", F.split("text", "\n"))
    drop, some = F.col("__drop"), F.col("text").isNotNull()
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), drop)
    kept = F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")
    return docs.withColumns(
        {
            "n_lines": F.when(some, F.size("__lines")).otherwise(0).cast("long"),
            "n_dropped": F.when(some & drop.isNotNull(), F.size(drop)).otherwise(0).cast("long"),
            "text": F.when(some & drop.isNotNull(), kept).otherwise(F.col("text")),
        }
    ).drop("__drop", "__lines")


#: The same in DuckDB, for the parameters of the registered query; documents are distinct (doc_id, text).
ORACLE = r"""
WITH docs AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS r, dense_rank() OVER (ORDER BY text) AS version FROM (SELECT DISTINCT doc_id, text FROM documents)),
lines AS (
  SELECT doc_id, r, version, i - 1 AS pos, l[i] AS line
  FROM (SELECT doc_id, r, version, string_split(text, chr(10)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS u(i)),
words AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS raw FROM lines),
tokens AS (SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM words),
parts AS (
  SELECT doc_id, r, version, pos, len(t) AS n, t[1:3] AS head,
    list_transform(range(0, 4), lambda k: t[4 + ((len(t) - 3) * k) // 4 : 3 + ((len(t) - 3) * (k + 1)) // 4]) AS s
  FROM tokens WHERE len(list_filter(t, lambda x: x <> '<*>')) >= 6),
templates AS (
  SELECT doc_id, r, version, pos, 10 AS need, hash(w, n, head, list_transform(range(0, 4), lambda k: CASE WHEN k = w THEN NULL ELSE s[k + 1] END)) AS template
  FROM parts, unnest(range(-1, 4)) AS u(w)
  UNION ALL SELECT doc_id, r, version, pos, CASE WHEN len(raw) > 50 THEN 2 ELSE 10 END, hash(-2, raw) FROM words WHERE len(raw) > 0),
recurring AS (
  SELECT template, need, min({'d': doc_id, 'r': r, 'p': pos}) AS first FROM templates GROUP BY template, need
  HAVING count(DISTINCT r) >= need AND (need > 2 OR count(DISTINCT version) > 1)),
drops AS (
  SELECT DISTINCT r, pos FROM templates JOIN recurring USING (template, need) WHERE {'d': doc_id, 'r': r, 'p': pos} <> first),
kept AS (
  SELECT l.r, count(*) AS n_lines, count(d.pos) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN drops d ON l.r = d.r AND l.pos = d.pos GROUP BY l.r)
SELECT o.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, CASE WHEN o.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents o JOIN docs d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text IS NOT DISTINCT FROM d.text LEFT JOIN kept k USING (r)
"""
