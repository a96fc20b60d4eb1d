"""Exact dedup by content sort.

The normalised texts are written once. Sampled splitters range-partition them by their beginnings and,
where these are alike, their hashes; each partition is sorted externally by the whole text, so that equal
texts stand together, and each row is compared in full with its neighbour to find where a run of equals
ends. The first of a run has the most code points and then the least id.

A text with more than ``hot`` rows, by the counts of the hashes, is cut into that many times as many runs,
which may lie in different partitions. The first rows of these runs, with their texts, are sorted and
compared in the same way and so stitched; all other texts have one run.

Defined results: a null text counts as empty; empty texts equal each other; among equal texts the row
with the most code points stays, then the smallest id (a null id last), and of rows repeated with one
id exactly one is ``kept``. An empty table gives no rows. Other columns are ignored by
``duplicate_groups`` and passed on by ``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import broadcast_up_to, staged, table, without_blanks

#: Characters of a text in the sort's splitters, and rows of one text in a run.
HEAD, HOT = 32, 10_000


def normalised(text: Column) -> Column:
    return without_blanks(F.coalesce(text, F.lit("")))


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_sha256, mark (a hash of the text), part (of a hot
    text), its place in its run of equal texts, the run's rows, and its first row's head_id and head_chars;
    ``norm`` is the text of the first rows of a hot text's runs, and null elsewhere."""
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
            normalised(F.col(text_col)).alias("norm"),
        )
        # The splitters, which the driver gathers, are short: a text's beginning, then its hash.
        .withColumn("head", F.substring("norm", 1, HEAD))
        .withColumn("mark", F.xxhash64("norm")),
        "normalised",
    )
    many = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("mark", F.ceil(F.col("n") / hot).alias("parts"))
    rows = rows.join(broadcast_up_to(staged(many, "hot-texts"), 100_000), "mark", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id", "n_chars"), F.col("parts")), F.lit(0)).cast("int")
    )
    run = Window.partitionBy("head", "mark", "norm", "part")
    first = run.orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last())
    return staged(
        rows.repartitionByRange("head", "mark", "part")
        .withColumn("place", F.row_number().over(first))
        .withColumn("head_id", F.first("doc_id").over(first))
        .withColumn("head_chars", F.first("n_chars").over(first))
        .withColumn("rows", F.count(F.lit(1)).over(run))
        .select(
            "doc_id", "mark", "part", "place", "rows", "head_id", "head_chars", F.sha2("norm", 256).alias("text_sha256"),
            F.when((F.col("place") == 1) & F.col("parts").isNotNull(), F.col("norm")).alias("norm"),
        ),
        "content-sort",
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    placed = sorted_runs(docs, id_col, text_col, hot)
    text = Window.partitionBy("mark", "norm")
    best = text.orderBy(F.col("head_chars").desc(), F.col("head_id").asc_nulls_last(), "part")
    stitched = placed.filter("norm is not null").select(
        "mark",
        "part",
        "text_sha256",
        F.sum("rows").over(text).alias("all_rows"),
        F.first("head_id").over(best).alias("best_id"),
        F.first("part").over(best).alias("best_part"),
    )
    whole = F.col("best_part").isNull()
    return placed.join(broadcast_up_to(staged(stitched, "stitched"), 100_000), ["mark", "part", "text_sha256"], "left").select(
        "doc_id",
        F.when(whole, F.col("head_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("all_rows", "rows").alias("group_size"),
        ((F.col("place") == 1) & (whole | (F.col("part") == F.col("best_part")))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key = lambda id_, sha: F.sha2(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), sha), 256)
    kept = duplicate_groups(docs, id_col, text_col, hot).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.length(F.col(text_col)).alias("size"), key(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)).alias("key"))
    once = Window.partitionBy("key").orderBy(F.col("size").desc_nulls_last())
    rows = rows.join(kept, "key", "left_semi").withColumn("place", F.row_number().over(once)).filter("place = 1")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op5_content_sort": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
}
QUERIES = {"op5_content_sort": op5_content_sort}
