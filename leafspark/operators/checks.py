"""Verification: named checks of an output, in rows of (doc_id, name, ok, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages of a document before and after: page count kept, no text left, metadata aside."""
    a = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    b = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("now"), F.sum(F.length(F.trim("text"))).alias("chars"))
    both = a.join(b, "doc_id", "left").na.fill(0, ["now", "chars"])
    checks = F.array(
        F.struct(F.lit("parses").alias("name"), (F.col("now") > 0).alias("ok"), F.col("now").cast("string").alias("detail")),
        F.struct(F.lit("page-count").alias("name"), (F.col("now") == F.col("pages")).alias("ok"), F.concat_ws("/", "now", "pages").alias("detail")),
        F.struct(F.lit("no-extractable-text").alias("name"), (F.col("chars") == 0).alias("ok"), F.col("chars").cast("string").alias("detail")),
    )
    return both.select("doc_id", F.inline(checks))


def forbidden_strings(texts: DataFrame, needles: DataFrame, part_chars: int = 8 << 20) -> DataFrame:
    """``needles(item_id, needle)`` to the texts that hold each, whole needles in whole texts. Substring
    tests have no key to join by: each task reads its texts once through an automaton of the needles. A
    list of more than ``part_chars`` characters is taken in parts of that size, one pass over the texts
    each. Null and empty needles are in no text."""
    from collections.abc import Iterator

    import ahocorasick
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField("item_id", needles.schema["item_id"].dataType), StructField("doc_id", texts.schema["doc_id"].dataType)])
    schema = to_arrow_schema(out)
    held = needles.filter("length(needle) > 0").select("item_id", "needle")

    def search(found: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, items = ahocorasick.Automaton(), {}
            for item, needle in found:
                items.setdefault(needle, []).append(item)
            for needle, own in items.items():
                automaton.add_word(needle, own)
            automaton.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = {id(x): x for _, x in automaton.iter(text)} if text else {}
                    for x in own.values():
                        hits.extend(x)
                        rows.extend([k] * len(x))
                yield pa.RecordBatch.from_arrays([pa.array(hits, schema.field(0).type), batch.column(0).take(pa.array(rows, pa.int64()))], schema=schema)

        return texts.select("doc_id", "text").mapInArrow(run, out)

    # The driver holds one part of the list at a time.
    parts, now, size = [], [], 0
    for row in held.toLocalIterator():
        if now and size + len(row.needle) > part_chars:
            parts.append(search(now))
            now, size = [], 0
        now.append((row.item_id, row.needle))
        size += len(row.needle)
    if now:
        parts.append(search(now))
    result = texts.sparkSession.createDataFrame([], out)
    for part in parts:
        result = result.union(part)
    return result


def occurrences(text, needle):
    """How often a string occurs, not counting overlaps."""
    return F.when(F.length(needle) == 0, 0).otherwise((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def edit_checks(edits: DataFrame) -> DataFrame:
    """``edits(id, before, after, old, new)``: the new text is there once more for each old one gone, and
    no old one is left over."""
    gone = occurrences(F.col("before"), F.col("old")) - occurrences(F.col("after"), F.col("old"))
    come = occurrences(F.col("after"), F.col("new")) - occurrences(F.col("before"), F.col("new"))
    checks = F.array(
        F.struct(F.lit("replacement-present").alias("name"), (come >= 1).alias("ok"), come.cast("string").alias("detail")),
        F.struct(F.lit("residual-original").alias("name"), (gone >= 1).alias("ok"), gone.cast("string").alias("detail")),
    )
    return edits.select("id", F.inline(checks))


def placeholder_differences(pairs: DataFrame) -> DataFrame:
    """``pairs(id, before, after)`` to placeholders that one text has more often than the other."""
    from leafspark.functions.text import placeholders

    count = lambda c: pairs.select("id", F.explode(placeholders(F.col(c))).alias("mark")).groupBy("id", "mark").agg(F.count(F.lit(1)).alias(c))
    both = count("before").join(count("after"), ["id", "mark"], "full_outer").na.fill(0, ["before", "after"])
    kind = F.when(F.col("before") > F.col("after"), "missing").otherwise("unknown")
    return both.filter("before <> after").select("id", "mark", kind.alias("kind"), F.abs(F.col("before") - F.col("after")).alias("n"))


def all_passed(checks: DataFrame, keys: list[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and("ok").alias("ok"))
