"""Tables of a folder, and the paged views of their texts."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a page in the view of documents as paged texts.
LINES_PER_PAGE = 4
#: A monospaced line: left and top margin, pitch, and width of a character, in points.
MARGIN, PITCH, ADVANCE, FONT = 72.0, 12.0, 6.0, 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _selected(rows: str, columns: str, more: str | None, kinds: dict[str, str]) -> str:
    names, types = zip(*(c.split(maxsplit=1) for c in columns.split(", ")), strict=True)
    casts = ", ".join(f"CAST({n} AS {kinds.get(t, t)}) AS {n}" for n, t in zip(names, types, strict=True))
    parts = [f"(VALUES {rows}) AS t({', '.join(names)})", *([f"({more}) AS t({', '.join(names)})"] if more else [])]
    return " UNION ALL ".join(f"SELECT {casts} FROM {part}" for part in parts)


def literal(spark: SparkSession, sf_dir: str, rows: str, columns: str, more: str | None = None) -> DataFrame:
    """``rows`` as in VALUES, the odd cases, typed by ``columns`` ("a int, b string"), and the rows that ``more``
    selects of the tables it names in braces."""
    used = {f[1] for f in Formatter().parse(more or "") if f[1]}
    rows = rows.replace("{", "{{").replace("}", "}}") if used else rows
    return spark.sql(_selected(rows, columns, more, {}), **{t: table(spark, sf_dir, t) for t in used})


def literal_sql(rows: str, columns: str, more: str | None = None) -> str:
    """The same relation for the oracle."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    return "(" + _selected(rows, columns, more and re.sub(r"\{(\w+)\}", r"\1", more), kinds) + ")"


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def doc_pages(docs: DataFrame, lines: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, page_index (from 0), text: every ``lines`` lines; nothing is shuffled."""
    all_ = F.split("text", "\n")
    count = F.ceil(F.size(all_) / lines).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(all_, i * lines + 1, F.lit(lines)), "\n"))
    return docs.select("doc_id", F.posexplode(pages).alias("page_index", "text"))


def doc_runs(docs: DataFrame, lines: int = LINES_PER_PAGE) -> DataFrame:
    """One run for each line, as a monospaced page would have it."""
    row = F.col("line_no") % lines
    return doc_lines(docs).select(
        "doc_id",
        F.floor(F.col("line_no") / lines).cast("int").alias("page_index"),
        row.alias("run_no"),
        "text",
        F.lit(FONT).alias("font_size"),
        F.lit(MARGIN).alias("x"),
        (F.lit(MARGIN) + F.lit(PITCH) * row).alias("y"),
        (F.lit(ADVANCE) * F.length("text")).alias("width"),
        F.lit(PITCH).alias("height"),
    )


#: The views above for the oracle, as common table expressions.
LINES_SQL = "doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no FROM documents)"
PAGES_SQL = LINES_SQL + ", doc_pages AS (SELECT doc_id, (line_no // 4)::INTEGER AS page_index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM doc_lines GROUP BY 1, 2)"
RUNS_SQL = LINES_SQL + ", doc_runs AS (SELECT doc_id, (line_no // 4)::INTEGER AS page_index, line_no % 4 AS run_no, text, 10.0::DOUBLE AS font_size, 72.0::DOUBLE AS x, 72.0::DOUBLE + 12.0::DOUBLE * (line_no % 4) AS y, 6.0::DOUBLE * length(text) AS width, 12.0::DOUBLE AS height FROM doc_lines)"


def write_text(pages: DataFrame, path: str) -> None:
    """UTF-8 text files, a document's pages parted by an empty line; documents in order within a file."""
    whole = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    whole.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("value")).write.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, data and the kind told by the first bytes (pdf, jpg, png, else null)."""
    from leafspark.functions.text import base_name, magic_kind

    files = spark.read.format("binaryFile").load(path)
    return files.select(base_name(F.col("path")).alias("name"), F.col("content").alias("data"), magic_kind(F.col("content")).alias("kind"))
