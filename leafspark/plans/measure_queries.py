"""Queries of page measures, page choice, names and kinds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import geometry as G
from leafspark.functions import text as T
from leafspark.operators import layout as L
from leafspark.operators import pages as P
from leafspark.sources.tables import PAGES_SQL, RUNS_SQL, doc_pages, doc_runs, literal, literal_sql, table

VIEWS = (
    "(0,0.0,0.0,612.0,792.0,0.0,0.0,612.0,792.0),(1,50.0,40.0,900.0,700.0,0.0,0.0,612.0,792.0),(2,612.0,792.0,100.0,80.0,612.0,0.0,0.0,792.0),(3,700.0,0.0,800.0,10.0,0.0,0.0,612.0,792.0)",
    "id int, cx0 double, cy0 double, cx1 double, cy1 double, mx0 double, my0 double, mx1 double, my1 double",
    "SELECT 1000 + p_partkey, p_size, 10, p_partkey % 700, p_partkey % 900, 0, 0, 612, 792 FROM {part}",
)
ANGLES = ("(0,0.0),(1,2.4),(2,-3.0),(3,357.6),(4,92.5),(5,-90.0),(6,45.0),(7,45.5)", "id int, angle double",
    "SELECT 1000 + p_partkey, p_partkey * 37 % 1441 - 720 + 0.25 FROM {part}",
)
LINE_PAIRS = ("(0,'a hyphen- ',' ated'),(1,'plain','text'),(2,'中','text'),(3,'text','文'),(4,'  ','x'),(5,'x','')", "id int, a string, b string",
    "SELECT 1000 + p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '- ' ELSE ' ' END, ' ' || p_brand FROM {part}",
)
FAILURES = ("(0,'[too-large] The file is too large'),(1,'no code'),(2,'[x_1] y'),(3,'[UP] y')", "id int, message string",
    "SELECT 1000 + p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[timeout] ' WHEN 1 THEN '[quota_exceeded] ' WHEN 2 THEN '[other] ' ELSE '' END || p_name FROM {part}",
)
HEADS = ("(0,'255044462D312E37'),(1,'FFD8FFE0'),(2,'89504E470D0A1A0A00'),(3,'00112233'),(4,'')", "id int, head string",
    "SELECT 1000 + doc_id, hex(substr(text, 1, 8)) FROM {documents}",
)


def extract_pages(s, d):
    """Of each document the pages that a table of wanted numbers names; numbers it has no page for give nothing."""
    pages = doc_pages(table(s, d, "documents"))
    wanted = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"))
    return P.extract_pages(pages, wanted).select("doc_id", "page_index")


def visible_boxes(s, d):
    crop, media = (tuple(F.col(k + c) for c in ("x0", "y0", "x1", "y1")) for k in "cm")
    return literal(s, d, *VIEWS).select("id", *(x.alias(n) for x, n in zip(G.visible_box(crop, media), ("x0", "y0", "x1", "y1"), strict=True)))


def rotation_buckets(s, d):
    return literal(s, d, *ANGLES).select("id", G.rotation_bucket(F.col("angle")).alias("bucket"), G.is_override(F.col("angle")).alias("valid"))


def line_separators(s, d):
    return literal(s, d, *LINE_PAIRS).select("id", L.separator(F.col("a"), F.col("b")).alias("separator"))


def weighted_means(s, d):
    """Discounts by supplier, weighted by quantity."""
    return L.weighted_mean(table(s, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")


def weighted_body_sizes(s, d):
    """Pages of which odd lines are of another size."""
    runs = doc_runs(table(s, d, "documents")).withColumn("font_size", F.col("font_size") + F.col("run_no") % 2)
    return L.weighted_body_size(runs.withColumnRenamed("run_no", "line_no"))


def page_file_names(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("total"))
    name = T.page_file_name(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")), F.col("l_linenumber") - 1, F.col("total"), "png")
    return rows.select("l_orderkey", "l_linenumber", name.alias("name"))


def failure_codes(s, d):
    code, message = T.failure(F.col("message"))
    return literal(s, d, *FAILURES).select("id", code.alias("code"), message.alias("message"))


def file_kinds(s, d):
    return literal(s, d, *HEADS).select("id", T.magic_kind(F.unhex("head")).alias("kind"))


_V = ", ".join(f"least({k}{c}0, {k}{c}1) AS {k}{c}0, greatest({k}{c}0, {k}{c}1) AS {k}{c}1" for k in "cm" for c in "xy")
SQL = {
    "extract_pages": f"WITH {PAGES_SQL} SELECT doc_id, page_index FROM doc_pages WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND l_linenumber = page_index + 1)",
    "visible_boxes": f"""WITH n AS (SELECT id, {_V} FROM {literal_sql(*VIEWS)}), i AS (SELECT *, least(cx1, mx1) > greatest(cx0, mx0) AND least(cy1, my1) > greatest(cy0, my0) AS ok FROM n)
SELECT id, CASE WHEN ok THEN greatest(cx0, mx0) ELSE mx0 END AS x0, CASE WHEN ok THEN greatest(cy0, my0) ELSE my0 END AS y0, CASE WHEN ok THEN least(cx1, mx1) ELSE mx1 END AS x1, CASE WHEN ok THEN least(cy1, my1) ELSE my1 END AS y1 FROM i""",
    "rotation_buckets": f"SELECT id, (((floor(angle / 5 + 0.5) * 5)::INT % 360 + 360) % 360)::INT AS bucket, abs(angle) <= 45 AS valid FROM {literal_sql(*ANGLES)}",
    "line_separators": f"SELECT id, CASE WHEN rtrim(a) = '' OR ltrim(b) = '' OR rtrim(a) LIKE '%-' OR regexp_matches(rtrim(a), '[一-鿿]$') OR regexp_matches(ltrim(b), '^[一-鿿]') THEN '' ELSE ' ' END AS separator FROM {literal_sql(*LINE_PAIRS)}",
    "weighted_means": "SELECT l_suppkey, coalesce(sum(l_discount::DOUBLE * l_quantity::DOUBLE) / nullif(sum(l_quantity::DOUBLE), 0), 0) AS mean FROM lineitem GROUP BY 1",
    "weighted_body_sizes": f"""WITH {RUNS_SQL}, w AS (SELECT doc_id, page_index, 10.0::DOUBLE + run_no % 2 AS body_size, sum(length(text) * (10.0::DOUBLE + run_no % 2)) AS w, min(run_no) AS f FROM doc_runs GROUP BY 1, 2, 3)
SELECT doc_id, page_index, CASE WHEN w > 0 THEN body_size ELSE 10 END AS body_size FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY w DESC, f) = 1""",
    "page_file_names": "SELECT l_orderkey, l_linenumber, 'order-' || l_orderkey || '-' || lpad(l_linenumber::VARCHAR, greatest(length(l_quantity::BIGINT::VARCHAR), length(l_linenumber::VARCHAR))::INT, '0') || '.png' AS name FROM lineitem",
    "failure_codes": f"""WITH f AS (SELECT id, message, regexp_extract(message, '^\\[([a-z_]+)\\] ', 1) AS code FROM {literal_sql(*FAILURES)}), k AS (SELECT *, list_contains({list(T.FAILURE_CODES)}, code) AS known FROM f)
SELECT id, CASE WHEN known THEN code ELSE 'internal_error' END AS code, CASE WHEN known THEN substr(message, length(code) + 4) ELSE message END AS message FROM k""",
    "file_kinds": f"SELECT id, CASE WHEN head LIKE '255044462D%' THEN 'pdf' WHEN head LIKE 'FFD8FF%' THEN 'jpg' WHEN head LIKE '89504E470D0A1A0A%' THEN 'png' END AS kind FROM {literal_sql(*HEADS)}",
}
QUERIES = {name: globals()[name] for name in SQL}
