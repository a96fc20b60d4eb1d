"""Queries of rules, estimates, pixels and matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import text as T
from leafspark.operators import rules as R
from leafspark.plans.layout_queries import PIXELS
from leafspark.sources.tables import PAGES_SQL, doc_pages, literal, literal_sql, table

FIELDS = ("(0,'name','text',100.0,20.0,10.0),(1,'_bad','text',100.0,20.0,10.0),(2,'ok','text',10.0,20.0,3.0),(3,'box','checkbox',8.0,8.0,99.0),(4,'box','radio',7.0,8.0,10.0)", "id int, name string, kind string, width double, height double, size double",
    "SELECT 1000 + p_partkey, CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || p_name, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'radio' END, p_size, p_partkey % 30, p_partkey % 60 FROM {part}",
)
COLOURS = ("(0,'#fff'),(1,'#0A80ff'),(2,'red'),(3,'#12345'),(4,'#a1c')", "id int, colour string",
    "SELECT 1000 + p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || substr('0123456789abcdef', CAST(1 + p_size % 14 AS INT), 3) WHEN 1 THEN '#' || substr('0123456789ABCDEF', CAST(1 + p_partkey % 10 AS INT), 6) WHEN 2 THEN p_name ELSE '#12345' END FROM {part}",
)
OBJECTS = ("(1,0,0,false),(1,0,3,false),(1,1,3,false),(1,2,0,true),(1,3,0,false),(1,3,0,true)", "doc_id long, page_index int, render_mode int, image boolean",
    "SELECT 1000 + l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 3 ELSE 0 END, l_suppkey % 4 = 0 FROM {lineitem}",
)
ROLES = ("(0,'heading',14.0,10.0,false),(1,'heading',10.0,10.0,true),(2,'heading',10.0,10.0,false),(3,'caption',9.0,10.0,false),(4,'footer',9.0,10.0,false),(5,'body',10.0,10.0,false),(6,'list-item',10.0,10.0,false)", "id int, role string, size double, body double, bold boolean",
    "SELECT 1000 + p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'footnote' WHEN 3 THEN 'header' WHEN 4 THEN 'list-item' WHEN 5 THEN 'table-cell' ELSE 'body' END, 8 + p_size % 10, 10, p_size % 2 = 0 FROM {part}",
)
TRUTH = ("(1,0,0.0,0.0,100.0,10.0),(1,1,0.0,20.0,100.0,30.0),(1,2,0.0,40.0,10.0,50.0),(2,0,0.0,0.0,10.0,10.0)", "page int, id int, x0 double, y0 double, x1 double, y1 double",
    "SELECT 1000 + l_orderkey, l_partkey * 10 + l_linenumber, l_quantity, l_linenumber * 10, l_quantity + 60, l_linenumber * 10 + 10 FROM {lineitem}",
)
FOUND = ("(1,0,0.0,0.0,60.0,10.0),(1,1,60.0,0.0,100.0,10.0),(1,2,0.0,28.0,100.0,34.0),(2,0,9.0,9.0,20.0,20.0)", "page int, id int, x0 double, y0 double, x1 double, y1 double",
    "SELECT 1000 + l_orderkey, l_partkey * 10 + l_linenumber, l_quantity + 5, l_linenumber * 10 + l_partkey % 7, l_quantity + 65, l_linenumber * 10 + 10 + l_partkey % 7 FROM {lineitem}",
)
SEGMENTS = ("(0,11,0,5,0.0,30.0),(0,11,6,11,36.0,66.0),(1,3,0,3,10.0,10.0)", "line int, n_chars int, first int, last int, a0 double, a1 double")
CARETS = ("(0,0,-5.0),(1,0,12.0),(2,0,32.0),(3,0,35.0),(4,0,50.0),(5,0,99.0),(6,1,10.0)", "point int, line int, advance double",
    "SELECT 1000 + p_partkey, p_partkey % 2, p_partkey % 110 FROM {part}",
)
STEPS = ("(0,0,0.0),(0,1,0.01),(0,2,0.019),(0,3,0.025),(0,4,0.04),(0,5,0.5),(0,6,0.999),(0,7,1.0),(1,0,1.0),(1,1,1.0)", "job int, pos int, ratio double",
    "SELECT 1000 + o_custkey, o_orderkey, (o_orderkey % 101) / 100.0 FROM {orders}",
)
INDENTS = ("(0,0,10.0),(0,1,20.2),(0,2,12.0),(0,3,30.0),(0,4,20.0),(1,0,50.0),(1,1,53.0)", "column_index int, line_no int, indent double",
    "SELECT 1000 + o_custkey, o_orderkey, o_orderkey % 60 * 0.75 FROM {orders}",
)
NAMES = ("(0,0,'a.b'),(0,1,'a.b'),(0,2,'a.b_2'),(0,3,'a.b'),(1,0,'x')", "doc int, pos int, name string",
    "SELECT 1000 + floor(p_partkey / 40.0), p_partkey, p_brand || '.' || CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a_2' ELSE 'b' END FROM {part}",
)
META = ("(0,'  Title  '),(1,''),(2,'a'||chr(7)||'b'),(3,'   ')", "id int, value string",
    "SELECT 1000 + doc_id, '  ' || text FROM {documents}",
)
THEME = (18, 18, 24)


def job_estimates(s, d):
    pages = doc_pages(table(s, d, "documents"))
    sums = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    return sums.select("doc_id", R.timeout_ms(F.col("n")).alias("timeout_ms"), R.working_set(F.col("b"), F.col("n")).alias("working_set"), R.capacity(F.col("b") * 100_000, F.col("b") * 100_000, F.col("n") * 20).alias("verdict"))


def metadata_fields(s, d):
    return literal(s, d, *META).select("id", R.metadata_field(F.col("value")).alias("value"))


def field_rules(s, d):
    errors = R.field_errors(*(F.col(c) for c in ("name", "kind", "width", "height", "size")))
    return literal(s, d, *FIELDS).select("id", F.array_join(errors, ",").alias("errors"))


def hex_colours(s, d):
    return literal(s, d, *COLOURS).withColumn("c", R.hex_channels(F.col("colour"))).select("id", *(F.col("c")[k].alias(n) for k, n in enumerate("rgb")))


def ocr_routing(s, d):
    return doc_pages(table(s, d, "documents")).select("doc_id", "page_index", R.ocr_route(F.col("text")).alias("route"))


def text_layers(s, d):
    return R.layer_kind(literal(s, d, *OBJECTS))


def role_certainties(s, d):
    return literal(s, d, *ROLES).select("id", R.role_certainty(*(F.col(c) for c in ("role", "size", "body", "bold"))).alias("certainty"))


def theme_pixels(s, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    themed, flipped = R.themed(r, g, b, THEME), R.lightness_flipped(r, g, b)
    return literal(s, d, *PIXELS).select("id", *(c.alias(f"theme_{n}") for c, n in zip(themed, "rgb", strict=True)), *(c.alias(f"flip_{n}") for c, n in zip(flipped, "rgb", strict=True)))


def skew_angle(s, d):
    """Two drawn pages: lines of text at slopes of 0 and of about 3 degrees."""
    rows = s.range(0, 2 * 8 * 600).select((F.col("id") % 2).cast("int").alias("page"), F.floor(F.col("id") / 2 / 600).alias("k"), (F.floor(F.col("id") / 2) % 600).alias("x"))
    slope = F.tan(F.radians(F.col("page") * 3.0))
    ink = rows.select("page", "x", F.floor(20 + F.col("k") * 12 + F.col("x") * slope + 0.5).alias("y"), F.lit(255.0).alias("weight"))
    return R.skew_angles(ink, 600, 160)


def match_lines(s, d):
    return R.match_lines(literal(s, d, *TRUTH), literal(s, d, *FOUND))


def caret_offsets(s, d):
    return R.caret_offsets(literal(s, d, *CARETS), literal(s, d, *SEGMENTS))


def progress_shown(s, d):
    return R.reported(literal(s, d, *STEPS))


def list_levels(s, d):
    return R.list_levels(literal(s, d, *INDENTS), 10.0)


def field_renames(s, d):
    return R.field_renames(literal(s, d, *NAMES))


def usage_totals(s, d):
    """Estimated tokens of each conversation and role, absent texts counting nothing."""
    turns = table(s, d, "conversations")
    return turns.groupBy("conv_id", "role").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("text").alias("turns"))


_META = "nullif(left(trim(regexp_replace(value, '[\\x00-\\x1f\\x7f]', '', 'g')), 500), '')"
SQL = {
    "job_estimates": f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, count(*) AS n, sum(strlen(text))::BIGINT AS b FROM doc_pages GROUP BY 1)
SELECT doc_id, least(greatest(120000 + (n - 1) * 750, 15000), 900000) AS timeout_ms, b + n * 1500000 AS working_set, CASE WHEN b * 100000 > 104857600 THEN 'file' WHEN b * 100000 > 262144000 THEN 'total' WHEN n * 20 > 500 THEN 'pages' ELSE 'ok' END AS verdict FROM t""",
    "metadata_fields": f"SELECT id, {_META} AS value FROM {literal_sql(*META)}",
    "field_rules": f"""SELECT id, array_to_string(list_filter([CASE WHEN kind NOT IN ('text', 'checkbox') THEN 'type' END, CASE WHEN NOT regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9 ._-]*$') OR length(name) > 64 THEN 'name' END,
CASE WHEN width < CASE kind WHEN 'text' THEN 20 ELSE 8 END OR height < CASE kind WHEN 'text' THEN 10 ELSE 8 END THEN 'size' END, CASE WHEN kind = 'text' AND size NOT BETWEEN 4 AND 48 THEN 'font' END], lambda x: x IS NOT NULL), ',') AS errors FROM {literal_sql(*FIELDS)}""",
    "hex_colours": f"""WITH c AS (SELECT id, CASE WHEN regexp_matches(colour, '^#[0-9a-fA-F]{{3}}$') THEN colour[2] || colour[2] || colour[3] || colour[3] || colour[4] || colour[4] WHEN regexp_matches(colour, '^#[0-9a-fA-F]{{6}}$') THEN colour[2:7] ELSE '000000' END AS h FROM {literal_sql(*COLOURS)})
SELECT id, ('0x' || h[1:2])::INT AS r, ('0x' || h[3:4])::INT AS g, ('0x' || h[5:6])::INT AS b FROM c""",
    "ocr_routing": f"WITH {PAGES_SQL} SELECT doc_id, page_index, CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) >= 16 THEN 'copy' ELSE 'recognise' END AS route FROM doc_pages",
    "text_layers": f"""WITH t AS (SELECT doc_id, page_index, count(*) FILTER (NOT image) AS n, count(*) FILTER (NOT image AND render_mode = 3) AS h, count(*) FILTER (image) AS i FROM {literal_sql(*OBJECTS)} GROUP BY 1, 2)
SELECT doc_id, page_index, CASE WHEN n = 0 THEN 'none' WHEN h = n THEN 'ocr' WHEN h > 0 THEN 'mixed' ELSE 'native' END AS layer, i > 0 AND n = 0 AS scan FROM t""",
    "role_certainties": f"SELECT id, CASE WHEN role = 'heading' THEN CASE WHEN size / body >= 1.16 THEN 0.95 WHEN bold THEN 0.85 ELSE 0.7 END WHEN role = 'caption' THEN 0.78 WHEN role = 'footnote' THEN 0.75 WHEN role IN ('header', 'footer') THEN 0.88 WHEN role = 'list-item' THEN 0.9 WHEN role = 'table-cell' THEN 0.72 ELSE 0.8 END::DOUBLE AS certainty FROM {literal_sql(*ROLES)}",
    # The flip, written out by hue, saturation and lightness.
    "theme_pixels": f"""WITH p AS (SELECT *, 1 - (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 AS f, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn FROM {literal_sql(*PIXELS)}),
q AS (SELECT *, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0 WHEN mx + mn > 1 THEN (mx - mn) / (2 - mx - mn) ELSE (mx - mn) / (mx + mn) END AS s FROM p),
c AS (SELECT *, (1 - abs(2 * (1 - l) - 1)) * s AS c FROM q)
SELECT id, floor(18 + 237 * f + 0.5)::INT AS theme_r, floor(18 + 237 * f + 0.5)::INT AS theme_g, floor(24 + 231 * f + 0.5)::INT AS theme_b,
{", ".join(f"floor((CASE WHEN mx = mn THEN 0 ELSE ({x} / 255.0::DOUBLE - mn) / (mx - mn) * c END + 1 - l - c / 2) * 255 + 0.5)::INT AS flip_{x}" for x in "rgb")} FROM c""",
    "skew_angle": "SELECT page::INT AS page, deg::DOUBLE AS deg FROM (VALUES (0, 0.0), (1, 3.0)) AS t(page, deg)",
    "match_lines": f"""WITH j AS (SELECT t.page, t.id, f.id AS fid, greatest(1, (t.x1 - t.x0) * (t.y1 - t.y0)) AS area, greatest(least(t.x1, f.x1) - greatest(t.x0, f.x0), 0) * greatest(least(t.y1, f.y1) - greatest(t.y0, f.y0), 0) AS shared FROM {literal_sql(*TRUTH)} t JOIN {literal_sql(*FOUND)} f USING (page)),
s AS (SELECT page, id, first(fid ORDER BY shared DESC, fid) AS best, max(shared) / max(area) AS part, least(1.0::DOUBLE, sum(shared) / max(area)) AS covered FROM j WHERE shared > 0 GROUP BY 1, 2)
SELECT page, id, CASE WHEN part >= 0.25 THEN best END AS best, covered FROM s""",
    "caret_offsets": f"""WITH p AS (SELECT * FROM {literal_sql(*CARETS)}), s AS (SELECT *, min(a0) OVER (PARTITION BY line) AS lo, max(a1) OVER (PARTITION BY line) AS hi FROM {literal_sql(*SEGMENTS)}),
n AS (SELECT p.*, s.* EXCLUDE (line), row_number() OVER (PARTITION BY point ORDER BY greatest(a0 - advance, advance - a1, 0), a0) AS k FROM p JOIN s USING (line))
SELECT point, (CASE WHEN advance <= lo THEN 0 WHEN advance >= hi THEN n_chars ELSE "first" + floor(CASE WHEN a1 > a0 THEN least(greatest((advance - a0) / (a1 - a0), 0), 1) ELSE 0 END * ("last" - "first") + 0.5) END)::INT AS "offset" FROM n WHERE k = 1""",
    "progress_shown": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS i FROM {literal_sql(*STEPS)}),
r AS (
  SELECT job, pos, ratio, i, ratio AS last_, true AS shown FROM o WHERE i = 1
  UNION ALL SELECT job, pos, ratio, i, CASE WHEN skip THEN last_ ELSE ratio END, NOT skip FROM (
    SELECT o.*, r.last_, abs(o.ratio - r.last_) < 0.02 AND o.ratio < 1 AS skip FROM r JOIN o ON o.job = r.job AND o.i = r.i + 1))
SELECT job, pos, ratio FROM r WHERE shown""",
    "list_levels": f"""WITH i AS (SELECT * FROM {literal_sql(*INDENTS)}), t AS (SELECT column_index, list_sort(list_distinct(list(floor(indent * 2 + 0.5) / 2))) AS stops FROM i GROUP BY 1),
c AS (SELECT column_index, list_reduce(list_transform(stops, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 6 THEN list_concat(a, x) ELSE a END) AS c FROM t)
SELECT column_index, line_no, least(greatest(len(list_filter(c, lambda x: indent + 1 >= x)), 1), 6)::INT AS level FROM i JOIN c USING (column_index)""",
    "field_renames": f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM {literal_sql(*NAMES)}),
s AS (
  SELECT doc, pos, name, i, name AS renamed, [name] AS used FROM n WHERE i = 1
  UNION ALL SELECT doc, pos, name, i, renamed, list_append(used, renamed) FROM (
    SELECT n.*, s.used, CASE WHEN NOT list_contains(s.used, n.name) THEN n.name ELSE list_filter(list_transform(range(2, len(s.used) + 3), lambda k: n.name || '_' || k), lambda c: NOT list_contains(s.used, c))[1] END AS renamed
    FROM s JOIN n ON n.doc = s.doc AND n.i = s.i + 1))
SELECT doc, pos, name, renamed FROM s""",
    "usage_totals": "SELECT conv_id, role, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, count(text) AS turns FROM conversations GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in SQL}
