"""Queries of the page algebra and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import geometry as G
from leafspark.functions import text as T
from leafspark.operators import pages as P
from leafspark.sources.tables import PAGES_SQL, doc_pages, literal, literal_sql, table

#: Literal relations, the same for the query and its SQL.
REFS = ("(0,1,1,0),(1,1,3,90),(2,1,1,180),(3,7,2,0),(4,7,1,270),(5,1,99,0),(6,2,1,0)", "out_pos int, doc_index long, page_index int, rotate int",
    "SELECT 1000 + o_orderkey, o_orderkey, 1 + o_orderkey % 4, 90 * (o_orderkey % 4) FROM {orders}",
)
RANGES = ("('5',10),('8-',10),('-3',10),('9-2',10),('99-200',10),('-',4),('1,1;2',10),(' 2 - 4 ,7',10)", "spec string, page_count int",
    "SELECT CAST(o_orderkey % 7 AS STRING) || '-' || CAST(o_orderkey % 23 AS STRING) || ', ' || CAST(o_custkey % 40 AS STRING), CAST(1 + o_custkey % 50 AS INT) FROM {orders}",
)
OUTLINE = (
    "(1,0,'Book',0,0),(1,1,'One',2,1),(1,2,'Also one',2,1),(1,3,'Two',5,1),(1,4,'Deep',6,2),(2,0,'A',0,0),(2,1,'B',3,0),(3,0,'Only',4,0),(4,0,'X',1,0),(4,1,'Y',1,0),(4,2,'Z',9,0)",
    "doc_id long, seq int, title string, page_index int, level int",
    "SELECT 1000 + o_custkey, o_orderkey, o_orderpriority || CAST(o_orderkey AS STRING), o_orderkey % 9, o_orderkey % 3 FROM {orders}",
)
BAD_OUTLINE = ("(1,0,0),(1,1,1),(1,2,2),(1,3,0),(2,0,1),(2,1,0),(3,0,0),(3,1,2),(3,2,3),(4,0,0),(4,1,0)", "doc_id long, seq int, level int",
    "SELECT 1000 + o_custkey, o_orderkey, (o_orderkey % 7) % 4 FROM {orders}",
)
COUNTS = ("(1,8),(2,5),(3,6),(4,9)", "doc_id long, page_count int",
    "SELECT 1000 + c_custkey, 3 + c_custkey % 9 FROM {customer}",
)
SIZES = ("(0,612.0,792.0),(1,595.28,841.89),(2,300.0,900.0),(3,1000.0,200.0),(4,842.0,595.0)", "id int, width double, height double",
    "SELECT 1000 + p_partkey, 100 + p_size * 13, 50 + p_partkey % 700 FROM {part}",
)
BOXES = ("(0,0.0,0.0,612.0,792.0,0),(1,0.0,0.0,612.0,792.0,90),(2,50.0,40.0,550.0,740.0,180),(3,50.0,40.0,550.0,740.0,270)", "id int, x0 double, y0 double, x1 double, y1 double, rot int",
    "SELECT 1000 + p_partkey, p_size, p_partkey % 90, p_size + 100 + p_partkey % 400, p_partkey % 90 + 50 + p_partkey % 600, 90 * (p_partkey % 4) FROM {part}",
)
MARKS = ("(0,612.0,792.0,120.0,40.0),(1,200.0,100.0,300.0,200.0),(2,842.0,595.0,30.0,20.0)", "id int, view_w double, view_h double, mark_w double, mark_h double",
    "SELECT 1000 + p_partkey, 200 + p_size * 10, 300 + p_partkey % 500, 10 + p_partkey % 150, 10 + p_size FROM {part}",
)
NAMES = ("(0,0,'a.pdf'),(0,1,'a-2.pdf'),(0,2,'a.pdf'),(1,0,'a'),(1,1,'a'),(1,2,'a-2'),(2,0,'A.txt'),(2,1,'a.txt'),(2,2,'.x'),(2,3,'.x')", "bundle int, pos int, name string",
    "SELECT 1000 + floor(p_partkey / 40.0), p_partkey, p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '.txt' ELSE '-2.txt' END FROM {part}",
)
TURNS = ("(0,-45.0),(1,-46.0),(2,44.0),(3,45.0),(4,359.0),(5,720.0),(6,-90.0),(7,134.9)", "id int, degrees double",
    "SELECT 1000 + p_partkey, p_partkey * 37 % 1441 - 720 + 0.5 FROM {part}",
)

NEEDLE = "the"


def _pages(s, d):
    """Order lines as pages of orders."""
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_index"), F.col("l_linenumber").alias("page_index"), "l_partkey")


_LINE = "lineitem_pages AS (SELECT l_orderkey AS doc_index, l_linenumber AS page_index, l_partkey FROM lineitem)"


def merge_pages(s, d):
    return P.numbered(_pages(s, d), "doc_index", "page_index", "out_pos").select("out_pos", "doc_index", "page_index")


def select_pages(s, d):
    return P.select_pages(literal(s, d, *REFS), _pages(s, d)).select("out_pos", "doc_index", "page_index", "rotate", "l_partkey")


def missing_pages(s, d):
    return P.missing_pages(literal(s, d, *REFS), _pages(s, d)).select("out_pos", "doc_index", "page_index")


def delete_pages(s, d):
    pages = _pages(s, d)
    return P.delete_pages(pages, pages.filter("page_index % 2 = 0").select("doc_index", "page_index")).select("doc_index", "page_index")


def interleave_pages(s, d):
    """Each document of odd number in turn with the one before it, the odd one first."""
    pages = _pages(s, d).withColumn("pair", F.floor(F.col("doc_index") / 2))
    return P.interleave(pages, F.col("doc_index") % 2 == 1, ["pair"]).select("pair", "out_pos", "doc_index", "page_index")


def page_ranges(s, d):
    return P.page_ranges(literal(s, d, *RANGES))


def split_by_text(s, d):
    return P.split_by_text(doc_pages(table(s, d, "documents")), NEEDLE)


def split_by_pages(s, d):
    return P.split_by_pages(doc_pages(table(s, d, "documents")), 3)


def split_by_size_plan(s, d):
    sizes = table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.ceil(F.size(F.split("text", "\n")) / 4).cast("long").alias("n_pages"))
    return P.split_by_size(sizes.filter("n_bytes > 0"), 2000)


def page_list(s, d):
    """Pages and characters of each document."""
    pages = doc_pages(table(s, d, "documents"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest_page"))


def pdf_to_text(s, d):
    """The text sink's content: pages joined by an empty line, and its length."""
    pages = doc_pages(table(s, d, "documents"))
    whole = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return whole.select("doc_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"))


def split_level(s, d):
    return P.split_level(literal(s, d, *OUTLINE))


def bookmark_segments(s, d):
    return P.bookmark_segments(literal(s, d, *OUTLINE), literal(s, d, *COUNTS))


def outline_errors(s, d):
    return P.outline_errors(literal(s, d, *BAD_OUTLINE)).select("doc_id", "seq", "level")


def bates_numbers(s, d):
    rows = P.numbered(_pages(s, d), "doc_index", "page_index", "i")
    return rows.select("doc_index", "page_index", T.bates_number(F.lit("ACME-"), F.lit(998), F.col("i"), F.lit(5)).alias("bates"))


def nup_slots(s, d):
    pages = literal(s, d, *SIZES).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("page_index"), "width", "height")
    return P.n_up(pages, 4, G.A4)


def half_boxes(s, d):
    """Both halves of each page, cut across the longer side of its display, in the page's frame."""
    boxes = literal(s, d, *BOXES)
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = G.display_size(box, F.col("rot"))
    out = boxes.withColumn("w", w).withColumn("h", h).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    tall = F.col("h") > F.col("w")
    left = F.when(tall, F.lit(0.0)).otherwise(F.col("w") / 2 * F.col("half"))
    top = F.when(tall, F.col("h") / 2 * F.col("half")).otherwise(F.lit(0.0))
    right = F.when(tall, F.col("w")).otherwise(F.col("w") / 2 * (F.col("half") + 1))
    bottom = F.when(tall, F.col("h") / 2 * (F.col("half") + 1)).otherwise(F.col("h"))
    ax, ay = G.to_page(left, top, box, F.col("rot"))
    bx, by = G.to_page(right, bottom, box, F.col("rot"))
    return out.select("id", "half", F.least(ax, bx).alias("hx0"), F.least(ay, by).alias("hy0"), F.greatest(ax, bx).alias("hx1"), F.greatest(ay, by).alias("hy1"))


def resize_plan(s, d):
    sizes = literal(s, d, *SIZES)
    scale = G.fit(F.col("width"), F.col("height"), F.lit(G.LETTER[0]), F.lit(G.LETTER[1]))
    return sizes.select("id", scale.alias("scale"), ((F.lit(G.LETTER[0]) - F.col("width") * scale) / 2).alias("dx"), ((F.lit(G.LETTER[1]) - F.col("height") * scale) / 2).alias("dy"))


def image_placement(s, d):
    """A picture on an A4 page that lies down when the picture does, within a margin of 24."""
    sizes = literal(s, d, *SIZES)
    flat = F.col("width") > F.col("height")
    pw, ph = F.when(flat, F.lit(G.A4[1])).otherwise(F.lit(G.A4[0])), F.when(flat, F.lit(G.A4[0])).otherwise(F.lit(G.A4[1]))
    scale = G.fit(F.col("width"), F.col("height"), pw - 48, ph - 48)
    return sizes.select("id", pw.alias("page_w"), ph.alias("page_h"), (F.col("width") * scale).alias("w"), (F.col("height") * scale).alias("h"), ((pw - F.col("width") * scale) / 2).alias("x"), ((ph - F.col("height") * scale) / 2).alias("y"))


def quarter_turns(s, d):
    return literal(s, d, *TURNS).select("id", G.quarter_turns(F.col("degrees")).alias("rotate"))


def merge_dates(s, d):
    """Of each customer's orders as one merged document: earliest and latest date, the first order's status."""
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("modified"), F.min_by("o_orderstatus", "o_orderkey").alias("status"))


def tile_grid(s, d):
    return P.tile_grid(literal(s, d, *MARKS))


def dedupe_names(s, d):
    return P.dedupe_names(literal(s, d, *NAMES))


_HALF = "CASE WHEN h > w THEN {tall} ELSE {flat} END"
SQL = {
    "merge_pages": f"WITH {_LINE} SELECT row_number() OVER (ORDER BY doc_index, page_index) - 1 AS out_pos, doc_index, page_index FROM lineitem_pages",
    "select_pages": f"WITH {_LINE} SELECT r.out_pos, r.doc_index, r.page_index, r.rotate, p.l_partkey FROM {literal_sql(*REFS)} r JOIN lineitem_pages p USING (doc_index, page_index)",
    "missing_pages": f"WITH {_LINE} SELECT out_pos, doc_index, page_index FROM {literal_sql(*REFS)} r WHERE NOT EXISTS (SELECT 1 FROM lineitem_pages p WHERE p.doc_index = r.doc_index AND p.page_index = r.page_index)",
    "delete_pages": f"WITH {_LINE} SELECT doc_index, page_index FROM lineitem_pages WHERE page_index % 2 <> 0",
    "interleave_pages": f"WITH {_LINE} SELECT doc_index // 2 AS pair, row_number() OVER (PARTITION BY doc_index // 2 ORDER BY page_index, 1 - doc_index % 2) - 1 AS out_pos, doc_index, page_index FROM lineitem_pages",
    "page_ranges": f"""WITH p AS (SELECT spec, page_count, trim(unnest(regexp_split_to_array(spec, '[,;\\n]'))) AS part FROM {literal_sql(*RANGES)}),
q AS (SELECT spec, page_count, part LIKE '%-%' AS dash, try_cast(nullif(trim(split_part(part, '-', 1)), '') AS INT) AS a, try_cast(nullif(trim(split_part(part, '-', 2)), '') AS INT) AS b FROM p WHERE part <> ''),
r AS (SELECT spec, page_count, least(greatest(coalesce(a, 1), 1), page_count) AS lo, least(greatest(CASE WHEN dash THEN coalesce(b, page_count) ELSE a END, 1), page_count) AS hi FROM q)
SELECT DISTINCT spec, page_count, (unnest(range(least(lo, hi), greatest(lo, hi) + 1)) - 1)::INT AS page_index FROM r""",
    "split_by_text": f"""WITH {PAGES_SQL}, m AS (SELECT doc_id, page_index, sum(CASE WHEN page_index > 0 AND contains(lower(text), '{NEEDLE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_index) AS part FROM doc_pages),
g AS (SELECT doc_id, part, min(page_index) AS first_page, max(page_index) AS last_page, count(*) AS n_pages FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_parts FROM g) WHERE n_parts > 1""",
    "split_by_pages": f"WITH {PAGES_SQL} SELECT doc_id, (page_index // 3)::INT AS part, min(page_index) AS first_page, max(page_index) AS last_page, count(*) AS n_pages FROM doc_pages GROUP BY 1, 2",
    "split_by_size_plan": """WITH t AS (SELECT doc_id, strlen(text) AS n_bytes, ceil(len(string_split(text, chr(10))) / 4.0)::BIGINT AS n_pages FROM documents),
u AS (SELECT *, ceil(n_bytes / n_pages)::BIGINT AS bytes_per_page FROM t WHERE n_bytes > 0),
v AS (SELECT *, least(greatest(floor(2000 / bytes_per_page), 1), n_pages)::BIGINT AS pages_per_part FROM u)
SELECT *, ceil(n_pages / pages_per_part)::BIGINT AS parts FROM v""",
    "page_list": f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS page_count, sum(length(text))::BIGINT AS chars, max(length(text))::INT AS longest_page FROM doc_pages GROUP BY doc_id",
    "pdf_to_text": f"WITH {PAGES_SQL}, w AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS t FROM doc_pages GROUP BY doc_id) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM w",
    "split_level": f"WITH l AS (SELECT doc_id, level, count(*) AS n FROM {literal_sql(*OUTLINE)} GROUP BY 1, 2) SELECT doc_id, coalesce(min(level) FILTER (n > 1), max(level)) AS level FROM l GROUP BY doc_id",
    "bookmark_segments": f"""WITH o AS (SELECT * FROM {literal_sql(*OUTLINE)}), l AS (SELECT doc_id, level, count(*) AS n FROM o GROUP BY 1, 2),
s AS (SELECT doc_id, coalesce(min(level) FILTER (n > 1), max(level)) AS level FROM l GROUP BY doc_id),
e AS (SELECT o.doc_id, title, page_index FROM o JOIN s USING (doc_id, level) QUALIFY row_number() OVER (PARTITION BY o.doc_id, page_index ORDER BY seq) = 1),
f AS (SELECT * FROM e UNION ALL SELECT doc_id, 'Front matter', 0 FROM e GROUP BY doc_id HAVING min(page_index) > 0)
SELECT doc_id, title, page_index AS first_page, coalesce(lead(page_index) OVER (PARTITION BY doc_id ORDER BY page_index) - 1, page_count - 1) AS last_page
FROM f JOIN {literal_sql(*COUNTS)} c USING (doc_id) WHERE page_index < page_count""",
    "outline_errors": f"SELECT doc_id, seq, level FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM {literal_sql(*BAD_OUTLINE)}) WHERE (b IS NULL AND level <> 0) OR level > b + 1",
    "bates_numbers": f"WITH {_LINE}, n AS (SELECT *, 998 + row_number() OVER (ORDER BY doc_index, page_index) - 1 AS i FROM lineitem_pages) SELECT doc_index, page_index, 'ACME-' || repeat('0', greatest(5 - length(i::VARCHAR), 0)) || i AS bates FROM n",
    "nup_slots": f"""WITH t AS (SELECT *, least({G.A4[0]}::DOUBLE / 2 / width, {G.A4[1]}::DOUBLE / 2 / height) AS scale FROM {literal_sql(*SIZES)})
SELECT 1::BIGINT AS doc_id, id AS page_index, (id // 4)::INT AS sheet, id % 4 AS cell, scale, (id % 4 % 2) * ({G.A4[0]}::DOUBLE / 2) + ({G.A4[0]}::DOUBLE / 2 - width * scale) / 2 AS x,
{G.A4[1]}::DOUBLE - (id % 4 // 2 + 1) * ({G.A4[1]}::DOUBLE / 2) + ({G.A4[1]}::DOUBLE / 2 - height * scale) / 2 AS y FROM t""",
    "half_boxes": f"""WITH b AS (SELECT *, CASE WHEN rot IN (90, 270) THEN y1 - y0 ELSE x1 - x0 END AS w, CASE WHEN rot IN (90, 270) THEN x1 - x0 ELSE y1 - y0 END AS h FROM {literal_sql(*BOXES)}),
c AS (SELECT *, unnest([0, 1]) AS half FROM b),
v AS (SELECT *, CASE WHEN h > w THEN 0 ELSE w / 2 * half END AS l, CASE WHEN h > w THEN h / 2 * half ELSE 0 END AS t, CASE WHEN h > w THEN w ELSE w / 2 * (half + 1) END AS r, CASE WHEN h > w THEN h / 2 * (half + 1) ELSE h END AS m FROM c),
p AS (SELECT id, half,
 CASE rot WHEN 90 THEN x0 + t WHEN 180 THEN x1 - l WHEN 270 THEN x1 - t ELSE x0 + l END AS ax, CASE rot WHEN 90 THEN y0 + l WHEN 180 THEN y0 + t WHEN 270 THEN y1 - l ELSE y1 - t END AS ay,
 CASE rot WHEN 90 THEN x0 + m WHEN 180 THEN x1 - r WHEN 270 THEN x1 - m ELSE x0 + r END AS bx, CASE rot WHEN 90 THEN y0 + r WHEN 180 THEN y0 + m WHEN 270 THEN y1 - r ELSE y1 - m END AS by_ FROM v)
SELECT id, half, least(ax, bx) AS hx0, least(ay, by_) AS hy0, greatest(ax, bx) AS hx1, greatest(ay, by_) AS hy1 FROM p""",
    "resize_plan": f"WITH t AS (SELECT *, least(612.0::DOUBLE / width, 792.0::DOUBLE / height) AS scale FROM {literal_sql(*SIZES)}) SELECT id, scale, (612.0::DOUBLE - width * scale) / 2 AS dx, (792.0::DOUBLE - height * scale) / 2 AS dy FROM t",
    "image_placement": f"""WITH t AS (SELECT *, CASE WHEN width > height THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS page_w, CASE WHEN width > height THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS page_h FROM {literal_sql(*SIZES)}),
u AS (SELECT *, least((page_w - 48) / width, (page_h - 48) / height) AS s FROM t)
SELECT id, page_w, page_h, width * s AS w, height * s AS h, (page_w - width * s) / 2 AS x, (page_h - height * s) / 2 AS y FROM u""",
    "quarter_turns": f"SELECT id, (((floor(degrees / 90 + 0.5) * 90)::INT % 360 + 360) % 360)::INT AS rotate FROM {literal_sql(*TURNS)}",
    "merge_dates": "SELECT o_custkey, min(o_orderdate) AS created, max(o_orderdate) AS modified, min_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey",
    "tile_grid": f"""WITH g AS (SELECT *, greatest(ceil(view_w / greatest(mark_w * 1.35::DOUBLE, 96)), 1)::INT AS nx, greatest(ceil(view_h / greatest(mark_h * 1.35::DOUBLE, 72)), 1)::INT AS ny FROM {literal_sql(*MARKS)}),
h AS (SELECT *, unnest(range(nx))::INT AS "column" FROM g), i AS (SELECT *, unnest(range(ny))::INT AS "row" FROM h)
SELECT id, "column", "row", view_w * ("column" + 0.5::DOUBLE) / nx AS cx, view_h * ("row" + 0.5::DOUBLE) / ny AS cy FROM i""",
    "dedupe_names": f"""WITH RECURSIVE n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY pos) AS i, CASE WHEN strpos(reverse(name), '.') BETWEEN 1 AND length(name) - 1 THEN length(name) - strpos(reverse(name), '.') ELSE length(name) END AS stem FROM {literal_sql(*NAMES)}),
s AS (
  SELECT bundle, pos, name, i, name AS entry, [name] AS given FROM n WHERE i = 1
  UNION ALL SELECT bundle, pos, name, i, entry, list_append(given, entry) FROM (
    SELECT n.bundle, n.pos, n.name, n.i, s.given, CASE WHEN NOT list_contains(s.given, n.name) THEN n.name ELSE
      list_filter(list_transform(range(2, len(s.given) + 3), lambda k: left(n.name, n.stem) || '-' || k || substr(n.name, n.stem + 1)), lambda c: NOT list_contains(s.given, c))[1] END AS entry
    FROM s JOIN n ON n.bundle = s.bundle AND n.i = s.i + 1))
SELECT bundle, pos, name, entry FROM s""",
}
QUERIES = {name: globals()[name] for name in SQL}
