"""Queries of layout, boxes, conversations, quotas and recipes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import geometry as G
from leafspark.operators import boxes as B
from leafspark.operators import budget
from leafspark.operators import conversations as V
from leafspark.operators import layout as L
from leafspark.operators import quota as Q
from leafspark.plans import recipes
from leafspark.sources.tables import PAGES_SQL, RUNS_SQL, doc_pages, doc_runs, literal, literal_sql, table

RUNS = (
    "(1,0,'Intro',18.0,72.0,80.0,false),(1,0,'body a',10.0,72.0,100.0,false),(1,0,'Running head',9.0,72.0,20.0,false),(1,0,'3',9.0,300.0,780.0,false),(1,1,'Running head',9.0,72.0,20.0,false),(1,1,'Bold line',10.0,72.0,60.0,true),(1,1,'body b',10.0,72.0,90.0,false),"
    "(1,2,'Running head',9.0,72.0,20.0,false),(1,2,'Bold line',10.0,72.0,60.0,true),(1,2,'body c',10.0,72.0,90.0,false),(1,3,'Running head',9.0,72.0,20.0,false),(1,3,'body d',10.0,72.0,90.0,false),(2,0,'only body',10.0,72.0,70.0,false),(2,0,'more body',10.0,72.0,90.0,false),(2,2,'third',10.2,72.0,70.0,false)",
    "doc_id long, page_index int, text string, font_size double, x double, y double, bold boolean",
)
SIZED_RUNS = (
    RUNS[0],
    RUNS[1],
    "SELECT 1000 + l_orderkey, l_linenumber, 'run ' || CAST(l_partkey AS STRING), 8 + l_suppkey % 5 * 0.5, 72, l_linenumber, false FROM {lineitem}",
)
RUN_PAGES = ("(1,0),(1,1),(1,2),(1,3),(2,0),(2,1),(2,2)", "doc_id long, page_index int")
PARAGRAPHS = (
    "(1,0,0,'body','Report 2024',9.0,'A',10.0,12.0,792.0,10.0),(1,0,1,'body','A sentence that runs on',10.0,'A',300.0,12.0,792.0,10.0),(1,0,2,'body','- 1 -',9.0,'A',770.0,12.0,792.0,10.0),(1,1,0,'body','Report 2025',9.0,'A',10.0,12.0,792.0,10.0),(1,1,1,'body','into the next page.',10.5,'A',300.0,12.0,792.0,10.0),(1,1,2,'body','- 2 -',9.0,'A',770.0,12.0,792.0,10.0),"
    "(1,2,0,'header','Report 2026',9.0,'A',10.0,12.0,792.0,10.0),(1,2,1,'body','New text; and',10.0,'B',300.0,12.0,792.0,10.0),(1,2,2,'body','Big',20.0,'A',5.0,12.0,792.0,10.0),(2,0,0,'body','Alone',9.0,'A',10.0,12.0,792.0,10.0)",
    "doc_id long, page_index int, para_id int, role string, text string, font_size double, font_family string, y double, height double, page_height double, median_size double",
    "SELECT 1000 + conv_id, turn, 0, 'body', 'Turn ' || CAST(turn AS STRING), 9, 'A', 10, 12, 792, 10 FROM {conversations} UNION ALL SELECT 1000 + conv_id, turn, 1, 'body', text, 10, 'A', 300, 12, 792, 10 FROM {conversations}",
)
BLOCKS = (
    "(1,0,1,'header',-1,10.0,10.0),(1,0,2,'body',0,50.0,100.0),(1,0,3,'body',1,300.0,90.0),(1,0,4,'body',-1,50.0,200.0),(1,0,5,'body',0,50.0,300.0),(1,0,6,'body',1,300.0,250.0),(1,0,7,'footer',0,50.0,700.0),(1,0,8,'body',-1,50.0,400.0),(1,0,9,'body',0,50.0,500.0),(1,1,1,'body',0,5.0,5.0),(1,1,2,'body',0,5.0,4.0)",
    "doc_id long, page_index int, block_id int, kind string, column_index int, x double, y double",
    "SELECT 1000 + o_custkey, 0, o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' ELSE 'body' END, o_orderkey % 4 - 1, o_orderkey % 300, o_orderkey * 7 % 700 FROM {orders}",
)
RECTS = ("(1,0,0.0,0.0,100.0,100.0),(1,1,50.0,50.0,150.0,150.0),(1,2,100.0,0.0,200.0,50.0),(1,3,60.0,60.0,70.0,70.0),(1,4,300.0,300.0,301.0,301.0),(2,0,0.0,0.0,10.0,10.0),(2,1,5.0,5.0,300.0,300.0)", "page int, id int, x0 double, y0 double, x1 double, y1 double",
    "SELECT 1000 + o_custkey, o_orderkey, o_orderkey % 300, o_orderkey % 70, o_orderkey % 300 + 40, o_orderkey % 70 + 30 FROM {orders}",
)
POINTS = ("(0,65.0,65.0),(1,10.0,10.0),(2,500.0,500.0),(3,302.0,305.0),(4,155.0,120.0),(5,205.0,20.0)", "point int, px double, py double",
    "SELECT 1000 + p_partkey, p_partkey % 220, p_size * 3 FROM {part}",
)
LINES = (
    "(1,0,0,72.0,500.0,100.0,10.0,'A',12.0,500.0),(1,0,1,72.0,498.0,112.0,10.0,'A',12.0,500.0),(1,0,2,72.0,300.0,124.0,10.0,'A',12.0,500.0),(1,0,3,90.0,500.0,148.0,10.0,'A',12.0,500.0),(1,0,4,150.0,420.0,160.0,14.0,'B',12.0,500.0),(1,1,0,72.0,500.0,100.0,10.0,'A',12.0,500.0)",
    "doc_id long, page_index int, line_no int, x0 double, x1 double, baseline double, font_size double, family string, pitch double, column_end double",
    "SELECT 1000 + o_custkey, 0, o_orderkey, 72 + o_orderkey % 3 * 10, 300 + o_orderkey % 5 * 50, 100 + o_orderkey * 12, 10 + o_orderkey % 2 * 2, 'A', 12, 500 FROM {orders}",
)
ALIGNED = (
    "(1,0,10.0,90.0,10.0,0.0,100.0),(1,1,20.0,80.0,10.0,0.0,100.0),(2,0,0.0,100.0,10.0,0.0,100.0),(2,1,0.0,99.0,10.0,0.0,100.0),(2,2,0.0,40.0,10.0,0.0,100.0),(3,0,60.0,100.0,10.0,0.0,100.0),(4,0,0.0,50.0,10.0,0.0,100.0),(4,1,0.0,60.0,10.0,0.0,100.0)",
    "para_id int, line_no int, x0 double, x1 double, font_size double, left_ double, right_ double",
    "SELECT 1000 + o_custkey, o_orderkey, o_orderkey % 4 * 10, 100 - o_orderkey % 3 * 10, 10, 0, 100 FROM {orders}",
)
GLYPHS = (
    "(1,0,0,'H',0.0,6.0,10.0),(1,0,1,'i',6.0,3.0,10.0),(1,0,2,' ',9.0,3.0,10.0),(1,0,3,'y',12.0,5.0,10.0),(1,0,4,'o',17.5,5.0,10.0),(1,0,5,'u',30.0,5.0,10.0),(1,1,0,' ',0.0,3.0,10.0),(1,1,1,'z',3.0,5.0,10.0)",
    "doc_id long, page_index int, glyph_no int, text string, x double, width double, font_size double",
)
ITEMS = (
    "(1,0,0,0,'Hel',0.0,100.0,15.0,10.0,10.0),(1,0,1,0,'lo',15.5,100.0,10.0,10.0,10.0),(1,0,2,0,'world',30.0,101.0,25.0,10.0,10.0),(1,0,3,0,'far',200.0,100.0,15.0,10.0,10.0),(1,0,4,1,'next',0.0,115.0,20.0,10.0,10.0),(1,0,5,1,'',20.0,115.0,0.0,10.0,10.0)",
    "doc_id long, page_index int, item_no int, line int, text string, x double, y double, width double, height double, font_size double",
)
PIXELS = ("(0,0,0,0),(1,255,255,255),(2,255,0,0),(3,12,200,99),(4,128,128,128),(5,0,0,255)", "id int, r int, g int, b int",
    "SELECT 1000 + p_partkey, p_partkey * 7 % 256, p_partkey * 13 % 256, p_size * 5 % 256 FROM {part}",
)
BOXES = ("(0,0.0,0.0,612.0,792.0,0),(1,0.0,0.0,612.0,792.0,90),(2,50.0,40.0,550.0,740.0,180),(3,50.0,40.0,550.0,740.0,270)", "id int, x0 double, y0 double, x1 double, y1 double, rot int",
    "SELECT 1000 + p_partkey, p_size, p_partkey % 90, p_size + 100 + p_partkey % 400, p_partkey % 90 + 50 + p_partkey % 600, 90 * (p_partkey % 4) FROM {part}",
)
SIZES = ("(0,612.0,792.0,2.0),(1,10000.0,100.0,1.0),(2,5000.0,5000.0,3.0),(3,100.0,100.0,0.5)", "id int, width double, height double, wanted double",
    "SELECT 1000 + p_partkey, 100 + p_size * 200, 50 + p_partkey % 5000, 0.5 + p_size % 4 FROM {part}",
)
CLIPS = ("(0,0.0,0.0,612.0,792.0,10.0,10.0,700.0,900.0),(1,0.0,0.0,612.0,792.0,-5.0,-5.0,100.0,100.0),(2,0.0,0.0,100.0,100.0,200.0,200.0,300.0,300.0)", "id int, mx0 double, my0 double, mx1 double, my1 double, cx0 double, cy0 double, cx1 double, cy1 double",
    "SELECT 1000 + p_partkey, 0, 0, 612, 792, p_size - 20, p_partkey % 900 - 40, p_size + 300, p_partkey % 900 + 60 FROM {part}",
)
RECIPES = (
    "(1,0,'a','merge','source',''),(1,1,'b','stamp','step','a'),(2,0,'a','merge','step','b'),(2,1,'b','stamp','source',''),(3,0,'a','inspect','source',''),(3,1,'b','stamp','step','a'),(4,0,'a','merge','source',''),(4,1,'a','stamp','source',''),(5,0,'a','nope','source',''),(5,1,'b','stamp','step','zz'),(6,0,'a','merge','step','a'),(7,0,'a','merge','else','')",
    "recipe_id int, pos int, step_id string, tool string, input_kind string, input_ref string",
    "SELECT 1000 + o_custkey, o_orderkey, 's' || CAST(o_orderkey % 5 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'stamp' WHEN 2 THEN 'inspect' ELSE 'nup' END, CASE o_orderkey % 3 WHEN 0 THEN 'source' ELSE 'step' END, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 's' || CAST(o_orderkey * 3 % 5 AS STRING) END FROM {orders}",
)
QUOTA_EVENTS = (
    "(1,1,0.0,10.0),(1,2,10.0,10.0),(1,3,20.0,10.0),(1,4,59.0,10.0),(1,5,60.0,10.0),(1,6,61.0,60.0),(1,7,200.0,40.0),(1,8,300.0,1.0),(1,9,400.0,1.0),(1,10,86400.0,5.0),(2,11,5.0,101.0),(2,12,6.0,99.0),(2,13,7.0,2.0)",
    "subject long, event_id long, t double, bytes double",
)
#: Of the literal events with 3 a minute, 6 a day and 100 bytes a day, worked by hand.
QUOTA_RESULT = (
    "(1,1,'ok',10.0),(1,2,'ok',20.0),(1,3,'ok',30.0),(1,4,'minute',4.0),(1,5,'ok',40.0),(1,6,'ok',100.0),(1,7,'bytes',140.0),(1,8,'day',7.0),(1,9,'day',8.0),(1,10,'ok',5.0),(2,11,'bytes',101.0),(2,12,'ok',99.0),(2,13,'bytes',101.0)",
    "subject long, event_id long, verdict string, used double",
)
ROLE_LINES = (
    "(0,'12',9.0,false,770.0),(1,'1 See the note below',8.0,false,700.0),(2,'Running head',9.0,false,10.0),(3,'Foot text',9.0,false,780.0),(4,'A Title',16.0,false,100.0),(5,'Bold label',10.0,true,200.0),(6,'SHOUTED LINE',10.0,false,200.0),(7,'- item text',10.0,false,300.0),(8,'Figure 3: A chart',10.0,false,400.0),(9,'Source: here',10.0,false,400.0),(10,'plain body text.',10.0,false,400.0),(11,'  ',10.0,false,400.0),(12,'Bold but a sentence.',10.0,true,400.0)",
    "id int, text string, font_size double, bold boolean, y double",
)
ROLE_RESULT = ("(0,'footer'),(1,'footnote'),(2,'header'),(3,'footer'),(4,'heading'),(5,'heading'),(6,'heading'),(7,'list-item'),(8,'caption'),(9,'caption'),(10,'body'),(11,'unknown'),(12,'body')", "id int, role string")
WORD_LISTS = ("(0,'Hello|,|world'),(1,'(|a|)|b'),(2,'中|文|x'),(3,'and|/|or'),(4,'one||two'),(5,'“|quoted|”|.')", "id int, words string",
    "SELECT 1000 + doc_id, replace(text, ' ', '|') FROM {documents}",
)
#: Whether two words of a line stand without a blank between them.
TIGHT_SQL = """regexp_matches({b}, '^[.,;:!?)\\]}}%''"”’]') OR regexp_matches({a}, '[(\\[{{''"“‘/\\-]$') OR regexp_matches({a}, '[\\x{{2e80}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{ac00}}-\\x{{d7af}}]$') OR regexp_matches({b}, '^[\\x{{2e80}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{ac00}}-\\x{{d7af}}]')"""
BUDGET = budget.Limits(per_minute=3, daily=900, anonymous=400, reserve=20)
PER_MINUTE, PER_DAY, BYTES_PER_DAY = 6, 150, 2000.0


def _box(prefix=""):
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def body_size_mode(s, d):
    return L.modal_size(L.cleaned_runs(literal(s, d, *SIZED_RUNS))).select("doc_id", "body_size")


def suggested_bookmarks(s, d):
    return L.suggest_bookmarks(literal(s, d, *RUNS), literal(s, d, *RUN_PAGES))


def first_line_bookmarks(s, d):
    """Every page's first line, of documents as runs of one size."""
    runs = doc_runs(table(s, d, "documents")).withColumn("bold", F.lit(False))
    # A page begins with a line.
    return L.suggest_bookmarks(runs, runs.filter("run_no = 0").select("doc_id", "page_index"))


def repeated_furniture(s, d):
    return L.repeated_furniture(literal(s, d, *PARAGRAPHS))


def cross_page_links(s, d):
    return L.cross_page_links(literal(s, d, *PARAGRAPHS).filter("y > 100 AND y < 700"))


def reading_order(s, d):
    return L.reading_order(literal(s, d, *BLOCKS))


def weighted_median(s, d):
    return L.weighted_median(table(s, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


def line_pitch_median(s, d):
    return L.line_pitch(doc_runs(table(s, d, "documents")))


def line_relations(s, d):
    return L.line_relations(literal(s, d, *LINES).withColumnRenamed("column_end", "end"))


def coverage_ratio(s, d):
    runs = doc_runs(table(s, d, "documents")).withColumn("page_w", F.lit(612.0)).withColumn("page_h", F.lit(792.0))
    return L.coverage(runs)


def paragraph_alignment(s, d):
    return L.paragraph_alignment(literal(s, d, *ALIGNED).withColumnsRenamed({"left_": "left", "right_": "right"}))


def glyph_words(s, d):
    return L.words(literal(s, d, *GLYPHS))


def cluster_runs(s, d):
    return L.cluster_runs(literal(s, d, *ITEMS))


def wrapped_text(s, d):
    """Wrapping keeps each text's words; longer lines than the width don't appear."""
    lines = L.wrap(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 40)
    return lines.groupBy("id").agg(F.max(F.length("line") <= 40).alias("fits"), F.sum(F.length(F.replace("line", F.lit(" "), F.lit("")))).alias("chars"))


def line_roles(s, d):
    lines = literal(s, d, *ROLE_LINES).withColumn("height", F.lit(12.0)).withColumn("body_size", F.lit(10.0)).withColumn("page_height", F.lit(792.0))
    return L.line_roles(lines).select("id", "role")


def column_bounds(s, d):
    """Lines of documents as columns by the remainder of their number."""
    runs = doc_runs(table(s, d, "documents")).withColumn("column_index", F.col("run_no") % 2)
    return L.column_bounds(runs.select("doc_id", "page_index", "column_index", F.lit("body").alias("role"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1")))


def joined_words(s, d):
    return literal(s, d, *WORD_LISTS).select("id", L.joined_words(F.split("words", "[|]")).alias("text"))


def role_counts(s, d):
    return L.role_counts(literal(s, d, *PARAGRAPHS))


def confidence_bands(s, d):
    rows = table(s, d, "events").select("event_id", (F.pmod("event_id", F.lit(100)) / 100).alias("c"))
    return rows.select("event_id", L.confidence_band(F.col("c")).alias("band"))


def box_overlap(s, d):
    return B.overlapping(literal(s, d, *RECTS), ["page"])


def hit_test(s, d):
    return B.hit_test(literal(s, d, *POINTS).withColumn("page", F.lit(1)), literal(s, d, *RECTS), ["page"]).drop("page")


def nearest_line(s, d):
    return B.nearest(literal(s, d, *POINTS).withColumn("page", F.lit(1)), literal(s, d, *RECTS), ["page"]).drop("page")


def frame_transform(s, d):
    px, py = G.to_page(F.lit(10.0), F.lit(20.0), _box(), F.col("rot"))
    out = literal(s, d, *BOXES).withColumn("px", px).withColumn("py", py)
    x, y = G.to_display(F.col("px"), F.col("py"), _box(), F.col("rot"))
    w, h = G.display_size(_box(), F.col("rot"))
    return out.select("id", "px", "py", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def crop_clamp(s, d):
    c = literal(s, d, *CLIPS)
    out = c.select("id", F.greatest("mx0", "cx0").alias("x0"), F.greatest("my0", "cy0").alias("y0"), F.least("mx1", "cx1").alias("x1"), F.least("my1", "cy1").alias("y1"))
    return out.withColumn("empty", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))


def render_budget(s, d):
    return literal(s, d, *SIZES).select("id", G.render_scale(F.col("width"), F.col("height"), F.col("wanted")).alias("scale"))


def luma_pixels(s, d):
    return literal(s, d, *PIXELS).select("id", G.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"), *((255 - F.col(c)).alias(f"inverse_{c}") for c in "rgb"))


def message_size(s, d):
    return V.message_sizes(table(s, d, "conversations"))


def compaction_cut(s, d):
    return V.compaction_cut(table(s, d, "conversations"), 600, 300)


def orphan_repair(s, d):
    return V.repaired(table(s, d, "conversations")).select("conv_id", "turn", "role")


def history_trim(s, d):
    return V.trimmed(table(s, d, "conversations"), 4)


def history_topk(s, d):
    return V.newest(table(s, d, "conversations"), 2).select("conv_id", "turn", "role")


def squashed_turns(s, d):
    return V.squashed(table(s, d, "conversations"), "assistant", 1, 50).select("conv_id", "turn", F.length("text").alias("chars"))


def read_budget(s, d):
    return V.within_budget(doc_pages(table(s, d, "documents")), 12, 2400)


def search_text(s, d):
    return V.search(doc_pages(table(s, d, "documents")), "that", 3).withColumnRenamed("at", "at_")


def _events(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("subject"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.coalesce("value", F.lit(0.0)).alias("bytes")).withColumn("t", F.col("us") / 1e6)


def budget_events(s, d):
    """Events as turns that reserve their value of tokens; every third settles five seconds later, to thrice its
    reservation's number or to an unknown use."""
    e = _events(s, d).select(F.col("subject").cast("string").alias("subject"), F.col("event_id").alias("turn"), "t", (F.col("event_id") % 4 > 0).alias("known"), F.floor("bytes").cast("double").alias("tokens"))
    used = F.when(F.col("turn") % 6 > 0, F.col("tokens") * 3)
    ends = e.filter("turn % 3 = 0").select("subject", F.lit("settle").alias("kind"), "turn", F.col("t") + 5, "known", used)
    turns = e.select("subject", F.lit("reserve").alias("kind"), "turn", "t", "known", "tokens").union(ends)
    return budget.budget_verdicts(turns, BUDGET).select("subject", "kind", "turn", "verdict", "moved", "remaining")


def quota_literal(s, d):
    return Q.verdicts(literal(s, d, *QUOTA_EVENTS), 3, 6, 100.0)


def quota_events(s, d):
    """The events table's users under the default limits; a fold that plain SQL can't do."""
    return Q.verdicts(_events(s, d).select("subject", "event_id", "t", "bytes"), PER_MINUTE, PER_DAY, BYTES_PER_DAY)


def quota_settle(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_quantity").alias("reserved"), (F.col("l_quantity") - F.floor(F.col("l_quantity") / 2)).alias("actual"))
    return Q.settled(rows)


def recipe_validate(s, d):
    return recipes.recipe_errors(literal(s, d, *RECIPES))


def event_windows(s, d):
    """An extension: events of each kind by whole days."""
    days = table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n")


_SIZE = "strlen(text) + 2 * len(list_filter(string_split(text, ''), lambda c: strlen(c) = 4))"
_SIZED = f"z AS (SELECT conv_id, turn, role, ({_SIZE})::BIGINT AS size FROM conversations)"
_P = f"p AS (SELECT * FROM {literal_sql(*PARAGRAPHS)})"
SQL = {
    "body_size_mode": f"WITH c AS (SELECT doc_id, floor(font_size * 2 + 0.5) / 2 AS body_size, count(*) AS n FROM {literal_sql(*SIZED_RUNS)} WHERE length(text) BETWEEN 2 AND 120 GROUP BY 1, 2) SELECT doc_id, body_size FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, body_size) = 1",
    # By hand: the large title, the bold line once, and first lines where a document has no heading.
    "suggested_bookmarks": "SELECT doc_id::BIGINT AS doc_id, page_index::INT AS page_index, title FROM (VALUES (1,0,'Intro'),(1,1,'Bold line'),(2,0,'only body'),(2,1,'Page 2'),(2,2,'third')) AS t(doc_id, page_index, title)",
    "first_line_bookmarks": f"""WITH {RUNS_SQL}, r AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM doc_runs), c AS (SELECT *, lower(t) AS k FROM r WHERE length(t) BETWEEN 2 AND 120),
n AS (SELECT doc_id, count(DISTINCT page_index) AS n FROM c GROUP BY 1), rep AS (SELECT c.doc_id, k FROM c JOIN n USING (doc_id) GROUP BY c.doc_id, k, n HAVING count(DISTINCT page_index) >= greatest(3, ceil(n * 0.5))),
f AS (SELECT doc_id, page_index, t FROM c WHERE NOT regexp_matches(t, '^(?i)(page ?)?\\d{{1,4}}( ?(of|/) ?\\d{{1,4}})?$') AND NOT regexp_matches(t, '^\\d{{1,4}} ?[-–—] ?\\d{{1,4}}$') AND (doc_id, k) NOT IN (SELECT doc_id, k FROM rep) QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y, x) = 1),
a AS (SELECT DISTINCT doc_id, page_index FROM doc_runs), g AS (SELECT a.doc_id, a.page_index, coalesce(t, 'Page ' || (a.page_index + 1)) AS title FROM a LEFT JOIN f USING (doc_id, page_index)),
l AS (SELECT *, lag(lower(title)) OVER (PARTITION BY doc_id ORDER BY page_index) AS b FROM g) SELECT doc_id, page_index, title FROM l WHERE b IS NULL OR b <> lower(title)""",
    "repeated_furniture": f"""WITH {_P}, n AS (SELECT doc_id, count(DISTINCT page_index) AS pages FROM p GROUP BY 1),
b AS (SELECT *, CASE WHEN role IN ('header', 'footer') THEN role WHEN y + height / 2 < page_height * 0.12 THEN 'header' WHEN y + height / 2 > page_height * 0.88 THEN 'footer' END AS band, lower(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g'))) AS key FROM p WHERE role <> 'table-cell' AND length(text) <= 200 AND font_size <= median_size * 1.25),
f AS (SELECT * FROM b WHERE band IS NOT NULL AND length(trim(text)) >= 3), k AS (SELECT f.doc_id, band, key FROM f JOIN n USING (doc_id) GROUP BY f.doc_id, band, key, pages HAVING pages >= 2 AND count(DISTINCT page_index) >= CASE WHEN pages <= 2 THEN 2 ELSE greatest(2, ceil(pages * 0.35)) END)
SELECT doc_id, page_index, para_id, band, key FROM f JOIN k USING (doc_id, band, key)""",
    "cross_page_links": f"""WITH {_P}, b AS (SELECT * FROM p WHERE role = 'body' AND y > 100 AND y < 700), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY para_id DESC) = 1), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY para_id) = 1)
SELECT l.doc_id, l.page_index, l.para_id AS from_para, f.para_id AS to_para, CASE WHEN regexp_matches(f.text, '^[a-z]') THEN 0.92::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM l JOIN f ON l.doc_id = f.doc_id AND f.page_index = l.page_index + 1
WHERE NOT regexp_matches(l.text, '[.!?:;]["''”’)\\]]?$') AND regexp_matches(f.text, '^([,;:)\\]}}”’]|[a-z])') AND l.font_family = f.font_family AND f.font_size / l.font_size BETWEEN 0.9 AND 1.1""",
    # By hand: blocks above a spanning one come before it, by column.
    "reading_order": f"""WITH b AS (SELECT *, CASE kind WHEN 'header' THEN 0 WHEN 'footer' THEN 2 ELSE 1 END AS band FROM {literal_sql(*BLOCKS)}),
t AS (SELECT b.*, (SELECT count(*) FROM b s WHERE s.doc_id = b.doc_id AND s.page_index = b.page_index AND s.band = 1 AND s.column_index < 0 AND CASE WHEN b.column_index >= 0 THEN s.y - 1 <= b.y ELSE s.y < b.y END) AS step FROM b)
SELECT doc_id, page_index, block_id, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY band, CASE WHEN band = 1 THEN step ELSE 0 END, CASE WHEN band = 1 AND column_index >= 0 THEN 0 ELSE 1 END, column_index, y, x, block_id)::INT AS place FROM t""",
    "weighted_median": """WITH w AS (SELECT l_orderkey, l_quantity, sum(greatest(l_linenumber, 0.01::DOUBLE)) AS w FROM lineitem GROUP BY 1, 2),
u AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY l_orderkey) / 2 AS half FROM w)
SELECT l_orderkey, min(l_quantity) AS median FROM u WHERE upto >= half GROUP BY l_orderkey""",
    "line_pitch_median": f"WITH {RUNS_SQL}, g AS (SELECT doc_id, page_index, y - lag(y) OVER (PARTITION BY doc_id, page_index ORDER BY y, run_no) AS gap FROM doc_runs) SELECT doc_id, page_index, quantile_cont(gap, 0.5) AS pitch FROM g WHERE gap > 0 GROUP BY 1, 2",
    "line_relations": f"""WITH b AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(baseline) OVER w AS pb, lag(font_size) OVER w AS ps, lag(family) OVER w AS pf FROM {literal_sql(*LINES)} WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_no)),
r AS (SELECT *, (baseline - pb) / greatest(0.1, pitch) AS gap_ratio, CASE WHEN abs(x0 - px0) <= 2 THEN 'left' WHEN abs(x1 - px1) <= 2 THEN 'right' WHEN abs((x0 + x1) / 2 - (px0 + px1) / 2) <= 2 THEN 'center' ELSE 'none' END AS sh, abs(font_size / greatest(ps, 0.1) - 1) <= 0.06 AND family = pf AS same, px1 < column_end - greatest(greatest(font_size, ps, 1) * 2, 12) AS short FROM b WHERE px0 IS NOT NULL)
SELECT doc_id, page_index, line_no, gap_ratio, x0 - px0 AS indent_delta, x1 - px1 AS right_delta, sh AS shared_alignment, same AS same_typography,
least(greatest(0.5::DOUBLE * least(greatest((1.8::DOUBLE - gap_ratio) / 0.8::DOUBLE, 0), 1) + 0.2::DOUBLE * CASE WHEN sh = 'none' THEN 0.25::DOUBLE ELSE 1 END + 0.2::DOUBLE * CASE WHEN same THEN 1 ELSE 0.3::DOUBLE END + 0.1::DOUBLE * CASE WHEN short THEN 0 ELSE 1 END, 0), 1) AS continuation FROM r""",
    "coverage_ratio": f"""WITH {RUNS_SQL}, a AS (SELECT doc_id, page_index, unnest(range(floor(x / 8)::BIGINT, floor((x + width) / 8)::BIGINT + 1)) AS cx, y, height FROM doc_runs), b AS (SELECT doc_id, page_index, cx, unnest(range(floor(y / 8)::BIGINT, floor((y + height) / 8)::BIGINT + 1)) AS cy FROM a)
SELECT doc_id, page_index, least(count(*) * 64 / (612.0::DOUBLE * 792.0::DOUBLE), 1.0::DOUBLE) AS coverage FROM (SELECT DISTINCT * FROM b) GROUP BY 1, 2""",
    "paragraph_alignment": f"""WITH l AS (SELECT *, CASE WHEN x0 - left_ > 2 AND abs((x0 - left_) - (right_ - x1)) <= 2 THEN 'center' WHEN x0 - left_ > 2 AND right_ - x1 <= 2 THEN 'right' ELSE 'left' END AS a, line_no < max(line_no) OVER (PARTITION BY para_id) AS inner_, x0 - left_ <= greatest(font_size, 1) * 1.6 AND right_ - x1 <= greatest(font_size, 1) * 1.6 AS fills FROM {literal_sql(*ALIGNED)}),
s AS (SELECT para_id, count(*) AS n, count(*) FILTER (a = 'center') AS c, count(*) FILTER (a = 'right') AS r, coalesce(bool_and(fills) FILTER (inner_), false) AS f FROM l GROUP BY 1)
SELECT para_id, CASE WHEN c >= greatest(1, n * 0.6) THEN 'center' WHEN r >= greatest(1, n * 0.6) THEN 'right' WHEN n >= 2 AND f THEN 'justify' ELSE 'left' END AS alignment FROM s""",
    # Folds; by hand.
    "glyph_words": "SELECT doc_id::BIGINT AS doc_id, page_index::INT AS page_index, word_no::INT AS word_no, text, x0::DOUBLE AS x0, x1::DOUBLE AS x1 FROM (VALUES (1,0,1,'Hi',0,9),(1,0,2,'yo',12,22.5),(1,0,3,'u',30,35),(1,1,1,'z',3,8)) AS t(doc_id, page_index, word_no, text, x0, x1)",
    "cluster_runs": "SELECT doc_id::BIGINT AS doc_id, page_index::INT AS page_index, run_no::INT AS run_no, text, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height, 10.0::DOUBLE AS font_size FROM (VALUES (1,0,0,'Hello world',0,100,55,11),(1,0,1,'far',200,100,15,10),(1,0,2,'next',0,115,20,10)) AS t(doc_id, page_index, run_no, text, x, y, width, height)",
    "wrapped_text": "SELECT item_id AS id, true AS fits, length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM benchmark",
    "line_roles": f"SELECT * FROM {literal_sql(*ROLE_RESULT)}",
    "column_bounds": f"WITH {RUNS_SQL} SELECT doc_id, page_index, run_no % 2 AS column_index, min(x) AS left_, max(x + width) AS right_, quantile_cont(x + width, 0.5) AS typical_end FROM doc_runs GROUP BY 1, 2, 3",
    "joined_words": f"""SELECT id, list_reduce(list_prepend('', list_filter(string_split(words, '|'), lambda w: w <> '')), lambda a, b: CASE WHEN a = '' THEN b ELSE a || CASE WHEN {TIGHT_SQL.format(a="a", b="b")} THEN '' ELSE ' ' END || b END) AS text FROM {literal_sql(*WORD_LISTS)}""",
    "role_counts": f"SELECT role, count(*) AS n FROM {literal_sql(*PARAGRAPHS)} GROUP BY role",
    "confidence_bands": "SELECT event_id, CASE WHEN event_id % 100 / 100 >= 0.85 THEN 'high' WHEN event_id % 100 / 100 >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM events",
    "box_overlap": f"WITH r AS (SELECT * FROM {literal_sql(*RECTS)}) SELECT a.page, a.id, b.id AS other, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared FROM r a JOIN r b ON a.page = b.page AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1",
    "hit_test": f"SELECT point, id FROM {literal_sql(*POINTS)} p JOIN {literal_sql(*RECTS)} r ON page = 1 AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 QUALIFY row_number() OVER (PARTITION BY point ORDER BY (x1 - x0) * (y1 - y0), id) = 1",
    "nearest_line": f"""WITH d AS (SELECT point, id, greatest(x0 - px, px - x1, 0) AS dx, greatest(y0 - py, py - y1, 0) AS dy FROM {literal_sql(*POINTS)}, {literal_sql(*RECTS)} WHERE page = 1),
t AS (SELECT point, id, CASE WHEN greatest(dx, dy) <= 3 THEN 1 WHEN greatest(dx, dy) <= 6 THEN 2 WHEN greatest(dx, dy) <= 12 THEN 4 WHEN greatest(dx, dy) <= 24 THEN 8 END AS tier, sqrt(dx * dx + dy * dy) AS distance FROM d)
SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point ORDER BY tier, distance, id) = 1""",
    "frame_transform": f"""SELECT id, CASE rot WHEN 90 THEN x0 + 20 WHEN 180 THEN x1 - 10 WHEN 270 THEN x1 - 20 ELSE x0 + 10 END AS px, CASE rot WHEN 90 THEN y0 + 10 WHEN 180 THEN y0 + 20 WHEN 270 THEN y1 - 10 ELSE y1 - 20 END AS py, 10.0::DOUBLE AS x, 20.0::DOUBLE AS y,
CASE WHEN rot IN (90, 270) THEN y1 - y0 ELSE x1 - x0 END AS w, CASE WHEN rot IN (90, 270) THEN x1 - x0 ELSE y1 - y0 END AS h FROM {literal_sql(*BOXES)}""",
    "crop_clamp": f"SELECT id, greatest(mx0, cx0) AS x0, greatest(my0, cy0) AS y0, least(mx1, cx1) AS x1, least(my1, cy1) AS y1, least(mx1, cx1) <= greatest(mx0, cx0) OR least(my1, cy1) <= greatest(my0, cy0) AS empty FROM {literal_sql(*CLIPS)}",
    "render_budget": f"SELECT id, least(wanted, 8192.0::DOUBLE / greatest(width, height), sqrt(16777216.0::DOUBLE / (width * height))) AS scale FROM {literal_sql(*SIZES)}",
    "luma_pixels": f"SELECT id, least(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5), 255)::INT AS luma, 255 - r AS inverse_r, 255 - g AS inverse_g, 255 - b AS inverse_b FROM {literal_sql(*PIXELS)}",
    "message_size": f"WITH {_SIZED} SELECT * FROM z",
    "compaction_cut": f"""WITH {_SIZED}, t AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail FROM z)
SELECT conv_id, sum(size)::BIGINT AS total, coalesce(min(turn) FILTER (role = 'user' AND tail <= 300), max(turn) FILTER (role = 'user')) AS cut FROM t GROUP BY conv_id HAVING sum(size) > 600""",
    "orphan_repair": "SELECT conv_id, turn, role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE NOT (role = 'user' AND coalesce(a, 'user') = 'user')",
    "history_trim": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT conv_id, min(turn) FILTER (k <= 4 AND role = 'user') AS st FROM n GROUP BY 1)
SELECT conv_id, turn, role FROM n JOIN s USING (conv_id) WHERE st IS NULL OR n <= 4 OR turn >= st""",
    "history_topk": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "squashed_turns": "SELECT conv_id, turn, (CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 1 THEN least(length(text), 50) ELSE length(text) END)::INT AS chars FROM conversations",
    "read_budget": f"WITH {PAGES_SQL} SELECT doc_id, page_index, upto FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_index)::BIGINT AS upto FROM doc_pages) WHERE upto <= 2400 AND page_index < 12",
    "search_text": f"WITH {PAGES_SQL}, h AS (SELECT *, instr(lower(text), 'that') AS pos FROM doc_pages WHERE contains(lower(text), 'that')) SELECT doc_id, page_index, pos AS at_, text[greatest(pos - 60, 1):(pos + 239)] AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_index) <= 3",
    "quota_literal": f"SELECT * FROM {literal_sql(*QUOTA_RESULT)}",
    "quota_settle": "SELECT l_suppkey AS subject, sum(l_quantity) AS reserved, sum(-floor(l_quantity / 2)) AS delta, sum(l_quantity - floor(l_quantity / 2)) AS charged FROM lineitem GROUP BY 1",
    "recipe_validate": f"""WITH s AS (SELECT * FROM {literal_sql(*RECIPES)}), m AS (SELECT recipe_id, step_id, min(pos) AS made, min_by(tool, pos) AS maker FROM s GROUP BY 1, 2),
e AS (SELECT s.recipe_id, s.pos, CASE WHEN made IS NULL THEN 'missing-step' WHEN made >= pos THEN 'forward-edge' WHEN maker NOT IN {recipes.CHAINABLE} THEN 'not-chainable' END AS error FROM s LEFT JOIN m ON m.recipe_id = s.recipe_id AND m.step_id = s.input_ref WHERE input_kind = 'step')
SELECT recipe_id, pos, error FROM e WHERE error IS NOT NULL UNION ALL SELECT recipe_id, pos, 'unknown-tool' FROM s WHERE tool NOT IN {recipes.TOOLS}
UNION ALL SELECT recipe_id, pos, 'duplicate-step' FROM (SELECT *, row_number() OVER (PARTITION BY recipe_id, step_id ORDER BY pos) AS k FROM s) WHERE k > 1 UNION ALL SELECT recipe_id, pos, 'bad-input' FROM s WHERE input_kind NOT IN ('source', 'step')
UNION ALL SELECT recipe_id, pos, 'too-many-steps' FROM (SELECT *, count(*) OVER (PARTITION BY recipe_id) AS n FROM s) WHERE n > {recipes.MAX_STEPS}""",
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in (*SQL, "quota_events", "budget_events")}
