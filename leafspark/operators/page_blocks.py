"""From lines on a page to roles, paragraphs with their confidence, blocks, regions and page measures.

Lines are those of ``operators.page_rows``: a page's lines of one direction and column are a lane. What a
line takes from its neighbours in the lane is a window; whether it goes on with the open paragraph depends
on what that paragraph began as, so that decision is an ordered fold over a few numbers of each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import LIST_MARKER
from leafspark.operators import layout as L
from leafspark.operators.folds import folded
from leafspark.operators.page_rows import FAMILY, PAGE, page_lines
from leafspark.sources.staging import staged

LANE = [*FAMILY, "column"]
#: Pitch of the open paragraph beyond which it ends, and how similar sizes are.
BREAK, LIKE = 1.4, (0.86, 1.16)
#: How sure a role is; a heading depends on its size and weight.
CERTAIN = {"caption": 0.78, "footnote": 0.75, "header": 0.88, "footer": 0.88, "list-item": 0.9, "table-cell": 0.72}


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _lane(keys: list[str] = LANE) -> Window:
    return Window.partitionBy(*keys).orderBy("baseline", "a0", "line_no")


def similar(size: Column, family: Column, last_size: Column, last_family: Column) -> Column:
    return (size / F.greatest(last_size, F.lit(0.1))).between(*LIKE) & (family == last_family)


def side(a0: Column, a1: Column, size: Column, left: Column, right: Column) -> Column:
    """Where a line stands between its column's edges."""
    size = F.greatest(size, F.lit(1.0))
    before, after = a0 - left, right - a1
    middle = (before > size * 2) & (after > size * 2) & (F.abs(before - after) <= F.greatest(size * 1.5, (before + after) * 0.15))
    return F.when(middle, "center").when((before > size * 2) & (after <= size * 1.5), "right").otherwise("left")


def hinted(lines: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Lines with ``line_no`` on the page, ``body_size`` and ``pitch`` of the page, ``role``, ``level`` of headings,
    their column's ``left``, ``right`` and ``typical`` end, ``indent``, and ``list_level``."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("bucket", "row", "a0", "column", "line"))
    n = lines.filter(F.length(F.trim("text")) > 0).withColumn("line_no", number)
    n = _body_size(n).withColumn("largest", F.max("font_size").over(Window.partitionBy(*PAGE)))
    view = n.withColumn("y", F.col("y0")).withColumn("height", F.col("y1") - F.col("y0")).withColumn("page_height", F.lit(page_height))
    n = L.line_roles(view).drop("y", "height", "page_height")
    ratio = F.greatest("font_size", F.lit(0.1)) / F.greatest("body_size", F.lit(0.1))
    level = F.when((ratio >= 1.16) & (F.col("font_size") >= F.col("largest") * 0.95), 1).when(ratio >= 1.32, 2).otherwise(3)
    n = n.withColumn("level", F.when(F.col("role") == "heading", level).otherwise(0)).drop("largest")
    n = _apart(_tails(_pitched(n)), page_width)
    return _listed(_bounded(n, page_width))


def _body_size(n: DataFrame) -> DataFrame:
    """The page's size, in quarters, of most characters times size; the first one seen of equals."""
    quarter = F.floor(F.col("font_size") / 0.25 + 0.5) * 0.25
    of_size = Window.partitionBy(*PAGE, "quarter")
    n = n.withColumn("quarter", quarter).withColumn("weight", F.sum(F.length(F.trim("text")) * F.col("quarter")).over(of_size)).withColumn("seen", F.min("line_no").over(of_size))
    best = F.max_by("quarter", F.struct("weight", -F.col("seen"))).over(Window.partitionBy(*PAGE))
    return n.withColumn("body_size", F.when(best > 0, best).otherwise(10.0)).drop("quarter", "weight", "seen")


def _pitched(n: DataFrame) -> DataFrame:
    """The page's line pitch: the median gap between neighbours of one role that stand close."""
    lane = _lane()
    gap = F.col("baseline") - F.lag("baseline").over(lane)
    close = (gap > 0.5) & (gap <= F.greatest("font_size", F.lag("font_size").over(lane)) * 2.6) & (F.col("role") == F.lag("role").over(lane))
    n = n.withColumn("gap", F.when(close, gap))
    measured = F.percentile("gap", F.lit(0.5)).over(Window.partitionBy(*PAGE))
    return n.withColumn("pitch", F.coalesce(measured, F.greatest(F.lit(4.0), F.col("body_size") * 1.25))).drop("gap")


def _tails(n: DataFrame) -> DataFrame:
    """Lines without a mark that follow a footnote closely, in its type and no larger, belong to it."""
    lane = _lane()
    last = lambda c: F.lag(c).over(lane)
    follows = (
        ~F.col("role").isin("header", "unknown") & ~F.regexp_like(F.trim("text"), F.lit(L.FOOTNOTE))
        & (F.col("baseline") - last("baseline") <= F.col("pitch") * 1.8) & (F.col("font_size") <= last("font_size") * 1.05)
        & similar(F.col("font_size"), F.col("family"), last("font_size"), last("family"))
    )
    n = n.withColumn("chain", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    marked = F.max(F.col("role") == "footnote").over(Window.partitionBy(*LANE, "chain").orderBy("baseline", "a0", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("tail", marked & (F.col("role") != "footnote"))
    return n.withColumn("role", F.when(F.col("tail"), "footnote").otherwise(F.col("role"))).withColumn("level", F.when(F.col("tail"), 0).otherwise(F.col("level"))).drop("chain", "tail")


def _apart(n: DataFrame, page_width: float) -> DataFrame:
    """Short lines of body type between prose, set apart above and below, are headings of level 3."""
    lane = _lane()
    last, after = (lambda c: F.lag(c).over(lane)), (lambda c: F.lead(c).over(lane))
    text = F.trim("text")
    words = F.split(text, r"(?U)\s+")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    single = F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit(r"^[A-Za-z]\z"))))
    size = F.col("body_size")
    found = (
        (F.col("role") == "body") & F.length(text).between(1, 60) & ~F.regexp_like(text, F.lit(r"[.,;:!?\-]\z")) & (F.size(words) <= 9)
        & (F.col("font_size") >= size * 0.95) & (last("font_size") >= size * 0.9) & (after("font_size") >= size * 0.9)
        & (letters >= 2) & (letters / F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"(?U)\s+", ""))) >= 0.6) & (single / F.size(words) <= 0.3)
        & (F.length(F.trim(after("text"))) >= 20) & (after("a1") - after("a0") >= page_width * 0.15) & (F.length(F.trim(last("text"))) >= 20)
        & (F.col("a1") - F.col("a0") <= page_width * 0.55)
        & (F.col("baseline") - last("baseline") >= F.col("pitch") * 1.5) & (after("baseline") - F.col("baseline") >= F.col("pitch") * 1.5)
    )
    n = n.withColumn("heading", F.coalesce(found, F.lit(False)))
    return n.withColumn("role", F.when(F.col("heading"), "heading").otherwise(F.col("role"))).withColumn("level", F.when(F.col("heading"), 3).otherwise(F.col("level"))).drop("heading")


def _bounded(n: DataFrame, page_width: float) -> DataFrame:
    lane = Window.partitionBy(*LANE)
    body = ~F.col("role").isin("header", "footer")
    n = n.withColumn("left", F.min(F.when(body, F.col("a0"))).over(lane)).withColumn("right", F.max(F.when(body, F.col("a1"))).over(lane))
    n = n.withColumn("end", F.when(body, F.col("a1"))).withColumn("typical", F.coalesce(F.percentile("end", F.lit(0.5)).over(lane), F.lit(page_width))).drop("end")
    flat = F.coalesce(F.col("right") <= F.col("left"), F.lit(True))
    n = n.withColumn("right", F.when(flat, page_width).otherwise(F.col("right"))).withColumn("left", F.when(flat, 0.0).otherwise(F.col("left")))
    return n.withColumn("indent", F.when(F.col("column") >= 0, F.greatest(F.lit(0.0), F.col("a0") - F.col("left"))).otherwise(0.0))


def _listed(n: DataFrame) -> DataFrame:
    """Levels of list items: their column's indents in steps of more than 60 % of the body size."""
    item = F.col("role") == "list-item"
    indents = F.array_sort(F.collect_set(F.when(item, F.floor(F.col("indent") * 2 + 0.5) / 2)).over(Window.partitionBy(*LANE)))
    step = F.greatest(F.lit(4.0), F.col("body_size") * 0.6)
    none = F.array().cast("array<double>")
    centres = F.aggregate(indents, none, lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > step), F.concat(a, F.array(x))).otherwise(a))
    level = F.least(F.greatest(F.size(F.filter("centres", lambda c: F.col("indent") + 1 >= c)), F.lit(1)), F.lit(6))
    return n.withColumn("centres", centres).withColumn("list_level", F.when(item, level).otherwise(0)).drop("centres")


def pairs(n: DataFrame, keys: list[str] = LANE) -> DataFrame:
    """Each line's relation to the one before it in its lane: gaps, similarity, and how likely it goes on."""
    lane = _lane(keys)
    last = lambda c: F.lag(c).over(lane)
    near = lambda x, y: F.abs(x - y) <= 2.0
    a0, a1, size = F.col("a0"), F.col("a1"), F.col("font_size")
    shared = near(a0, last("a0")) | near(a1, last("a1")) | near((a0 + a1) / 2, (last("a0") + last("a1")) / 2)
    grown = size / F.greatest(last("font_size"), F.lit(0.1))
    same = (F.abs(grown - 1) <= 0.06) & (F.col("family") == last("family"))
    own = F.greatest(last("font_size"), F.lit(1.0))
    short = last("a1") < F.col("typical") - F.greatest(F.greatest(last("font_size"), size, F.lit(1.0)) * 2, F.lit(12.0))
    n = n.withColumn("gap", F.col("baseline") - last("baseline")).withColumn("gap_ratio", F.col("gap") / F.greatest(F.lit(0.1), F.col("pitch")))
    go_on = 0.5 * unit((1.8 - F.col("gap_ratio")) / 0.8) + 0.2 * F.when(shared, 1.0).otherwise(0.25) + 0.2 * F.when(same, 1.0).otherwise(0.3) + 0.1 * F.when(short, 0.0).otherwise(1.0)
    n = n.withColumn("side", side(a0, a1, size, F.col("left"), F.col("right")))
    return (
        n.withColumn("like", F.coalesce(similar(size, F.col("family"), last("font_size"), last("family")), F.lit(False)))
        .withColumn("grown", grown).withColumn("going", unit(go_on)).withColumn("shift", a0 - last("a0")).withColumn("last_side", last("side")).withColumn("own", own)
        .withColumn("ended", F.coalesce(last("a1") < F.col("typical") - F.greatest(own * 2, F.greatest(F.lit(1.0), F.col("right") - F.col("left")) * 0.18), F.lit(False)))
    )


def _decision(draft, role, level, indent, size, body, gap, ratio, like, grown, going, shift, side_, last_side, own, ended):
    """Whether a line goes on with the open paragraph, how sure that is, and whether it was close."""
    kind, kind_level, kind_indent = draft
    margins = ("header", "footer")
    if role == "list-item":
        return False, 0.9, False
    if gap <= 0:
        return False, 0.95, False
    if kind == "list-item":
        if role in margins:
            return False, 0.95, False
        go = ratio <= 1.8 and like and indent >= kind_indent - own * 0.4
        return go, min(1.0, max(0.0, 1 - (ratio - 1) / 1.6)) if go else 0.7, go and ratio > 1.55
    if role in margins:
        go = kind == role and ratio <= 1.8
        return go, 0.8 if go else 0.9, False
    if kind in margins:
        return False, 0.95, False
    if "heading" in (kind, role):
        go = kind == role and kind_level == level and like and ratio <= 1.8
        return go, 0.85 if go else 0.9, go and ratio > 1.5
    if "caption" in (kind, role):
        tail = kind == "caption" and role == "body" and like and size <= body * 1.02 and ratio <= 1.5
        go = (tail or kind == role) and like and ratio <= 1.8
        return go, (0.7 if tail else 0.85) if go else 0.8, go and tail
    if kind != role or not like:
        return False, 0.95, False
    if ratio > BREAK:
        return False, min(1.0, max(0.0, 0.5 + (ratio - BREAK) * 2)), ratio < BREAK + 0.25
    if ended:
        return False, 0.8, False
    if shift > max(2.0, own * 0.6):
        return False, 0.75, False
    if last_side in ("center", "right") and last_side != side_:
        return False, 0.7, False
    close, even = min(1.0, max(0.0, (BREAK - ratio) / (BREAK - 1))), min(1.0, max(0.0, 1 - abs(grown - 1) / 0.16))
    score = min(1.0, max(0.0, 0.25 + 0.3 * close + 0.25 * going + 0.2 * even))
    return True, score, ratio > 1.2 or (body > 0 and abs(grown - 1) > 0.09)


def _paragraph_step(state, role, level, indent, *rest):
    """The open paragraph: its number, and role, level and indent of its first line."""
    if state is not None:
        number, draft = state
        go, score, unsure = _decision(draft, role, level, indent, *rest)
        if go:
            return state, (number, True, score, unsure)
        return (number + 1, (role, level, indent if role == "list-item" else 0.0)), (number + 1, False, score, unsure)
    return (0, (role, level, indent if role == "list-item" else 0.0)), (0, False, None, False)


def paragraph_lines(n: DataFrame) -> DataFrame:
    """Lines outside of tables with their ``para`` within the lane, whether they ``joined`` the line before,
    how sure that decision is (``score``), and whether it was ``unsure``."""
    return _decided(n.filter("table IS NULL"))


def _decided(n: DataFrame) -> DataFrame:
    """The same for all lines, of which cells of tables are each a paragraph of their own, -1 - line_no."""
    reads = ["role", "level", "indent", "font_size", "body_size", "gap", "gap_ratio", "like", "grown", "going", "shift", "side", "last_side", "own", "ended"]
    # Cells lie in lanes of their own, of one line each.
    cell = F.when(F.col("table").isNotNull(), F.col("line_no")).otherwise(0)
    n = pairs(n.withColumn("cell", cell), [*LANE, "cell"])
    told = folded(n, [*LANE, "cell"], ["baseline", "a0", "line_no"], reads, "para int, joined boolean, score double, unsure boolean", _paragraph_step, small=True)
    return told.withColumn("para", F.when(F.col("cell") > 0, -1 - F.col("cell")).otherwise(F.col("para"))).drop("cell")


def _certainty(role: Column, size: Column, body: Column, bold: Column) -> Column:
    heading = F.when(size / F.greatest(body, F.lit(0.1)) >= 1.16, 0.95).when(bold, 0.85).otherwise(0.7)
    out = F.when(role == "heading", heading)
    for name, sure in CERTAIN.items():
        out = out.when(role == name, sure)
    return out.otherwise(0.8)


def paragraphs(n: DataFrame) -> DataFrame:
    """Hinted lines to paragraphs; a table's cell is one of its own. ``para`` counts within the lane from 0,
    cells have -1 - line_no."""
    cell = F.col("table").isNotNull()
    both = _decided(n.drop("row", "line", "italic", "n_words")).withColumn("role", F.when(cell, "table-cell").otherwise(F.col("role")))
    both = both.withColumn("level", F.when(cell, 0).otherwise(F.col("level"))).withColumn("list_level", F.when(cell, 0).otherwise(F.col("list_level")))
    size = F.greatest("font_size", F.lit(1.0)) * 1.6
    fills = (F.col("a0") - F.col("left") <= size) & (F.col("right") - F.col("a1") <= size)
    row = F.struct("baseline", "a0", "line_no", "text", "role", "level", "list_level", "font_size", "family", "bold", "indent", "score", fills.alias("fills"), "body_size")
    p = both.select(*LANE, "para", row.alias("l"), "x0", "y0", "x1", "y1", "joined", "unsure", "side", "pitch", "table", "table_row", "place")
    # By page, since Python doesn't tell how lines are dealt.
    p = p.repartition(*PAGE).groupBy(*LANE, "para").agg(
        F.array_sort(F.collect_list("l")).alias("l"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.avg(F.when(F.col("joined"), F.col("l.score"))).alias("inner"), F.bool_or(F.col("joined") & F.col("unsure")).alias("ambiguous"),
        F.count_if(F.col("side") == "center").alias("c"), F.count_if(F.col("side") == "right").alias("r"), F.max("pitch").alias("pitch"),
        F.max("table").alias("table"), F.max("table_row").alias("table_row"), F.max("place").alias("place"),
    )
    first, count = F.col("l")[0], F.size("l")
    p = p.withColumn("cut", F.when(F.col("para") > 0, first["score"]))
    lane = Window.partitionBy(*LANE).orderBy("para")
    p = p.withColumn("next_cut", F.when(F.col("para") >= 0, F.lead("cut").over(lane)))
    weight = lambda c: F.coalesce(0.55 + 0.45 * unit(F.col(c)), F.lit(1.0))
    sure = F.coalesce("inner", _certainty(first["role"], first["font_size"], first["body_size"], first["bold"]))
    most = F.greatest(F.lit(1.0), count * 0.6)
    full = F.forall(F.slice("l", F.lit(1), F.greatest(count - 1, F.lit(1))), lambda x: x["fills"])
    head = F.when(first["role"] == "list-item", F.regexp_replace(F.trim(first["text"]), LIST_MARKER.removesuffix(r"\S") + r"(?=\S)", "")).otherwise(F.trim(first["text"]))
    start = F.struct(head.alias("text"), first["text"].alias("last"))
    text = F.aggregate(F.slice("l", F.lit(2), F.greatest(count - 1, F.lit(0))), start, lambda s, x: F.struct(
        F.when(s["text"] == "", F.trim(x["text"])).otherwise(F.concat(s["text"], L.separator(s["last"], x["text"]), F.trim(x["text"]))).alias("text"), x["text"].alias("last")), lambda s: s["text"])
    return p.select(
        *LANE, "para", first["role"].alias("role"), first["level"].alias("level"), first["list_level"].alias("list_level"), F.trim(text).alias("text"), count.alias("n_lines"),
        "x0", "y0", "x1", "y1", first["font_size"].alias("font_size"), first["family"].alias("family"), first["indent"].alias("indent"),
        F.when(F.col("c") >= most, "center").when(F.col("r") >= most, "right").when((count >= 2) & full, "justify").otherwise("left").alias("alignment"),
        unit(sure * weight("cut") * weight("next_cut")).alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "pitch", "table", "table_row", "place",
        F.transform("l", lambda x: x["line_no"]).alias("lines"),
    )


def blocks(p: DataFrame) -> DataFrame:
    """Paragraphs to blocks: a table is one; others are neighbours of one lane, role, level and alignment with
    no more than a line between them. ``block`` numbers those of a page."""
    held = F.col("table").isNotNull()
    kind = F.when(held, "table").when(F.col("role") == "list-item", "list").when(F.col("role") == "table-cell", "table").otherwise(F.col("role"))
    # A table's cells are one group, whatever their alignment.
    p = p.withColumn("kind", kind).withColumn("alignment", F.when(~held, F.col("alignment")))
    lane = [*LANE, "table", "kind", "level", "list_level", "alignment"]
    order = Window.partitionBy(*lane).orderBy("y0", "x0", "para")
    gap = F.col("y0") - F.lag("y1").over(order)
    apart = ((gap > F.greatest(F.col("pitch") * 1.1, F.col("font_size") * 1.6)) | (gap < -F.col("pitch"))) & ~held
    grouped = p.withColumn("group", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = grouped.groupBy(*lane, "group").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_paragraphs"),
        F.bool_or("ambiguous").alias("ambiguous"), F.avg("confidence").alias("mean"), F.sort_array(F.collect_list("para")).alias("paras"),
    ).withColumn("confidence", unit(F.col("mean") - F.when(F.col("ambiguous") & ~held, 0.05).otherwise(0.0)))
    columns = [*LANE, "kind", "n_paragraphs", "x0", "y0", "x1", "y1", "confidence", "ambiguous", "paras", "table"]
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("bucket", "column", "y0", "x0", "kind", "paras"))
    return both.select(*columns).withColumn("block", number)


def regions(b: DataFrame) -> DataFrame:
    """Blocks to regions: headers, footers, each table, and the rest, by columns where a page has several."""
    several = F.max(F.when((F.col("column") >= 0) & (F.col("bucket") == 0), F.col("column")).otherwise(0)).over(Window.partitionBy(*PAGE)) > 0
    own = F.col("kind").isin("header", "footer", "table")
    kind = F.when(own, F.col("kind")).when(several & (F.col("column") >= 0), "column").otherwise("content")
    r = b.withColumn("region", kind).withColumn("of", F.when(F.col("region") == "table", F.col("block")).when(F.col("region") == "column", F.col("column")).otherwise(-1))
    return r.groupBy(*PAGE, "region", "of").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence")
    )


def agreement(n: DataFrame) -> DataFrame:
    """Of a page's joins of lines within paragraphs: the part in one type, and that sharing an edge."""
    lane = Window.partitionBy(*LANE, "para").orderBy("baseline", "a0", "line_no")
    last = lambda c: F.lag(c).over(lane)
    near = lambda x, y: F.abs(x - y) <= 2.0
    a0, a1 = F.col("a0"), F.col("a1")
    same = (F.abs(F.col("font_size") / F.greatest(last("font_size"), F.lit(0.1)) - 1) <= 0.06) & (F.col("family") == last("family"))
    edge = near(a0, last("a0")) | near(a1, last("a1")) | near((a0 + a1) / 2, (last("a0") + last("a1")) / 2)
    # What the fold reads goes to Python whole, so texts and boxes are left behind.
    slim = n.select(*LANE, "line_no", "table", "baseline", "a0", "a1", "font_size", "family", "role", "level", "indent", "body_size", "pitch", "left", "right", "typical")
    j = paragraph_lines(slim).withColumn("same", same).withColumn("edge", edge).filter("edge IS NOT NULL")
    return j.groupBy(*PAGE).agg(F.avg(F.col("same").cast("int")).alias("same"), F.avg(F.col("edge").cast("int")).alias("edge"))


def page_structure(marks: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> tuple[DataFrame, DataFrame]:
    """Marks to hinted lines and paragraphs, written, for what reads both of them."""
    n = staged(hinted_lines(marks, page_width, page_height), "hinted")
    return n, staged(paragraphs(n), "paragraphs")


def hinted_lines(marks: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Marks to hinted lines; what reads them once needs nothing written."""
    return hinted(page_lines(marks, max(page_width, page_height)), page_width, page_height)


def page_measures(n: DataFrame, p: DataFrame, b: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """One row a page: counts, body size, pitch, and the confidences of its structure."""
    by_line = n.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("n_words").alias("n_words"), F.max("body_size").alias("body_size"), F.max("pitch").alias("pitch"),
        F.count_distinct(F.when((F.col("bucket") == 0) & (F.col("column") >= 0), F.col("column"))).alias("n_columns"),
    )
    by_para = p.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.avg("confidence").alias("mean"), F.avg(F.col("ambiguous").cast("int")).alias("unsure"), F.sum("n_lines").alias("held"),
        F.avg((F.col("role") != "unknown").cast("int")).alias("known"), F.count_if(F.col("role") == "heading").alias("n_headings"),
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    by_block = b.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("kind") == "table").alias("n_tables"), F.sum(F.when(F.col("kind") == "table", area).otherwise(0.0)).alias("covered"),
        F.avg(F.when(F.col("kind") == "table", F.col("confidence"))).alias("table_mean"),
    )
    sure = F.col("mean")
    m = by_line.join(by_para, PAGE).join(by_block, PAGE).join(agreement(n), PAGE, "left")
    same, edge, clear = F.coalesce("same", F.lit(1.0)), F.coalesce("edge", F.lit(1.0)), 1 - F.col("unsure")
    return m.select(
        *PAGE, "n_lines", "n_words", "n_columns", "n_paragraphs", "n_headings", "n_blocks", "n_tables", "body_size", "pitch",
        unit(0.55 * sure + 0.25 * F.col("held") / F.col("n_lines") + 0.2 * clear).alias("grouping"), unit(0.85 * sure + 0.15 * clear).alias("boundaries"),
        unit(0.4 * same + 0.35 * edge + 0.25).alias("relations"), F.coalesce("table_mean", F.lit(0.9)).alias("table_sure"), unit(0.6 * F.col("known") + 0.4 * sure).alias("classified"),
        unit(0.7 * (1 - unit(F.col("covered") / (page_width * page_height))) + 0.3 * clear).alias("reflow_safe"),
    )


def document_measures(n: DataFrame, p: DataFrame) -> DataFrame:
    """One row a document: pages, those with several columns, tables, headings, list items, and the mean of its
    pages' body sizes by words."""
    upright = (F.col("bucket") == 0) & (F.col("column") >= 0)
    pages = n.groupBy(*PAGE).agg(
        F.count_distinct(F.when(upright, F.col("column"))).alias("columns"), F.count_distinct(F.when(F.col("table").isNotNull(), F.struct("bucket", "column", "table"))).alias("tables"),
        F.max("body_size").alias("body_size"), F.sum("n_words").alias("words"),
    )
    sums = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("columns") > 1).alias("column_pages"), F.sum("tables").alias("n_tables"), (F.sum(F.col("body_size") * F.col("words")) / F.sum("words")).alias("size")
    )
    roles = p.groupBy("doc_id").agg(F.count_if(F.col("role") == "heading").alias("n_headings"), F.count_if(F.col("role") == "list-item").alias("n_items"))
    return sums.join(roles, "doc_id")


def line_places(n: DataFrame, p: DataFrame, b: DataFrame) -> DataFrame:
    """Each line's paragraph, with its role, and block, with its kind and top."""
    of_line = p.select(*LANE, "para", "role", F.explode("lines").alias("line_no"))
    of_para = b.select(*LANE, "kind", F.col("y0").alias("block_y"), F.explode("paras").alias("para"))
    return n.select(*LANE, "line_no").join(of_line, [*LANE, "line_no"]).join(of_para, [*LANE, "para"])
