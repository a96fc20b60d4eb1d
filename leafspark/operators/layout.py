"""Text and layout: lines, furniture, headings, reading order, statistics.

Measures that need only neighbours are windows over one page or document. Ordered folds, where each
step depends on what the last one made, run in one pandas function for a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.text import CONTROLS, SPACE, furniture_key, is_page_number, squeezed

PAGE = ["doc_id", "page_index"]


def modal_size(runs: DataFrame, size: str = "font_size") -> DataFrame:
    """Each document's commonest size, in halves; of equally common ones the smaller."""
    counts = runs.groupBy("doc_id", (F.floor(F.col(size) * 2 + 0.5) / 2).alias("body_size")).agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "body_size"))
    return counts.withColumn("_r", best).filter("_r = 1").drop("_r")


def weighted_body_size(lines: DataFrame) -> DataFrame:
    """Each page's size, in quarters, with most characters times size; of equals the first one seen; 10
    for a page without text."""
    bucket = (F.floor(F.col("font_size") / 0.25 + 0.5) * 0.25).alias("body_size")
    sums = lines.groupBy(*PAGE, bucket).agg(F.sum(F.length("text") * F.col("font_size")).alias("weight"), F.min("line_no").alias("first"))
    best = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("weight").desc(), "first"))
    return sums.withColumn("_r", best).filter("_r = 1").select(*PAGE, F.when(F.col("weight") > 0, F.col("body_size")).otherwise(10.0).alias("body_size"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """0 where nothing has weight."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.lit(0.0)).alias("mean"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which half of the weight is reached; weights are 0.01 at least."""
    rows = rows.withColumn("_w", F.greatest(F.col(weight), F.lit(0.01)))
    per = rows.groupBy(*keys, value).agg(F.sum("_w").alias("_w"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_w").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum("_w").over(group) / 2
    return per.withColumn("_u", upto).withColumn("_h", half).filter("_u >= _h").groupBy(*keys).agg(F.min(value).alias("median"))


def line_pitch(lines: DataFrame) -> DataFrame:
    """The median of the positive gaps between a page's lines."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy(*PAGE).orderBy("y", "run_no"))
    return lines.withColumn("gap", gap).filter("gap > 0").groupBy(*PAGE).agg(F.expr("percentile(gap, 0.5)").alias("pitch"))


def line_relations(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``lines(doc_id, page_index, line_no, x0, x1, baseline, font_size, family, pitch, end)`` to each
    line's relation to the one before: gap, shifts, shared alignment and how likely it goes on."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    b = lines
    for c in ("line_no", "x0", "x1", "baseline", "font_size", "family"):
        b = b.withColumn(f"p_{c}", F.lag(c).over(order))
    b = b.filter("p_line_no IS NOT NULL")
    gap = F.col("baseline") - F.col("p_baseline")
    ratio = gap / F.greatest(F.lit(0.1), F.col("pitch"))
    near = lambda x, y: F.abs(x - y) <= tolerance
    shared = (
        F.when(near(F.col("x0"), F.col("p_x0")), "left")
        .when(near(F.col("x1"), F.col("p_x1")), "right")
        .when(near((F.col("x0") + F.col("x1")) / 2, (F.col("p_x0") + F.col("p_x1")) / 2), "center")
        .otherwise("none")
    )
    same = (F.abs(F.col("font_size") / F.greatest(F.col("p_font_size"), F.lit(0.1)) - 1) <= 0.06) & (F.col("family") == F.col("p_family"))
    size = F.greatest("font_size", "p_font_size", F.lit(1.0))
    short = F.col("p_x1") < F.col("end") - F.greatest(size * 2, F.lit(12.0))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    b = b.withColumn("gap_ratio", ratio).withColumn("shared", shared).withColumn("same", same).withColumn("short", F.coalesce(short, F.lit(False)))
    score = (
        0.5 * unit((1.8 - F.col("gap_ratio")) / 0.8)
        + 0.2 * F.when(F.col("shared") == "none", 0.25).otherwise(1.0)
        + 0.2 * F.when(F.col("same"), 1.0).otherwise(0.3)
        + 0.1 * F.when(F.col("short"), 0.0).otherwise(1.0)
    )
    return b.select(*PAGE, "line_no", "gap_ratio", (F.col("x0") - F.col("p_x0")).alias("indent_delta"), (F.col("x1") - F.col("p_x1")).alias("right_delta"),
                    F.col("shared").alias("shared_alignment"), F.col("same").alias("same_typography"), unit(score).alias("continuation"))


def repeated_furniture(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs(doc_id, page_index, para_id, role, text, font_size, y, height, page_height,
    median_size)`` to those in the top or bottom band whose text, digits aside, repeats on enough pages:
    two of two, else 35 % and two at least."""
    pages = paragraphs.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages"))
    middle = F.col("y") + F.col("height") / 2
    band = (
        F.when(F.col("role").isin("header", "footer"), F.col("role"))
        .when(middle < F.col("page_height") * 0.12, "header")
        .when(middle > F.col("page_height") * 0.88, "footer")
    )
    found = (
        paragraphs.filter((F.col("role") != "table-cell") & (F.length("text") <= 200) & (F.col("font_size") <= F.col("median_size") * 1.25))
        .withColumn("band", band)
        .filter(F.col("band").isNotNull() & (is_page_number(F.col("text")) | (F.length(F.trim("text")) >= 3)))
        .withColumn("key", furniture_key(F.col("text")))
    )
    seen = found.groupBy("doc_id", "band", "key").agg(F.count_distinct("page_index").alias("on_pages")).join(pages, "doc_id")
    needed = F.when(F.col("pages") <= 2, 2).otherwise(F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.35)))
    keys = seen.filter((F.col("pages") >= 2) & (F.col("on_pages") >= needed)).select("doc_id", "band", "key")
    return found.join(keys, ["doc_id", "band", "key"]).select("doc_id", "page_index", "para_id", "band", "key")


def cross_page_links(paragraphs: DataFrame) -> DataFrame:
    """A page's last body paragraph that goes on in the next page's first."""
    body = paragraphs.filter("role = 'body'").withColumn("text", squeezed(F.col("text")))
    row = F.struct("text", "font_family", "font_size", "para_id")
    ends = body.groupBy(*PAGE).agg(F.max_by(row, "para_id").alias("last"), F.min_by(row, "para_id").alias("first"))
    after = ends.select("doc_id", (F.col("page_index") - 1).alias("page_index"), F.col("first").alias("next"))
    ratio = F.col("next.font_size") / F.greatest(F.col("last.font_size"), F.lit(0.1))
    open_ = ~F.regexp_like("last.text", F.lit(r"""[.!?:;]["'”’)\]]?\z""")) & F.regexp_like("next.text", F.lit(r"^([,;:)\]}”’]|[a-z])"))
    both = ends.join(after, PAGE).filter(open_ & (F.length("last.text") > 0) & (F.col("last.font_family") == F.col("next.font_family")) & (ratio >= 0.9) & (ratio <= 1.1))
    return both.select("doc_id", "page_index", F.col("last.para_id").alias("from_para"), F.col("next.para_id").alias("to_para"),
                       F.when(F.regexp_like("next.text", F.lit("^[a-z]")), 0.92).otherwise(0.85).alias("confidence"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """``blocks(doc_id, page_index, block_id, kind, column_index, x, y)``: headers, then the body, where
    a spanning block (column -1) follows all that begins above it, then footers."""
    spans = blocks.filter("column_index < 0 AND kind NOT IN ('header', 'footer')").groupBy(*PAGE).agg(F.array_sort(F.collect_list("y")).alias("spans"))
    b = blocks.join(spans, PAGE, "left")
    band = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "footer", 2).otherwise(1)
    body = (F.col("column_index") >= 0) & (band == 1)
    # The first span that a column block begins above; a span comes after the blocks of its own step.
    step = F.when(body, F.size(F.filter(F.coalesce("spans", F.array().cast("array<double>")), lambda s: s - 1 <= F.col("y")))).when(
        band == 1, F.array_position("spans", F.col("y")) - 1
    )
    order = Window.partitionBy(*PAGE).orderBy("band", "step", F.when(body, 0).otherwise(1), "column_index", "y", "x", "block_id")
    return b.withColumn("band", band).withColumn("step", F.coalesce(step, F.lit(0))).select(*PAGE, "block_id", F.row_number().over(order).alias("place"))


def coverage(boxes: DataFrame, step: int = 8) -> DataFrame:
    """``boxes(doc_id, page_index, x, y, width, height, page_w, page_h)``: the part of each page's area
    in grid cells that a box touches. A row of cells is a set of intervals, whose union a running maximum
    gives; a page is shuffled once."""
    last = lambda a, n: F.floor((F.col(a) + F.greatest(F.col(n), F.lit(0.0))) / step)
    rows = boxes.select(
        *PAGE, (F.col("page_w") * F.col("page_h")).alias("page_area"), F.floor(F.col("x") / step).alias("first"), last("x", "width").alias("last"),
        F.explode(F.sequence(F.floor(F.col("y") / step), last("y", "height"))).alias("row"),
    )
    before = Window.partitionBy(*PAGE, "row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max("last").over(before), F.col("first") - 1), F.col("first") - 1)
    rows = rows.repartition(*PAGE).withColumn("new", F.greatest(F.col("last") - reached, F.lit(0)))
    return rows.groupBy(*PAGE).agg(F.least(F.sum("new") * step * step / F.max("page_area"), F.lit(1.0)).alias("coverage"))


def cleaned_runs(runs: DataFrame, longest: int = 120) -> DataFrame:
    text = squeezed(F.regexp_replace("text", CONTROLS, " "))
    return runs.withColumn("text", text).filter((F.length("text") >= 2) & (F.length("text") <= longest) & (F.col("font_size") > 0)).withColumn("key", F.lower("text"))


def suggest_bookmarks(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """A heading of each page, or, in documents without any, each page's first line; lines that repeat
    on half of the pages and page numbers don't count, and repeats in a row are one.
    ``runs(doc_id, page_index, text, font_size, x, y, bold)``, ``pages(doc_id, page_index)``. Both are dealt by
    document once; the rest is windows within it."""
    runs = cleaned_runs(runs).filter("doc_id IS NOT NULL").select(*PAGE, "text", "key", "font_size", "x", "y", "bold", F.lit(True).alias("is_run"))
    r = runs.unionByName(pages.select(*PAGE, F.lit(False).alias("is_run")), allowMissingColumns=True).repartition("doc_id")
    doc, page, line = Window.partitionBy("doc_id"), Window.partitionBy(*PAGE), Window.partitionBy("doc_id", "key")
    new = lambda w: (F.col("is_run") & (F.row_number().over(w) == 1)).cast("int")
    r = r.withColumn("new_line", new(Window.partitionBy("doc_id", "key", "page_index").orderBy("y"))).withColumn("new_page", new(page.orderBy(F.desc("is_run"))))
    r = r.withColumn("half", F.when(F.col("is_run"), F.floor(F.col("font_size") * 2 + 0.5) / 2)).withColumn("n", F.count("half").over(Window.partitionBy("doc_id", "half")))
    # The commonest size; of equally common ones the smaller.
    r = r.withColumn("body_size", F.max_by("half", F.when(F.col("is_run"), F.struct("n", -F.col("half")))).over(doc)).withColumn("with_text", F.sum("new_page").over(doc))
    r = r.withColumn("on", F.sum("new_line").over(line)).withColumn("largest", F.max("font_size").over(line))
    repeated = F.expr("on >= greatest(3, ceil(with_text * 0.5)) AND largest <= body_size * 1.2 + 0.01")
    large = F.expr("font_size >= body_size * 1.15 - 0.01 OR (bold AND font_size >= body_size - 0.01)")
    r = r.withColumn("kept", F.col("is_run") & ~is_page_number(F.col("text"), ranges=True) & ~repeated).drop("key", "half", "n", "with_text", "on", "largest", "new_line", "new_page")
    r = r.withColumn("head", F.col("kept") & F.coalesce(large, F.lit(False)))
    first = F.row_number().over(page.orderBy(F.desc("kept"), "y", "x"))
    best = F.row_number().over(page.orderBy(F.desc("head"), F.desc("font_size"), "y", "x"))
    r = r.withColumn("first", first).withColumn("best", best).withColumn("title", F.max(F.when(F.col("kept") & (F.col("first") == 1), F.col("text"))).over(page))
    r = r.withColumn("has_heads", F.max(F.coalesce("head", F.lit(False))).over(doc))
    plain = F.coalesce("title", F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string")))
    picks = r.filter("(head AND best = 1) OR (NOT is_run AND NOT has_heads)").select(*PAGE, F.when(F.col("is_run"), F.col("text")).otherwise(plain).alias("title"))
    before = F.lag(F.lower("title")).over(doc.orderBy("page_index"))
    return picks.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.lower("title"))).drop("_b")


def role_counts(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.85, "high").when(x >= 0.65, "medium").otherwise("low")


def paragraph_alignment(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """``lines(para_id, line_no, x0, x1, font_size, left, right)`` to each paragraph's alignment."""
    centre = F.abs((F.col("x0") - F.col("left")) - (F.col("right") - F.col("x1"))) <= tolerance
    inset = F.col("x0") - F.col("left") > tolerance
    line = F.when(inset & centre, "center").when(inset & (F.col("right") - F.col("x1") <= tolerance), "right").otherwise("left")
    last = F.max("line_no").over(Window.partitionBy("para_id"))
    size = F.greatest("font_size", F.lit(1.0)) * 1.6
    fills = (F.col("x0") - F.col("left") <= size) & (F.col("right") - F.col("x1") <= size)
    sums = lines.withColumn("line", line).withColumn("inner", F.col("line_no") < last).groupBy("para_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line") == "center").alias("c"), F.count_if(F.col("line") == "right").alias("r"),
        F.coalesce(F.bool_and(F.when(F.col("inner"), fills)), F.lit(False)).alias("full"),
    )
    most = F.greatest(F.lit(1.0), F.col("n") * 0.6)
    return sums.select("para_id", F.when(F.col("c") >= most, "center").when(F.col("r") >= most, "right").when((F.col("n") >= 2) & F.col("full"), "justify").otherwise("left").alias("alignment"))


def words(glyphs: DataFrame) -> DataFrame:
    """``glyphs(doc_id, page_index, glyph_no, text, x, width, font_size)`` to words: a break at white
    space and where a gap exceeds 18 % of the size and 1.2 points."""
    order = Window.partitionBy(*PAGE).orderBy("glyph_no")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    space = F.regexp_like("text", F.lit(r"(?U)^\s*$"))
    new = space | F.coalesce(gap > F.greatest(F.lit(1.2), F.col("font_size") * 0.18), F.lit(True)) | F.coalesce(F.lag(space).over(order), F.lit(True))
    marked = glyphs.withColumn("space", space).withColumn("word_no", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.filter("NOT space").groupBy(*PAGE, "word_no").agg(
        F.array_sort(F.collect_list(F.struct("glyph_no", "text"))).alias("g"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1")
    )
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_no"))
    return out.select(*PAGE, number.alias("word_no"), F.array_join(F.transform("g", lambda x: x["text"]), "").alias("text"), "x0", "x1")


def cluster_runs(items: DataFrame) -> DataFrame:
    """``items(doc_id, page_index, line, text, x, y, width, height, font_size)`` to runs: an item joins the
    run before it when it overlaps the run's grown box by 60 % in height and stands within 80 % of a size.
    Each comparison is with what the last ones made, so a page is folded in one pandas function."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for item in rows[rows["text"].str.len() > 0].sort_values(["line", "x", "item_no"]).to_dict("records"):
            run = out[-1] if out else None
            if run:
                shared = min(run["y"] + run["height"], item["y"] + item["height"]) - max(run["y"], item["y"])
                gap = max(run["x"], item["x"]) - min(run["x"] + run["width"], item["x"] + item["width"])
                size = min(run["font_size"], item["font_size"])
                if shared >= 0.6 * min(run["height"], item["height"]) and max(0, gap) <= 0.8 * size:
                    tight = item["x"] - (run["x"] + run["width"]) <= 0.15 * size
                    right, bottom = max(run["x"] + run["width"], item["x"] + item["width"]), max(run["y"] + run["height"], item["y"] + item["height"])
                    run["text"] += ("" if tight else " ") + item["text"]
                    run["x"], run["y"] = min(run["x"], item["x"]), min(run["y"], item["y"])
                    run["width"], run["height"] = right - run["x"], bottom - run["y"]
                    continue
            out.append(item)
        columns = ["doc_id", "page_index", "text", "x", "y", "width", "height", "font_size"]
        frame = pd.DataFrame(out, columns=[*columns, "line", "item_no"])[columns]
        frame.insert(2, "run_no", range(len(frame)))
        return frame

    return items.groupBy(*PAGE).applyInPandas(fold, "doc_id long, page_index int, run_no int, text string, x double, y double, width double, height double, font_size double")


def wrap(texts: DataFrame, width: int) -> DataFrame:
    """``texts(id, text)`` of monospaced characters to lines: words by the line, longer ones cut."""
    state = "struct<out:array<string>,line:string>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("line"))

    def add(s: Column, word: Column) -> Column:
        joined = F.when(s["line"] == "", word).otherwise(F.concat(s["line"], F.lit(" "), word))
        return F.when(F.length(joined) <= width, F.struct(s["out"].alias("out"), joined.alias("line"))).otherwise(
            F.struct(F.when(s["line"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["line"]))).alias("out"), word.alias("line"))
        )

    # A word that is too long stands as pieces of a full line each.
    pieces = F.flatten(F.transform(F.split(F.trim(F.regexp_replace("text", SPACE, " ")), " "), lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(w) / width).cast("int") - 1, F.lit(0))), lambda i: F.substring(w, i * width + 1, F.lit(width)))))
    lines = F.aggregate(pieces, start.cast(state), add, lambda s: F.concat(s["out"], F.array(s["line"])))
    return texts.select("id", F.posexplode(lines).alias("line_no", "line"))


#: Footnote marks, caption labels, characters that take no space before or after them.
FOOTNOTE = r"^\s*(\d{1,3}|[*†‡§¶]|\[\d{1,3}\])\s+\S"
CAPTION = r"^(?i)(fig(ure)?|tab(le)?|exhibit|chart|diagram)\s*(\d{1,3}|[ivxlcdm]{1,6}|[a-z](?=[.:)\-–—]))\s*([.:)\-–—]|\s)"
CAPTION_LEAD = r"^(?i)(source|note|notes)\s*:"
CJK = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]"
NO_SPACE_BEFORE, NO_SPACE_AFTER = r"""^[.,;:!?)\]}%'"”’]""", r"""[(\[{'"“‘/\-]\z"""


def line_roles(lines: DataFrame, band: float = 0.085) -> DataFrame:
    """``lines(…, text, font_size, bold, y, height, body_size, page_height)`` with ``role``, the first of:
    page number near an end of the page, footnote, header, footer, heading, list item, caption, body."""
    from leafspark.functions.text import list_marker

    text = F.trim("text")
    ratio = F.greatest("font_size", F.lit(0.1)) / F.greatest("body_size", F.lit(0.1))
    at = (F.col("y") + F.col("height") / 2) / F.col("page_height")
    letters, upper = F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    share = F.when(letters >= 3, upper / letters).otherwise(0.0)
    n_words = F.size(F.split(text, SPACE))
    open_end = ~F.regexp_like(text, F.lit(r"[.!?,;]\z"))
    bold = F.col("bold") & (ratio >= 0.95) & (F.length(text) <= 80) & open_end & ((share >= 0.7) | (n_words <= 8))
    shout = (share >= 0.85) & (letters >= 4) & (F.length(text) <= 60) & open_end & (n_words <= 10)
    role = (
        F.when(text == "", "unknown")
        .when(is_page_number(text) & (at < 0.2), "header")
        .when(is_page_number(text) & (at > 0.8), "footer")
        .when(F.regexp_like(text, F.lit(FOOTNOTE)) & (ratio <= 0.92) & (at > 0.6) & (F.length(text) >= 12), "footnote")
        .when((ratio <= 1.1) & (at < band), "header")
        .when((ratio <= 1.1) & (at > 1 - band), "footer")
        .when((ratio >= 1.16) | bold | shout, "heading")
        .when(list_marker(text).isNotNull(), "list-item")
        .when((ratio <= 1.05) & (F.regexp_like(text, F.lit(CAPTION)) | F.regexp_like(text, F.lit(CAPTION_LEAD))) & (F.length(text) <= 240), "caption")
        .otherwise("body")
    )
    return lines.withColumn("role", role)


def column_bounds(lines: DataFrame) -> DataFrame:
    """``lines(doc_id, page_index, column_index, role, x0, x1)`` to each column's edges and the median of its
    lines' ends; headers and footers don't count."""
    body = lines.filter("role NOT IN ('header', 'footer')")
    return body.groupBy(*PAGE, "column_index").agg(F.min("x0").alias("left_"), F.max("x1").alias("right_"), F.expr("percentile(x1, 0.5)").alias("typical_end"))


def joined_words(parts: Column) -> Column:
    """An array of words to one text: no space at brackets, closing marks, slashes, hyphens or CJK."""
    words = F.filter(parts, lambda p: p != "")
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))

    def spaced(last: Column, word: Column) -> Column:
        tight = (
            F.regexp_like(word, F.lit(NO_SPACE_BEFORE)) | F.regexp_like(last, F.lit(NO_SPACE_AFTER))
            | F.regexp_like(last, F.lit(CJK + r"\z")) | F.regexp_like(word, F.lit("^" + CJK))
        )
        return F.when((last == "") | tight, word).otherwise(F.concat(F.lit(" "), word))

    return F.array_join(F.zip_with(before, words, spaced), "")


def separator(a: Column, b: Column) -> Column:
    """What stands between two lines of a paragraph: nothing after a hyphen, beside CJK or at an empty line."""
    a, b = F.rtrim(a), F.ltrim(b)
    tight = (a == "") | (b == "") | F.endswith(a, F.lit("-")) | F.regexp_like(a, F.lit(CJK + r"\z")) | F.regexp_like(b, F.lit("^" + CJK))
    return F.when(tight, "").otherwise(" ")
