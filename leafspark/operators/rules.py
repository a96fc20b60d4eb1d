"""Rules and estimates as columns, pixels, folds of short lists, and matches of layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.functions.geometry import overlap, rounded
from leafspark.operators.folds import folded

#: Limits of jobs (bytes, pages, milliseconds) and of form fields (points).
FILE_BYTES, TOTAL_BYTES, PAGES = 100 * 1024 * 1024, 250 * 1024 * 1024, 500
BASE_MS, LEAST_MS, MOST_MS, PAGE_MS, PAGE_BYTES = 120_000, 15_000, 900_000, 750, 1_500_000
FIELD_NAME, FIELD_CHARS, FONTS = r"^[A-Za-z0-9][A-Za-z0-9 ._-]*\z", 64, (4, 48)
OCR_LEAST = 16


def timeout_ms(pages: Column) -> Column:
    return F.least(F.greatest(BASE_MS + F.greatest(pages - 1, F.lit(0)) * PAGE_MS, F.lit(LEAST_MS)), F.lit(MOST_MS))


def working_set(n_bytes: Column, pages: Column) -> Column:
    return n_bytes + pages * PAGE_BYTES


def capacity(largest: Column, total: Column, pages: Column) -> Column:
    return F.when(largest > FILE_BYTES, "file").when(total > TOTAL_BYTES, "total").when(pages > PAGES, "pages").otherwise("ok")


def metadata_field(value: Column) -> Column:
    """No controls, trimmed, 500 characters; blank is absent."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")), 1, 500), F.lit(""))


def keywords(values: Column) -> Column:
    return F.filter(F.transform(F.slice(values, 1, 50), lambda k: metadata_field(k)), lambda k: k.isNotNull())


def field_errors(name: Column, kind: Column, width: Column, height: Column, size: Column) -> Column:
    """What is wrong with a form field, in order."""
    text = kind == "text"
    return F.array_compact(F.array(
        F.when(~kind.isin("text", "checkbox"), F.lit("type")),
        F.when(~F.regexp_like(name, F.lit(FIELD_NAME)) | (F.length(name) > FIELD_CHARS), F.lit("name")),
        F.when((width < F.when(text, 20).otherwise(8)) | (height < F.when(text, 10).otherwise(8)), F.lit("size")),
        F.when(text & ~size.between(*FONTS), F.lit("font")),
    ))


def hex_channels(colour: Column) -> Column:
    """#rgb or #rrggbb to three numbers; anything else is black."""
    short = F.regexp_like(colour, F.lit(r"^#[0-9a-fA-F]{3}\z"))
    full = F.regexp_like(colour, F.lit(r"^#[0-9a-fA-F]{6}\z"))
    pair = lambda k: F.when(short, F.repeat(F.substring(colour, k + 2, 1), 2)).when(full, F.substring(colour, 2 * k + 2, 2)).otherwise("00")
    return F.array(*(F.conv(pair(k), 16, 10).cast("int") for k in range(3)))


def ocr_route(text: Column) -> Column:
    return F.when(F.length(F.regexp_replace(text, r"(?U)\s", "")) >= OCR_LEAST, "copy").otherwise("recognise")


def layer_kind(objects: DataFrame) -> DataFrame:
    """``objects(doc_id, page_index, render_mode, image)``: a page's text layer, and whether it is a scan."""
    text = ~F.col("image")
    n, hidden, images = F.count_if(text), F.count_if(text & (F.col("render_mode") == 3)), F.count_if(F.col("image"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("hidden") == F.col("n"), "ocr").when(F.col("hidden") > 0, "mixed").otherwise("native")
    sums = objects.groupBy("doc_id", "page_index").agg(n.alias("n"), hidden.alias("hidden"), images.alias("images")).withColumn("layer", kind)
    return sums.select("doc_id", "page_index", "layer", ((F.col("images") > 0) & (F.col("layer") == "none")).alias("scan"))


def role_certainty(role: Column, size: Column, body: Column, bold: Column) -> Column:
    heading = F.when(size / F.greatest(body, F.lit(0.1)) >= 1.16, 0.95).when(bold, 0.85).otherwise(0.7)
    return (
        F.when(role == "heading", heading).when(role == "caption", 0.78).when(role == "footnote", 0.75)
        .when(role.isin("header", "footer"), 0.88).when(role == "list-item", 0.9).when(role == "table-cell", 0.72).otherwise(0.8)
    )


def themed(r: Column, g: Column, b: Column, theme: tuple[int, int, int]) -> tuple[Column, ...]:
    """Ink to white and paper to the theme's colour, by brightness."""
    factor = 1 - (0.299 * r + 0.587 * g + 0.114 * b) / 255
    return tuple(rounded(t + (255 - t) * factor).cast("int") for t in theme)


def lightness_flipped(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """The same hue and saturation with light and dark changed over: with c the colour's spread, each channel
    moves by the same amount, so its distance from the middle of the spread stays."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    middle = (top + low) / 2
    # The spread that the flipped lightness has room for is that of the old one: both leave the same.
    return tuple(F.least(F.greatest(rounded(255 - middle + (x - middle)), F.lit(0)), F.lit(255)).cast("int") for x in (r, g, b))


def skew_angles(ink: DataFrame, width: int, height: int, least: float = -10.0, most: float = 10.0, step: float = 0.5) -> DataFrame:
    """``ink(page, x, y, weight)`` to each page's skew: the angle whose projection on rows varies most, the
    smaller angle of equals. The angles are a fixed short list, so pixels are exploded by them."""
    n = round((most - least) / step)
    angle = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k")
    turned = ink.select("page", "x", "y", "weight", angle).withColumn("deg", F.lit(least) + F.col("k") * step)
    row = (F.col("y") * F.cos(F.radians("deg")) - F.col("x") * F.sin(F.radians("deg"))).cast("int")
    bins = height + 2 * width + 4
    profile = turned.groupBy("page", "deg", row.alias("row")).agg(F.sum("weight").alias("v"))
    # Rows without ink count as zeros.
    mean = F.sum("v") / bins
    spread = profile.groupBy("page", "deg").agg((F.sum(F.col("v") * F.col("v")) / bins - mean * mean).alias("variance"))
    best = F.row_number().over(Window.partitionBy("page").orderBy(F.round(F.col("variance"), 6).desc(), F.abs("deg"), "deg"))
    return spread.withColumn("_r", best).filter("_r = 1").select("page", "deg")


def match_lines(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Boxes ``(page, id, x0, y0, x1, y1)``: each true line's best found line, by shared area, if that is a
    quarter of it, and how much of it all found lines cover."""
    other = found.select("page", *(F.col(c).alias(f"f_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    box, theirs = (tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1")) for p in ("", "f_"))
    area = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    both = truth.join(other, "page").withColumn("shared", overlap(box, theirs)).filter("shared > 0").withColumn("area", area)
    sums = both.groupBy("page", "id").agg(F.max_by("f_id", F.struct("shared", -F.col("f_id"))).alias("best"), (F.max("shared") / F.max("area")).alias("part"), F.least(F.lit(1.0), F.sum("shared") / F.max("area")).alias("covered"))
    return sums.select("page", "id", F.when(F.col("part") >= 0.25, F.col("best")).alias("best"), "covered")


def caret_offsets(points: DataFrame, segments: DataFrame) -> DataFrame:
    """``points(point, line, advance)`` in ``segments(line, n_chars, first, last, a0, a1)`` of a line's words
    to a place among its characters: the nearest word's, in proportion."""
    ends = segments.groupBy("line").agg(F.min("a0").alias("lo"), F.max("a1").alias("hi"), F.max("n_chars").alias("chars"))
    away = F.greatest(F.col("a0") - F.col("advance"), F.col("advance") - F.col("a1"), F.lit(0.0))
    best = F.row_number().over(Window.partitionBy("point").orderBy(away, "a0"))
    near = points.join(segments, "line").withColumn("_r", best).filter("_r = 1").join(ends, "line")
    ratio = F.when(F.col("a1") > F.col("a0"), F.least(F.greatest((F.col("advance") - F.col("a0")) / (F.col("a1") - F.col("a0")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    inside = F.col("first") + rounded(ratio * (F.col("last") - F.col("first")))
    return near.select("point", F.when(F.col("advance") <= F.col("lo"), 0).when(F.col("advance") >= F.col("hi"), F.col("chars")).otherwise(inside).cast("int").alias("offset"))


def _shown(last: float | None, ratio: float):
    if last is not None and last >= 0 and abs(ratio - last) < 0.02 and ratio < 1:
        return last, (False,)
    return ratio, (True,)


def reported(steps: DataFrame) -> DataFrame:
    """``steps(job, pos, ratio)`` to the progress that is shown: not within 0.02 of the last one shown, unless
    done. Each is compared with what was shown and not with the step before."""
    return folded(steps.select("job", "pos", "ratio"), ["job"], ["pos"], ["ratio"], "shown boolean", _shown).filter("shown").drop("shown")


def list_levels(lines: DataFrame, body: float) -> DataFrame:
    """``lines(column_index, line_no, indent)`` of list items to levels 1 to 6: indents, in halves, start a new
    level where they are more than 0.6 of the body size, four points at least, beyond the one before."""
    step = max(4.0, 0.6 * body)
    half = (F.floor(F.col("indent") * 2 + 0.5) / 2).alias("half")
    indents = lines.select("column_index", half).distinct().groupBy("column_index").agg(F.array_sort(F.collect_list("half")).alias("all"))
    centres = F.aggregate("all", F.array().cast("array<double>"), lambda c, x: F.when((F.size(c) == 0) | (x - F.element_at(c, -1) > step), F.concat(c, F.array(x))).otherwise(c))
    level = F.size(F.filter("centres", lambda c: F.col("indent") + 1 >= c))
    return lines.join(indents.withColumn("centres", centres), "column_index").select("column_index", "line_no", F.least(F.greatest(level, F.lit(1)), F.lit(6)).alias("level"))


def _renamed(used: set | None, name: str):
    used, new, k = used or set(), name, 2
    while new in used:
        new, k = f"{name}_{k}", k + 1
    used.add(new)
    return used, (new,)


def field_renames(fields: DataFrame) -> DataFrame:
    """``fields(doc, pos, name)``: a dotted name met before gets _2, _3 … A document's fields, 500 at most, are
    the fold's state."""
    return folded(fields.select("doc", "pos", "name"), ["doc"], ["pos"], ["name"], "renamed string", _renamed)
