"""Page algebra: ordered multisets of pages as rows.

Pages are ``(doc_index, page_index, …)``; order is a column, never the order of rows. Numbering over a
whole collection is by offsets of documents (one row each), not by one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.folds import folded

#: Fixed value: characters of a text to split at.
NEEDLE = 120


def numbered(pages: DataFrame, doc: str, page: str, out: str) -> DataFrame:
    """Pages of all documents in order of document and page, from 0. Within a document a window; across
    documents the running sum of page counts, by ranges of documents so that no task holds them all."""
    counts = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    width = 4096
    counts = counts.withColumn("_range", F.floor(F.col(doc) / width))
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_total"))
    ranges = ranges.withColumn("_base", F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).drop("_total")
    inside = Window.partitionBy("_range").orderBy(doc)
    offsets = counts.withColumn("_upto", F.sum("_n").over(inside) - F.col("_n")).join(ranges, "_range")
    offsets = offsets.select(doc, (F.col("_base") + F.col("_upto")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    return pages.withColumn("_place", place).join(offsets, doc).withColumn(out, F.col("_offset") + F.col("_place")).drop("_place", "_offset")


def select_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages as ``refs(out_pos, doc_index, page_index, rotate)`` names them, repeats included."""
    return refs.join(pages, ["doc_index", "page_index"])


def missing_pages(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """References that name no page; a caller refuses the job if there are any."""
    return refs.join(pages, ["doc_index", "page_index"], "left_anti")


def delete_pages(pages: DataFrame, marks: DataFrame) -> DataFrame:
    return pages.join(marks, ["doc_index", "page_index"], "left_anti")


def interleave(pages: DataFrame, lead: Column, keys: list[str]) -> DataFrame:
    """Pages of the two documents of each key in turn, the one ``lead`` is true for first; what the longer
    one has left follows."""
    order = Window.partitionBy(*keys).orderBy("page_index", F.when(lead, 0).otherwise(1))
    return pages.withColumn("out_pos", F.row_number().over(order) - 1)


def page_ranges(specs: DataFrame) -> DataFrame:
    """``specs(spec, page_count)`` to the pages each names, from 0: parts by comma, semicolon or new
    line; 5, 2-4, 8-, -3, and - for all; ends in either order and clamped to the document."""
    part = F.explode(F.filter(F.transform(F.split("spec", "[,;\n]"), lambda p: F.trim(p)), lambda p: p != ""))
    found = specs.select("spec", "page_count", part.alias("part"))
    first = F.regexp_extract("part", r"^(\d*)\s*(-?)\s*(\d*)$", 1)
    dash = F.regexp_extract("part", r"^(\d*)\s*(-?)\s*(\d*)$", 2)
    last = F.regexp_extract("part", r"^(\d*)\s*(-?)\s*(\d*)$", 3)
    clamp = lambda x: F.least(F.greatest(x, F.lit(1)), F.col("page_count"))
    a = F.coalesce(F.nullif(first, F.lit("")).cast("int"), F.lit(1))
    b = F.when(dash == "", a).otherwise(F.coalesce(F.nullif(last, F.lit("")).cast("int"), F.col("page_count")))
    pages = F.sequence(F.least(clamp(a), clamp(b)) - 1, F.greatest(clamp(a), clamp(b)) - 1)
    return found.select("spec", "page_count", F.explode(pages).alias("page_index")).distinct()


def bad_ranges(specs: DataFrame) -> DataFrame:
    """Parts that are no page, range or open range."""
    part = F.explode(F.filter(F.transform(F.split("spec", "[,;\n]"), lambda p: F.trim(p)), lambda p: p != ""))
    return specs.select("spec", part.alias("part")).filter(~F.regexp_like("part", F.lit(r"^(\d+|\d*\s*-\s*\d*)$")))


def split_by_pages(pages: DataFrame, size: int, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    part = F.floor(F.col(page) / size).cast("int")
    return pages.withColumn("part", part).groupBy(doc, "part").agg(
        F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count(F.lit(1)).alias("n_pages")
    )


def split_by_size(docs: DataFrame, limit: int) -> DataFrame:
    """``docs(doc_id, n_bytes, n_pages)`` to pages a part and parts, by the mean size of a page."""
    a_page = F.ceil(F.col("n_bytes") / F.col("n_pages")).cast("long")
    per_part = F.least(F.greatest(F.floor(F.lit(limit) / a_page), F.lit(1)), F.col("n_pages")).cast("long")
    return docs.withColumn("bytes_per_page", a_page).withColumn("pages_per_part", per_part).withColumn(
        "parts", F.ceil(F.col("n_pages") / F.col("pages_per_part")).cast("long")
    )


def split_by_text(pages: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """A new part at every page with the needle; page 0 always begins one. Documents that stay whole
    don't appear. A needle that is blank or has more than 120 characters raises ValueError."""
    needle = needle.strip()
    if not 0 < len(needle) <= NEEDLE:
        raise ValueError(f"the text to split at needs 1 to {NEEDLE} characters")
    text = F.col("text") if case_sensitive else F.lower("text")
    hit = F.contains(text, F.lit(needle if case_sensitive else needle.lower())) & (F.col("page_index") > 0)
    part = F.sum(hit.cast("int")).over(Window.partitionBy("doc_id").orderBy("page_index"))
    parts = pages.withColumn("part", part).groupBy("doc_id", "part").agg(
        F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.count(F.lit(1)).alias("n_pages")
    )
    return parts.withColumn("n_parts", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("n_parts > 1")


def split_level(outline: DataFrame) -> DataFrame:
    """The shallowest level with more than one entry, else the deepest there is."""
    levels = outline.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("level"))), F.max("level")).alias("level"))


def bookmark_segments(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_count)`` cut at the entries of the split level: the first entry of a page
    counts, and pages before the first entry are front matter."""
    entries = outline.join(split_level(outline), ["doc_id", "level"])
    first = Window.partitionBy("doc_id", "page_index").orderBy("seq")
    entries = entries.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id", "title", "page_index")
    front = entries.groupBy("doc_id").agg(F.min("page_index").alias("m")).filter("m > 0")
    entries = entries.union(front.select("doc_id", F.lit("Front matter").alias("title"), F.lit(0).alias("page_index")))
    after = F.lead("page_index").over(Window.partitionBy("doc_id").orderBy("page_index"))
    cut = entries.join(pages, "doc_id").filter("page_index < page_count")
    return cut.select("doc_id", "title", F.col("page_index").alias("first_page"), F.coalesce(after - 1, F.col("page_count") - 1).alias("last_page"))


GRIDS = {2: (2, 1), 4: (2, 2), 8: (4, 2)}


def n_up(pages: DataFrame, n: int, sheet: tuple[float, float]) -> DataFrame:
    """``pages(doc_id, page_index, width, height)`` to sheet, cell, scale and place; row 0 is at the top."""
    columns, rows = GRIDS[n]
    w, h = sheet[0] / columns, sheet[1] / rows
    cell = F.col("page_index") % n
    column, row = cell % columns, F.floor(cell / columns)
    scale = F.least(F.lit(w) / F.col("width"), F.lit(h) / F.col("height"))
    return pages.select(
        "doc_id",
        "page_index",
        F.floor(F.col("page_index") / n).cast("int").alias("sheet"),
        cell.cast("int").alias("cell"),
        scale.alias("scale"),
        (column * w + (F.lit(w) - F.col("width") * scale) / 2).alias("x"),
        (F.lit(sheet[1]) - (row + 1) * h + (F.lit(h) - F.col("height") * scale) / 2).alias("y"),
    )


def outline_errors(outline: DataFrame) -> DataFrame:
    """Entries that begin below the top or go down by more than one level."""
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("seq"))
    return outline.withColumn("before", before).filter((F.col("before").isNull() & (F.col("level") != 0)) | (F.col("level") > F.col("before") + 1))


def tile_grid(marks: DataFrame, gap: float = 1.35, least: tuple[float, float] = (96.0, 72.0)) -> DataFrame:
    """``marks(id, view_w, view_h, mark_w, mark_h)`` to the centres of a tiling."""
    nx = F.greatest(F.ceil(F.col("view_w") / F.greatest(F.col("mark_w") * gap, F.lit(least[0]))), F.lit(1)).cast("int")
    ny = F.greatest(F.ceil(F.col("view_h") / F.greatest(F.col("mark_h") * gap, F.lit(least[1]))), F.lit(1)).cast("int")
    grid = marks.withColumn("nx", nx).withColumn("ny", ny)
    grid = grid.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    return grid.select(
        "id", "column", "row",
        (F.col("view_w") * (F.col("column") + 0.5) / F.col("nx")).alias("cx"),
        (F.col("view_h") * (F.col("row") + 0.5) / F.col("ny")).alias("cy"),
    )


def _named(given: set | None, name: str):
    given, entry, k = given or set(), name, 2
    dot = name.rfind(".")
    stem, extension = (name[:dot], name[dot:]) if dot > 0 else (name, "")
    while entry in given:
        entry, k = f"{stem}-{k}{extension}", k + 1
    given.add(entry)
    return given, (entry,)


def dedupe_names(names: DataFrame) -> DataFrame:
    """``names(bundle, pos, name)`` with ``entry``: a name met before gets -2, -3 … before its extension,
    skipping those already given. Names are compared as they are. A bundle is one archive, of at most a
    hundred files, whose names are the fold's state."""
    return folded(names.select("bundle", "pos", "name"), ["bundle"], ["pos"], ["name"], "entry string", _named)


def flipped(pages: DataFrame, spec: DataFrame) -> DataFrame:
    """``spec(doc_id, axis 'horizontal' or 'vertical', page_index)`` on ``pages``: which way each page is mirrored, and how
    many of its document are. A null page means all; pages that don't exist are passed over."""
    both = ("horizontal", "vertical")
    flags = lambda name: [F.bool_or(F.col("axis") == axis).alias(f"{name}_{axis}") for axis in both]
    all_ = spec.filter("page_index IS NULL").groupBy("doc_id").agg(*flags("all"))
    some = spec.filter("page_index IS NOT NULL").groupBy("doc_id", "page_index").agg(*flags("some"))
    joined = pages.select("doc_id", "page_index").join(some, ["doc_id", "page_index"], "left").join(all_, "doc_id", "left")
    turned = [(F.coalesce(f"some_{a}", F.lit(False)) | F.coalesce(f"all_{a}", F.lit(False))).alias(a) for a in both]
    out = joined.select("doc_id", "page_index", *turned)
    return out.withColumn("flipped", F.count_if(F.col("horizontal") | F.col("vertical")).over(Window.partitionBy("doc_id")))


def extract_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages whose ``(doc_id, page_index)`` stands in ``wanted``, each once."""
    return pages.join(wanted, ["doc_id", "page_index"], "left_semi")
