"""From marks on a page to rows, fragments, columns, tables and lines.

A mark is a piece of text with a box: doc_id, page_index, mark (its number on the page), item (the text
object it comes from), text, x, y, width, height (box, y down), bx, by (middle of the base line),
rotation in degrees, font_size, family, bold, italic. Marks of one direction, in steps of five degrees,
make a family of rows; ``a0, a1`` are its extents along the direction, ``c0, c1`` across, ``cross`` is the
base line's place across.

Rows, corridors and tables are ordered folds with a state of a few numbers; everything else is windows and sums
within a page. Marks come as rows, which are dealt by page once, or gathered, a row a page with ``marks``, an array of
them, which are not dealt anew. Up to fragments and their columns a page's marks are arrays of one row; what
follows is windows over fragments. No step names a dealing, so those of the source last. A page's marks are the
most that one key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafspark.operators.folds import bound, dealt, exploded, folded, runs
from leafspark.operators.layout import joined_words

PAGE = ["doc_id", "page_index"]
#: The marks of one page and direction.
FAMILY = [*PAGE, "bucket"]
#: A leader is four dots; a form has five, on 3 % of twenty lines or more.
LEADER, FORM_LINES, FORM_LEADERS, FORM_SHARE = r"\.(?:\s*\.){3,}", 20, 5, 0.03
#: Corridors need three rows and a quarter of the page; a page has four columns at most.
GUTTER_ROWS, GUTTER_SPAN, MOST_COLUMNS = 3, 0.25, 4
#: A mark as fragments and lines carry it.
MARK = ("a0", "mark", "text", "x", "y", "width", "height", "font_size", "family", "bold", "italic")


def rotation_bucket(rotation: Column) -> Column:
    return F.pmod(F.floor(rotation / 5 + 0.5) * 5, F.lit(360)).cast("int")


def projected(marks: DataFrame) -> DataFrame:
    """Marks with their direction and extents; those without text or size go."""
    rad = F.radians(F.col("bucket").cast("double"))
    m = marks.filter((F.length("text") > 0) & (F.col("font_size") > 0)).withColumn("bucket", rotation_bucket(F.col("rotation")))
    m = m.withColumn("_c", F.cos(rad)).withColumn("_s", F.sin(rad))
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    corners = [(x, y) for y in (F.col("y"), bottom) for x in (F.col("x"), right)]
    along = [x * F.col("_c") + y * F.col("_s") for x, y in corners]
    across = [y * F.col("_c") - x * F.col("_s") for x, y in corners]
    m = m.withColumn("a0", F.least(*along)).withColumn("a1", F.greatest(*along)).withColumn("c0", F.least(*across)).withColumn("c1", F.greatest(*across))
    return m.withColumn("cross", F.col("by") * F.col("_c") - F.col("bx") * F.col("_s")).drop("_c", "_s")


def _joins(row: Column, m: Column, tolerance: Column) -> Column:
    """Whether mark ``m`` stays in the moving row: its base line is near the mean or its band shares 45 % of the
    thinner one's."""
    thin = F.least(m["c1"] - m["c0"], row["high"] - row["low"])
    shared = F.greatest(F.lit(0.0), F.least(m["c1"], row["high"]) - F.greatest(m["c0"], row["low"]))
    return (F.abs(m["cross"] - row["mean"]) <= tolerance) | F.when(thin > 0, shared / thin >= 0.45).otherwise(False)


def _row_numbers(marks: Column, tolerance: Column) -> Column:
    """The row of each of a family's marks in order: a fold whose state is the moving row, that is its number, mean
    base line, extents and size."""
    state = lambda row, mean, low, high, n, rows: F.struct(row.alias("row"), mean.alias("mean"), low.alias("low"), high.alias("high"), n.alias("n"), rows.alias("rows"))
    none, zero = F.array().cast("array<int>"), F.lit(0.0)

    def step(s: Column, m: Column) -> Column:
        with_next = lambda row: F.concat(s["rows"], F.array(row))
        new = s["row"] + 1
        mean = (s["mean"] * s["n"] + m["cross"]) / (s["n"] + 1)
        joined = state(s["row"], mean, F.least(s["low"], m["c0"]), F.greatest(s["high"], m["c1"]), s["n"] + 1, with_next(s["row"]))
        return F.when((s["n"] > 0) & _joins(s, m, tolerance), joined).otherwise(state(new, m["cross"], m["c0"], m["c1"], F.lit(1), with_next(new)))

    return F.aggregate(marks, state(F.lit(-1), zero, zero, zero, F.lit(0), none), step, lambda s: s["rows"])


def rows(marks: DataFrame) -> DataFrame:
    """Projected marks with the ``median_size`` of their family and their ``row``, from 0 in reading direction. They stay
    dealt by page, so what follows on a page's marks needs no shuffle."""
    m = projected(marks.repartition(*PAGE))
    rest = [c for c in m.columns if c not in (*FAMILY, "cross", "a0", "mark")]
    whole = m.groupBy(*FAMILY).agg(
        F.greatest(F.percentile("font_size", F.lit(0.5)), F.lit(1.0)).alias("median_size"), F.array_sort(F.collect_list(F.struct("cross", "a0", "mark", *rest))).alias("m")
    )
    numbers = _row_numbers(F.transform("m", lambda x: F.struct(x["cross"].alias("cross"), x["c0"].alias("c0"), x["c1"].alias("c1"))), F.greatest(F.lit(1.2), F.col("median_size") * 0.2))
    flat = whole.withColumn("rows", numbers).select(*FAMILY, "median_size", F.explode(F.arrays_zip(F.col("m"), F.col("rows").alias("row"))).alias("z"))
    return flat.select(*FAMILY, "median_size", "z.m.*", "z.row")


#: What fragments are cut by and made of.
CUT = ("row", "a0", "cross", "mark", "a1", "c0", "c1", "item", "text", "x", "y", "width", "height", "font_size", "family", "bold", "italic")


def _families(pages: DataFrame) -> DataFrame:
    """Gathered marks, as ``rows`` gives those that come as rows: a row a family, its ``median_size`` and ``m``, its marks
    with their rows."""
    usable = F.filter("marks", lambda m: (F.length(m["text"]) > 0) & (m["font_size"] > 0))
    turned = F.transform(usable, lambda m: F.struct(rotation_bucket(m["rotation"]).alias("bucket"), m.alias("m")))
    kinds = lambda t: F.transform(F.array_distinct(F.transform(t, lambda x: x["bucket"])), lambda b: F.struct(b.alias("bucket"), F.filter(t, lambda x: x["bucket"] == b).alias("t")))
    f = pages.select(*PAGE, F.explode(bound(turned, kinds)).alias("k")).select(*PAGE, "k.bucket", "k.t")
    rad = F.radians(F.col("bucket").cast("double"))

    def spun(m: Column, c: Column, s: Column) -> Column:
        right, bottom = m["x"] + m["width"], m["y"] + m["height"]
        corners = [(x, y) for y in (m["y"], bottom) for x in (m["x"], right)]
        along, across = [x * c + y * s for x, y in corners], [y * c - x * s for x, y in corners]
        made = {"cross": m["by"] * c - m["bx"] * s, "a0": F.least(*along), "mark": m["mark"], "a1": F.greatest(*along), "c0": F.least(*across), "c1": F.greatest(*across)}
        return F.struct(*(v.alias(k) for k, v in made.items()), *(m[c].alias(c) for c in CUT if c not in made and c != "row"))

    f = f.select(*FAMILY, bound(F.struct(F.cos(rad).alias("c"), F.sin(rad).alias("s"), F.col("t").alias("t")), lambda v: F.array_sort(F.transform(v["t"], lambda x: spun(x["m"], v["c"], v["s"])))).alias("m"))
    sizes = F.array_sort(F.transform("m", lambda x: x["font_size"]))
    middle = bound(sizes, lambda z: F.get(z, F.floor((F.size(z) - 1) / 2).cast("int")) * 0.5 + F.get(z, F.floor(F.size(z) / 2).cast("int")) * 0.5)
    f = f.withColumn("median_size", F.greatest(middle, F.lit(1.0)))
    numbers = _row_numbers(F.col("m"), F.greatest(F.lit(1.2), F.col("median_size") * 0.2))
    with_row = lambda x, n: F.struct(n.alias("row"), *(x[c].alias(c) for c in CUT if c != "row"))
    return f.select(*FAMILY, "median_size", F.array_sort(F.zip_with("m", numbers, with_row)).alias("m"))


def _cut(families: DataFrame, cell_gap: float) -> DataFrame:
    """Families of marks in rows to ``parts``, their fragments in order."""
    ink = lambda x: F.length(F.trim(x["text"])) > 0
    state = lambda row, item, a1, last, size, out: F.struct(row.alias("row"), item.alias("item"), a1.alias("a1"), last.alias("ink"), size.alias("font_size"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        same = s["row"] == x["row"]
        gap = x["a0"] - F.coalesce(s["ink"], s["a1"])
        limit = F.greatest(F.lit(cell_gap), F.col("median_size") * 0.9, F.greatest(x["font_size"], s["font_size"], F.lit(1.0)) * 1.15)
        new = F.coalesce((x["item"] != s["item"]) | (gap > limit), F.lit(False))
        number = F.when(same, F.element_at(s["out"], -1) + new.cast("int")).otherwise(0)
        return state(x["row"], x["item"], x["a1"], F.when(ink(x), x["a1"]).when(same, s["ink"]), x["font_size"], F.concat(s["out"], F.array(number)))

    none = F.lit(None).cast("double")
    numbers = F.aggregate("m", state(F.lit(-1), F.lit(None).cast("int"), none, none, none, F.array().cast("array<int>")), step, lambda s: s["out"])
    numbered = F.filter(F.zip_with("m", numbers, lambda x, n: F.struct(n.alias("fragment"), x.alias("m"))), lambda z: ink(z["m"]))

    def part(r: Column) -> Column:
        of = lambda c: F.transform(r, lambda z: z["m"][c])
        total = F.aggregate(of("cross"), F.lit(0.0), lambda a, x: a + x)
        marks = F.array_sort(F.transform(r, lambda z: F.struct(*(z["m"][c].alias(c) for c in MARK))))
        first = F.get(r, F.lit(0))
        return F.struct(
            first["m"]["row"].alias("row"), first["fragment"].alias("fragment"), F.array_min(of("a0")).alias("a0"), F.array_max(of("a1")).alias("a1"), (total / F.size(r)).alias("cross"),
            F.array_min(of("c0")).alias("c0"), F.array_max(of("c1")).alias("c1"), total.alias("cross_sum"), marks.alias("marks"),
        )

    key = lambda z: F.struct(z["m"]["row"].alias("row"), z["fragment"].alias("fragment"))
    return families.select(*FAMILY, "median_size", F.transform(runs(numbered, key), part).alias("parts"))


def flat(families: DataFrame, *more: str) -> DataFrame:
    """Families to their fragments, a row each."""
    return families.select(*FAMILY, "median_size", *more, exploded("parts").alias("p")).select(*FAMILY, "median_size", *more, "p.*")


def family_parts(marks: DataFrame, cell_gap: float = 4.0) -> DataFrame:
    """Marks, as rows or gathered, to families: ``median_size`` and ``parts``, their fragments."""
    if "marks" in marks.columns:
        return _cut(_families(marks), cell_gap)
    whole = rows(marks).groupBy(*FAMILY).agg(F.max("median_size").alias("median_size"), F.array_sort(F.collect_list(F.struct(*CUT))).alias("m"))
    return _cut(whole, cell_gap)


def fragments(rows_: DataFrame, cell_gap: float = 4.0) -> DataFrame:
    """Rows cut where the text object changes or the gap to the last ink exceeds the cell gap; fragments
    without ink go. One row each: extents, mean base line and the sum it is of, and its marks in order."""
    return flat(_cut(rows_.groupBy(*FAMILY).agg(F.max("median_size").alias("median_size"), F.array_sort(F.collect_list(F.struct(*CUT))).alias("m")), cell_gap))


#: What columns are told by, of each fragment; ``packed`` is its text.
SLIM = ("row", "a0", "fragment", "a1", "cross", "packed")


def _slim(parts: Column) -> Column:
    """An array of fragments in rows: an array of arrays, for each in order what columns need."""
    slim = F.transform(parts, lambda p: F.struct(*(p[c].alias(c) for c in SLIM[:-1]), F.array_join(F.transform(p["marks"], lambda m: m["text"]), "").alias("packed")))
    return runs(F.array_sort(slim), lambda p: p["row"])


def _gathered(parts: DataFrame) -> DataFrame:
    """Fragments to families, with ``lines`` as ``_slim`` gives them."""
    packed = F.array_join(F.transform("marks", lambda m: m["text"]), "").alias("packed")
    slim = F.array_sort(F.collect_list(F.struct(*SLIM[:-1], packed))).alias("s")
    return parts.groupBy(*FAMILY).agg(F.max("median_size").alias("median_size"), slim).select(*FAMILY, "median_size", runs(F.col("s"), lambda p: p["row"]).alias("lines"))


def _is_form(lines: Column) -> Column:
    """Whether rows look like a form: dot leaders on enough of them."""
    texts = F.filter(F.transform(lines, lambda r: F.trim(F.array_join(F.transform(r, lambda p: p["packed"]), " "))), lambda t: F.length(t) > 0)
    leaders = lambda t: F.size(F.filter(t, lambda x: F.regexp_like(x, F.lit(LEADER))))
    return bound(texts, lambda t: (F.size(t) >= FORM_LINES) & (leaders(t) >= F.greatest(F.lit(FORM_LEADERS), F.ceil(F.size(t) * FORM_SHARE))))


def form_pages(parts: DataFrame) -> DataFrame:
    """The families of rows that look like a form."""
    return _gathered(parts).filter(_is_form(F.col("lines"))).select(*FAMILY)


def _corridors(gaps: Column, least: Column) -> Column:
    """Gaps in order to corridors: edges shared by all their gaps, extents across, number of gaps. A fold whose state is
    the corridors so far, the last of them open."""
    corridor = lambda l, r, low, high, n: F.struct(l.alias("l"), r.alias("r"), low.alias("low"), high.alias("high"), n.alias("n"))  # noqa: E731, E741

    def step(done: Column, g: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = (g["left"] < last["r"]) & (F.least(last["r"], g["right"]) - F.greatest(last["l"], g["left"]) >= least)
        more = corridor(F.greatest(last["l"], g["left"]), F.least(last["r"], g["right"]), F.least(last["low"], g["cross"]), F.greatest(last["high"], g["cross"]), last["n"] + 1)
        new = corridor(g["left"], g["right"], g["cross"], g["cross"], F.lit(1))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(gaps, F.array().cast("array<struct<l: double, r: double, low: double, high: double, n: int>>"), step)


def _edges(lines: Column, median_size: Column, page_span: float) -> Column:
    """The gutters of a family's rows, see ``gutters``."""
    least = F.greatest(F.lit(6.0), median_size * 0.9)
    gap = lambda p, q: F.struct(p["a1"].alias("left"), q["a0"].alias("right"), q["row"].alias("row"), ((p["cross"] + q["cross"]) / 2).alias("cross"))
    between = lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), gap)
    gaps = F.array_sort(F.filter(F.flatten(F.transform(lines, between)), lambda g: g["right"] - g["left"] >= least))
    wide = F.array_sort(F.filter(_corridors(gaps, least), lambda c: (c["n"] >= GUTTER_ROWS) & (c["high"] - c["low"] >= max(24.0, page_span * GUTTER_SPAN)) & (c["r"] - c["l"] >= least)))
    gutter = lambda l, r, c0, c1, n: F.struct(l.alias("left"), r.alias("right"), c0.alias("c0"), c1.alias("c1"), n.alias("rows"))  # noqa: E731, E741

    def merge(done: Column, c: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        new = gutter(c["l"], c["r"], c["low"], c["high"], c["n"])
        more = gutter(last["left"], F.greatest(last["right"], c["r"]), F.least(last["c0"], c["low"]), F.greatest(last["c1"], c["high"]), F.greatest(last["rows"], c["n"]))
        return F.when(c["l"] <= last["right"] + 2, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(new)))

    merged = F.aggregate(wide, F.array().cast("array<struct<left: double, right: double, c0: double, c1: double, rows: int>>"), merge)
    ranked = F.array_sort(F.transform(merged, lambda g: F.struct((-g["rows"]).alias("a"), (g["left"] - g["right"]).alias("b"), g["left"].alias("c"), g.alias("g"))))
    best = F.transform(F.slice(ranked, F.lit(1), F.lit(MOST_COLUMNS - 1)), lambda k: k["g"])
    return F.array_sort(F.when(_is_form(lines), F.slice(best, F.lit(1), F.lit(0))).otherwise(best))


def gutters(parts: DataFrame, page_span: float = 792.0) -> DataFrame:
    """Corridors of white space that recur in three rows and over a quarter of the page: the families'
    left, right, c0, c1 and rows. Forms have none."""
    families = parts.withColumn("lines", _slim(F.col("parts"))) if "parts" in parts.columns else _gathered(parts)
    return families.select(*FAMILY, F.explode(_edges(F.col("lines"), F.col("median_size"), page_span)).alias("g")).select(*FAMILY, "g.*")


def _column(a0: Column, a1: Column, edges: Column) -> Column:
    # Gutters lie apart and in order, so those left behind come first.
    passed = F.size(F.filter(edges, lambda g: a0 >= g["right"] - 0.75))
    return bound(passed, lambda n: F.when(F.coalesce(a1 <= F.get(edges, n)["left"] + 0.75, F.lit(True)), n).otherwise(-1))


def in_columns(parts: DataFrame, gutters_: DataFrame) -> DataFrame:
    """Fragments with their ``column``; -1 for one that crosses a gutter."""
    edges = gutters_.groupBy(*FAMILY).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("edges"))
    held = F.coalesce("edges", F.array().cast("array<struct<left: double, right: double>>"))
    return parts.join(edges, FAMILY, "left").withColumn("edges", held).withColumn("column", _column(F.col("a0"), F.col("a1"), F.col("edges"))).drop("edges")


def cells(parts: DataFrame) -> DataFrame:
    """Fragments in columns to the cells of rows that may belong to a table: neighbours nearer than a cell
    gap are one cell; a row needs two cells and no dot leader. ``cell`` counts from 0; ``fragments`` lists
    what a cell is made of."""
    leader = F.regexp_like(F.array_join(F.transform("dots", lambda t: t["t"]), ""), F.lit(r"\.{4,}"))
    # Of a text only its dots matter here, and that something stands between them.
    dots = F.regexp_replace(F.array_join(F.transform("marks", lambda m: m["text"]), ""), r"[^.]+", "x")
    form = F.col("form") if "form" in parts.columns else F.lit(False)
    p = parts.select(*FAMILY, "column", "row", "fragment", "a0", "a1", "cross", "median_size", F.size("marks").alias("n"), form.alias("form"), dots.alias("dots"))
    texts = F.array_sort(F.collect_list(F.struct("a0", "fragment", F.col("dots").alias("t"))).over(Window.partitionBy(*FAMILY, "row")))
    p = p.withColumn("dots", texts).filter(~leader & (F.col("column") >= 0)).drop("dots")
    row = [*FAMILY, "column", "row"]
    order = Window.partitionBy(*row).orderBy("a0", "fragment")
    far = F.col("a0") - F.max("a1").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.greatest(F.lit(4.0), F.col("median_size") * 0.55)
    p = p.withColumn("cell", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    c = p.groupBy(*row, "cell").agg(
        F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.sum(F.col("cross") * F.col("n")).alias("_s"), F.sum("n").alias("_n"),
        F.max("median_size").alias("median_size"), F.max("form").alias("form"), F.array_sort(F.collect_set("fragment")).alias("fragments"),
    )
    c = c.withColumn("cross", F.col("_s") / F.col("_n")).drop("_s", "_n")
    return c.withColumn("n_cells", F.count(F.lit(1)).over(Window.partitionBy(*row))).filter("n_cells > 1")


def alignment(a0: float, a1: float, b0: float, b1: float, near: float) -> str | None:
    """The edge that two cells share."""
    if abs(a0 - b0) <= near:
        return "start"
    if abs(a1 - b1) <= near:
        return "end"
    return "center" if abs((a0 + a1) / 2 - (b0 + b1) / 2) <= near else None


def _table_step(state, row: int, cross: float, starts: list, ends: list, size: float):
    """The open table: number, last row, its base line and cells, and for each column the least start and
    greatest end of all rows. A row joins when its cells line up with the last row's and no cell of any
    row reaches into the next column of another."""
    near, window = max(10.0, size * 1.1), max(18.0, size * 3.2)
    number = -1
    if state is not None:
        number, last, at, last_starts, last_ends, least, most = state
        together = (
            row > last and len(starts) == len(last_starts) and abs(cross - at) <= window
            and all(alignment(a, b, c, d, near) for a, b, c, d in zip(last_starts, last_ends, starts, ends, strict=True))
            and all(most[i] <= min(starts[i + 1 :]) + near and ends[i] <= min(least[i + 1 :]) + near for i in range(len(starts) - 1))
        )
        if together:
            modes = [alignment(a, b, c, d, near) for a, b, c, d in zip(last_starts, last_ends, starts, ends, strict=True)]
            state = (number, row, cross, starts, ends, [min(x) for x in zip(least, starts, strict=True)], [max(x) for x in zip(most, ends, strict=True)])
            return state, (number, len(set(modes)))
    return (number + 1, row, cross, starts, ends, starts, ends), (number + 1, 0)


def tables(cells_: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Cells of tables: ``table``, a number within the page's column, ``table_row`` from 0, and ``place``, the
    column of the table: the gutters' means that the cell's middle has passed, each column once a row.
    Two rows make a table when their cells share one kind of edge; forms, told by cells or by ``forms``, need three."""
    row = [*FAMILY, "column", "row"]
    whole = cells_.groupBy(*row).agg(
        F.array_sort(F.collect_list(F.struct("cell", "a0", "a1", "cross", "fragments"))).alias("c"), F.max("median_size").alias("median_size"), F.max("form").alias("form")
    )
    of = lambda name: F.transform("c", lambda x: x[name])
    mean = F.aggregate(of("cross"), F.lit(0.0), lambda a, x: a + x) / F.size("c")
    whole = whole.select(*row, "c", "median_size", "form", mean.alias("cross"), of("a0").alias("starts"), of("a1").alias("ends"))
    runs = folded(whole, [*FAMILY, "column"], ["cross", "row"], ["row", "cross", "starts", "ends", "median_size"], "table int, modes int", _table_step, small=True)
    table = [*FAMILY, "column", "table"]
    group = Window.partitionBy(*table)
    if forms is not None:
        runs = runs.drop("form").join(forms.withColumn("form", F.lit(True)), FAMILY, "left")
    # Few rows are left, and Python doesn't tell how they are dealt.
    runs = dealt(runs).withColumn("rows", F.count(F.lit(1)).over(group)).withColumn("kinds", F.max("modes").over(group))
    least = F.when(F.col("form"), 3).otherwise(2)
    kept = runs.filter((F.col("rows") >= least) & ~((F.col("rows") == 2) & (F.col("kinds") > 1)) & (F.col("rows") * F.size("c") >= 4))
    kept = kept.withColumn("table_row", F.row_number().over(group.orderBy("cross", "row")) - 1)
    flat = kept.select(*table, "row", "table_row", "rows", F.size("c").alias("n_cells"), F.explode("c").alias("c")).select(*table, "row", "table_row", "rows", "n_cells", "c.*")
    mid = (F.col("a1") + F.lead("a0").over(Window.partitionBy(*table, "row").orderBy("cell"))) / 2
    flat = flat.withColumn("mid", mid).withColumn("edge", F.avg("mid").over(Window.partitionBy(*table, "cell")))
    # A table's cells of one place have one mean; the last has none.
    means = F.collect_set(F.when(F.col("edge").isNotNull(), F.struct("cell", "edge"))).over(group)
    flat = flat.withColumn("edges", F.array_sort(F.transform(means, lambda k: k["edge"]))).drop("mid", "edge")
    passed = F.size(F.filter("edges", lambda e: (F.col("a0") + F.col("a1")) / 2 >= e))
    along = Window.partitionBy(*table, "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return flat.withColumn("place", F.col("cell") + F.max(passed - F.col("cell")).over(along)).drop("edges")


def _looks(marks: Column) -> Column:
    """The typographies among ``marks``: where each is seen first, and its number of characters."""
    look = lambda m: F.struct(m["family"].alias("family"), m["font_size"].alias("font_size"), m["bold"].alias("bold"), m["italic"].alias("italic"))
    return F.transform(F.array_distinct(F.transform(marks, look)), lambda k: bound(F.filter(marks, lambda m: look(m) == k), lambda own: F.struct(
        F.get(own, F.lit(0))["a0"].alias("a0"), F.get(own, F.lit(0))["mark"].alias("mark"), F.aggregate(own, F.lit(0), lambda a, m: a + F.length(m["text"])).alias("w"), k.alias("k"))))


def _dominant(looks: Column) -> Column:
    """The typography of most characters, the first one seen of equals."""
    ordered = F.array_sort(looks)
    weights = lambda o: F.transform(F.array_distinct(F.transform(o, lambda x: x["k"])), lambda k, i: F.struct(
        F.aggregate(F.filter(o, lambda x: x["k"] == k), F.lit(0), lambda a, x: a + x["w"]).alias("w"), (-i).alias("i"), k.alias("k")))
    return bound(ordered, lambda o: F.array_max(weights(o)))["k"]


def with_tables(families: DataFrame, tables_: DataFrame) -> DataFrame:
    """Families with ``cells``, what tables have of their fragments. The two meet by document, as both are dealt; by page
    Spark would deal all fragments anew."""
    own = tables_.select(*FAMILY, "row", "table", "table_row", "place", F.explode("fragments").alias("fragment"))
    own = own.groupBy(*FAMILY).agg(F.collect_list(F.struct("row", "fragment", "table", "table_row", "place")).alias("cells"))
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("page_index", "bucket", "cells")).alias("pages"))
    met = families.join(own.hint("shuffle_hash"), "doc_id", "left")
    page = F.filter("pages", lambda x: (x["page_index"] == F.col("page_index")) & (x["bucket"] == F.col("bucket")))
    return met.withColumn("cells", F.get(page, F.lit(0))["cells"]).drop("pages")


def lines(parts: DataFrame) -> DataFrame:
    """Fragments in columns, with the ``cells`` of their family's tables, to lines. Cells of tables are lines of their own. Of the rest, fragments of one
    look that stand near are runs; runs of a row and column are one line unless they stand apart, or overlap
    in sizes that differ by more than half."""
    of_table = ["table", "table_row", "place"]
    of_table = ["table", "table_row", "place"]
    m = F.col("marks")
    head = m[0]
    # Of its marks a fragment carries words in order, looks and the box.
    p = parts.select(
        *FAMILY, "column", "row", "fragment", "a0", "a1", "cross_sum", "median_size", F.size(m).alias("n_words"), F.struct(head["family"], head["font_size"], head["bold"], head["italic"]).alias("look"),
        head["font_size"].alias("size"), F.greatest(F.lit(4.0), F.col("median_size") * 2.5).alias("near"), F.transform(m, lambda k: F.struct(k["a0"].alias("a0"), k["mark"].alias("mark"), k["text"].alias("text"))).alias("words"),
        _looks(m).alias("looks"), F.array_min(F.transform(m, lambda k: k["x"])).alias("x0"), F.array_min(F.transform(m, lambda k: k["y"])).alias("y0"),
        F.array_max(F.transform(m, lambda k: k["x"] + k["width"])).alias("x1"), F.array_max(F.transform(m, lambda k: k["y"] + k["height"])).alias("y1"),
        F.get(F.filter("cells", lambda c: (c["row"] == F.col("row")) & (c["fragment"] == F.col("fragment"))), F.lit(0)).alias("cell"),
    ).select("*", *(F.col("cell")[c].alias(c) for c in of_table), F.col("cell").isNotNull().alias("held")).drop("cell")
    row = [*FAMILY, "column", "row", "held"]
    same = Window.partitionBy(*row, "look").orderBy("a0", "fragment")
    apart = F.col("a0") - F.lag("a1").over(same) > F.col("near")
    p = p.withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    least, most, gathered = ("a0", "x0", "y0"), ("a1", "x1", "y1", "median_size"), ("words", "looks")
    # Sums, not means of means: lines of one row that stand level keep equal base lines, so their order is by a0.
    spans = [
        *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most), *(F.flatten(F.collect_list(c)).alias(c) for c in gathered), F.sum("cross_sum").alias("cross_sum"), F.sum("n_words").alias("n_words"),
    ]
    pieces = p.groupBy(*row, *of_table, "look", "run").agg(*spans, F.min("near").alias("near"), F.min_by("size", F.struct("a0", "fragment")).alias("size"))
    along = Window.partitionBy(*row).orderBy("a0", "look", "run")
    gap, last = F.col("a0") - F.lag("a1").over(along), F.lag("size").over(along)
    unlike = F.greatest("size", last) / F.least("size", last) > 1.5
    cut = (gap > F.col("near")) | ((gap < -F.greatest(F.lit(1.0), F.col("median_size") * 0.4)) & unlike)
    number = F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("line", F.when(F.col("held"), F.col("place")).otherwise(number))
    both = pieces.groupBy(*row, *of_table, "line").agg(*spans).withColumn("look", _dominant(F.col("looks")))
    return both.select(
        *row[:-1], "line", *of_table, joined_words(F.transform(F.array_sort("words"), lambda k: k["text"])).alias("text"), "a0", "a1", (F.col("cross_sum") / F.col("n_words")).alias("baseline"),
        "x0", "y0", "x1", "y1", "look.family", "look.font_size", "look.bold", "look.italic", F.col("n_words").cast("int").alias("n_words"),
    )


def page_families(marks: DataFrame, page_span: float = 792.0) -> DataFrame:
    """Marks to families with their ``parts``, ``edges`` (their gutters) and ``form``."""
    f = family_parts(marks).withColumn("lines", _slim(F.col("parts")))
    return f.select(*FAMILY, "median_size", "parts", _edges(F.col("lines"), F.col("median_size"), page_span).alias("edges"), _is_form(F.col("lines")).alias("form"))


def family_columns(families: DataFrame, *more: str) -> DataFrame:
    """Families to fragments in columns, with ``form`` for the rows of forms."""
    return flat(families, "form", "edges", *more).withColumn("column", _column(F.col("a0"), F.col("a1"), F.col("edges"))).drop("edges")


def page_fragments(marks: DataFrame, page_span: float = 792.0) -> DataFrame:
    """Marks to fragments in columns."""
    return family_columns(page_families(marks, page_span))


def page_lines(marks: DataFrame, page_span: float = 792.0) -> DataFrame:
    """Marks to lines, by all of the steps above."""
    f = page_families(marks, page_span)
    return lines(family_columns(with_tables(f, tables(cells(family_columns(f)))), "cells"))
