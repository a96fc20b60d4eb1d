"""Page structure and edits against brute force on made pages, and on empty and odd ones."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leafspark.operators import edits as E
from leafspark.operators import layout as L
from leafspark.operators import page_blocks as B
from leafspark.operators import page_rows as R
from leafspark.operators.folds import folded
from leafspark.plans import edit_queries as Q
from leafspark.plans import structure_queries as S
from leafspark.sources.typeset import set_marks, set_pages
from tests.conftest import SF_DIR

MARKS = "doc_id long, page_index int, mark int, item int, text string, x double, y double, width double, height double, bx double, by double, rotation double, font_size double, family string, bold boolean, italic boolean"


def mark(doc, n, item, text, x, y, size=10.0, rotation=0.0):
    width = 5.0 * len(text)
    return (doc, 0, n, item, text, float(x), float(y), width, size * 1.25, x + width / 2, y + size * 0.75, rotation, size, "serif", False, False)


def brute_rows(marks):
    """Rows of upright marks as lists of mark numbers."""
    out = []
    for m in sorted(marks, key=lambda m: (m[10], m[5], m[2])):
        low, high, base = m[6], m[6] + m[8], m[10]
        sizes = sorted(k[12] for k in marks)
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        if out:
            r = out[-1]
            share = max(0.0, min(high, r["high"]) - max(low, r["low"])) / min(high - low, r["high"] - r["low"])
            if abs(base - r["base"]) <= max(1.2, max(1.0, middle) * 0.2) or share >= 0.45:
                n = len(r["marks"])
                r.update(base=(r["base"] * n + base) / (n + 1), low=min(low, r["low"]), high=max(high, r["high"]))
                r["marks"].append(m[2])
                continue
        out.append({"base": base, "low": low, "high": high, "marks": [m[2]]})
    return [sorted(r["marks"]) for r in out]


def test_level_lines_of_one_row_have_equal_base_lines(spark):
    """A line of two text objects, the second of eleven words, whose mean of means is next to the mean."""
    offsets = [0.5, 0.5, 1, 0.25, 1, 0.75, 0, 0.25, 0.5, 1, 0.75]
    words = [(0, 72, 0.5), (1, 276, 0.0), (1, 296, 0.0), *((2, 316 + 20 * k, d) for k, d in enumerate(offsets))]
    lines = R.page_lines(spark.createDataFrame([mark(1, n, item, "abc", x, 287.5 + d) for n, (item, x, d) in enumerate(words)], MARKS))
    assert sorted((r.a0, r.n_words, r.baseline) for r in lines.collect()) == [(72.0, 1, 295.5), (276.0, 13, 295.5)]


def test_bookmarks_are_found_in_one_dealing_by_document(spark):
    lines = [(1, 0, "Large", 14.0, 9.0), (1, 0, "small", 10.0, 1.0), (1, 0, "small too", 10.0, 2.0), (1, 1, "not large", 10.0, 1.0), (None, 0, "lost", 10.0, 1.0)]
    lines += [(2, k, t, 10.0, y) for k in range(4) for t, y in (("Running head", 1.0), (f"page {k + 1}", 2.0), (f"first {k // 2}", 3.0), ("later", 4.0 + k))]
    runs = spark.createDataFrame([(d, k, t, size, 0.0, y, False) for d, k, t, size, y in lines], "doc_id long, page_index int, text string, font_size double, x double, y double, bold boolean")
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4), (3, 0), (None, 0)], "doc_id long, page_index int")
    found = L.suggest_bookmarks(runs, pages)
    assert {tuple(r) for r in found.collect()} == {(1, 0, "Large"), (2, 0, "first 0"), (2, 2, "first 1"), (2, 4, "Page 5"), (3, 0, "Page 1"), (None, 0, "Page 1")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("Exchange") == 1


def test_rows_same_as_brute_force(spark):
    rng = random.Random(3)
    pages = [[mark(d, n, rng.randrange(9), "w" * rng.randrange(1, 9), rng.randrange(0, 500), rng.choice([0, 3, 7, 11, 16, 30]) * 4 + rng.random() * 3, rng.choice([6.0, 10.0, 18.0])) for n in range(40)] for d in range(12)]
    flat = [m for p in pages for m in p]
    found = R.rows(spark.createDataFrame(flat, MARKS).repartition(3)).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("mark")).alias("m")).collect()
    got = {d: [r["m"] for r in sorted((x for x in found if x["doc_id"] == d), key=lambda x: x["row"])] for d in range(12)}
    assert got == {d: brute_rows(p) for d, p in enumerate(pages)}


def test_columns_tables_and_spans(spark):
    """Two columns of thirty rows under a heading that crosses them, and a table of three rows below."""
    marks, n = [mark(1, 0, 0, "h" * 60, 72, 40, 14.0)], 1
    for r in range(30):
        for x in (72, 296):
            marks.append(mark(1, n, r, "x" * (30 + r % 3), x, 80 + 12 * r))
            n += 1
    for r, row in enumerate((("name", "7"), ("longer name", "12,345"), ("x", "88"))):
        marks += [mark(2, 10 * r, r, row[0], 72, 80 + 14 * r), mark(2, 10 * r + 1, r, row[1], 200 - 5 * len(row[1]), 80 + 14 * r)]
    marks += [mark(3, k, k, text, 72, 80 + 14 * k) for k, text in enumerate(("• first", "goes on", "• second"))]
    frame = spark.createDataFrame(marks, MARKS)
    parts = R.fragments(R.rows(frame))
    gutters = R.gutters(parts).collect()
    assert [(g["doc_id"], g["left"], g["right"], g["rows"]) for g in gutters] == [(1, 232.0, 296.0, 30)]
    placed = R.in_columns(parts, R.gutters(parts))
    assert {(r["row"], r["column"]) for r in placed.filter("doc_id = 1 AND row < 3").collect()} == {(0, -1), (1, 0), (1, 1), (2, 0), (2, 1)}
    cells = R.tables(R.cells(placed), R.form_pages(parts)).filter("doc_id = 2").collect()
    assert sorted((c["table_row"], c["place"], c["a0"]) for c in cells) == [(0, 0, 72.0), (0, 1, 195.0), (1, 0, 72.0), (1, 1, 170.0), (2, 0, 72.0), (2, 1, 190.0)]
    n, p = B.page_structure(frame)
    texts = {(r["role"], r["text"]) for r in p.filter("doc_id = 3").collect()}
    assert texts == {("list-item", "first goes on"), ("list-item", "second")}
    blocks = B.blocks(p)
    assert blocks.filter("doc_id = 2 AND kind = 'table'").count() == 1
    places = B.line_places(n, p, blocks)
    assert places.count() == n.count() == 1 + 60 + 6 + 3
    assert {r["region"] for r in B.regions(blocks).filter("doc_id = 1").collect()} == {"column", "content"}


def test_form_pages_have_no_columns(spark):
    marks = [mark(1, 2 * r + k, r, ("label . . . . ." if k == 0 else "field") if r % 4 == 0 else "words", 72 + 224 * k, 80 + 12 * r) for r in range(30) for k in (0, 1)]
    parts = R.fragments(R.rows(spark.createDataFrame(marks, MARKS)))
    assert R.form_pages(parts).count() == 1 and R.gutters(parts).count() == 0


def test_pages_without_marks(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "doc_id long, text string")
    n, p = B.page_structure(set_marks(docs))
    blocks = B.blocks(p)
    assert [x.count() for x in (n, p, blocks, B.regions(blocks), B.page_measures(n, p, blocks), B.document_measures(n, p), B.line_places(n, p, blocks))] == [0] * 7


def test_a_fold_keeps_its_state_to_its_group(spark):
    rows = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(2000)], "g string, i int").repartition(5)
    out = folded(rows, ["g"], ["i"], ["i"], "total long", lambda s, i: ((s or 0) + i,) * 1 + (((s or 0) + i,),))
    assert out.filter("total <> i * (i + 1) / 2").count() == 0 and out.count() == 6000


# ---------------------------------------------------------------- edits


def same_line(a, b):
    cross = min(a["y1"] - a["y0"], b["y1"] - b["y0"])
    shared = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    gap = max(0, max(a["x0"], b["x0"]) - min(a["x1"], b["x1"]))
    return cross > 0 and shared >= cross * 0.6 and gap <= min(a["size"], b["size"]) * 0.8


def brute_targets(objects, edits):
    squeeze, strip = (lambda t: " ".join(t.split())), (lambda t: "".join(t.split()))
    used, out = set(), {}
    for e in edits:
        best = None
        for start in range(len(objects)):
            if objects[start]["obj"] in used or not strip(objects[start]["text"]):
                continue
            text = ""
            for end in range(start, len(objects)):
                o = objects[end]
                if end > start and (o["obj"] in used or not same_line(objects[end - 1], o)):
                    break
                text += o["text"]
                if strip(text) == strip(e["find"]):
                    part = [x for x in objects[start : end + 1] if strip(x["text"])]
                    mid = lambda a, b: (min(x[a] for x in part) + max(x[b] for x in part)) / 2  # noqa: B023, E731
                    far = math.hypot(mid("x0", "x1") - (e["x0"] + e["x1"]) / 2, mid("y0", "y1") - (e["y0"] + e["y1"]) / 2)
                    choice = (squeeze(text) != squeeze(e["find"]), len(part), far, start, [x["obj"] for x in part])
                    best = choice if best is None else min(best, choice)
                    break
        found = (best[4], best[0], False) if best else (None, None, False)
        if not best and not e["replace"]:
            height = e["y1"] - e["y0"]
            mx, my = max(2, height * 0.5), max(2, height * 0.15)
            inside = [o["obj"] for o in objects if o["obj"] not in used and o["x1"] > o["x0"] and o["y1"] > o["y0"] and o["y1"] - o["y0"] <= height * 3
                      and e["x0"] - mx <= (o["x0"] + o["x1"]) / 2 <= e["x1"] + mx and e["y0"] - my <= (o["y0"] + o["y1"]) / 2 <= e["y1"] + my]
            found = (inside, True, True) if inside else found
        used |= set(found[0] or [])
        out[e["edit"]] = found
    return out


def test_edit_targets_same_as_brute_force(spark):
    rng = random.Random(6)
    objects, edits, wanted = [], [], {}
    for d in range(25):
        own, x, y = [], 0.0, 0.0
        for n in range(60):
            text = rng.choice(["a", "b", "ab", "a ", " b", "ba", " ", "abc"])
            x, y = (0.0, y + 14.0) if rng.random() < 0.12 else (x + rng.choice([6.0, 6.0, 30.0]), y)
            own.append({"obj": n, "text": text, "x0": x, "y0": y, "x1": x + 6.0, "y1": y + 10.0, "size": 10.0})
        asked = []
        for n in range(25):
            at = rng.choice(own)
            asked.append({"edit": n, "find": rng.choice(["a", "ab", "a b", "b", "abab", "ba", "zz", "", "abc a", "aba"]), "replace": rng.choice(["", "new"]), "x0": at["x0"] - 1, "y0": at["y0"] - 1, "x1": at["x1"] + 8, "y1": at["y1"]})
        asked_ = [e for e in asked if e["find"]]
        objects += [(d, 0, *(o[c] for c in ("obj", "text", "x0", "y0", "x1", "y1", "size"))) for o in own]
        edits += [(d, 0, *(e[c] for c in ("edit", "find", "replace", "x0", "y0", "x1", "y1"))) for e in asked_]
        wanted |= {(d, k): v for k, v in brute_targets([o for o in own if o["text"].strip()], asked_).items()}
    o = spark.createDataFrame(objects, "doc_id long, page_index int, obj int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    e = spark.createDataFrame(edits, "doc_id long, page_index int, edit int, find string, replace string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["doc_id"], r["edit"]): (r["members"], r["loose"], r["by_box"]) for r in E.edit_targets(o.filter("trim(text) <> ''"), e).collect()}
    assert got == wanted
    assert E.edit_targets(o, e.filter("edit < 0")).count() == 0 and E.edit_targets(o.filter("obj < 0"), e).filter("members IS NOT NULL").count() == 0


def test_free_below_same_as_brute_force(spark):
    rng = random.Random(8)
    box = lambda: (lambda x, y: (x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 40)))(rng.randrange(0, 500), rng.randrange(0, 700))
    boxes, obstacles = [[(float(v[0]), float(v[1]), float(v[2]), float(v[3])) for v in (box() for _ in range(n))] for n in (40, 60)]
    b = spark.createDataFrame([(1, 0, i, *v) for i, v in enumerate(boxes)], "doc_id long, page_index int, id long, x0 double, y0 double, x1 double, y1 double")
    o = spark.createDataFrame([(1, 0, *v) for v in obstacles], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    got = {r["id"]: r["bottom"] for r in E.free_below(b, o, 792.0).collect()}
    assert got == {i: min([q[1] for q in obstacles if q[1] >= v[3] and q[2] > v[0] and q[0] < v[2]], default=792.0) for i, v in enumerate(boxes)}


@pytest.mark.parametrize("text, room, lines", [("", 5, 1), ("a", 5, 1), ("aa bb cc", 5, 2), ("aaaaaa", 5, 2), ("aaaaaaaaaaa b", 5, 3), ("a aaaaaaaaaa b", 5, 4), (" a  b\tc\n", 1, 3), ("aaaaa bbbbb", 5, 2)])
def test_wrapped_lines(spark, text, room, lines):
    got = spark.createDataFrame([(text, room)], "t string, r int").select(E.wrapped_lines(F.col("t"), F.col("r")).alias("n")).first()["n"]
    assert got == lines


def test_matrices_fold_in_order(spark):
    steps = [(1, 0, [2.0, 0.0, 0.0, 3.0, 1.0, 1.0]), (1, 1, [0.0, 1.0, -1.0, 0.0, 0.0, 5.0]), (2, 0, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0])]
    out = {r["k"]: r for r in E.placed_along(spark.createDataFrame(steps, "k int, at int, matrix array<double>"), ["k"], "at").collect()}
    assert out[1]["m"] == [0.0, 2.0, -3.0, 0.0, -1.0, 6.0] and out[1]["quad"] == [-1.0, 6.0, -1.0, 8.0, -4.0, 8.0, -4.0, 6.0]
    assert (out[2]["x0"], out[2]["y1"]) == (0.0, 1.0)


def test_glyphs_keep_the_width_and_skip_what_has_no_matrix(spark):
    items = [(1, "Wide i9 é", [10.0, 0.0, 0.0, 10.0, 5.0, 7.0], 80.0), (2, "", [1.0] * 6, 3.0), (3, "x", [0.0] * 6, 3.0), (4, "x", [1.0], 3.0), (5, "x", None, 3.0), (6, "ab", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0], None), (7, "x", [float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0], 1.0)]
    out = E.glyphs(spark.createDataFrame(items, "k int, text string, matrix array<double>, width double"), ["k"]).orderBy("k", "glyph").collect()
    assert {r["k"] for r in out} == {1, 6}
    assert math.isclose(sum(r["advance"] for r in out if r["k"] == 1), 80.0) and [round(r["advance"], 6) for r in out if r["k"] == 6] == [1.08, 1.08]
    assert [r["whitespace"] for r in out if r["k"] == 1] == [c == " " for c in "Wide i9 é"]


def test_glyph_advances_and_recognised_texts_know_no_break_spaces(spark):
    from leafspark.functions.names import ocr_text

    row = spark.createDataFrame([("a b “x”…ﬁn 日­é\n z", " ")], "t string, c string")
    got = row.select(ocr_text(F.col("t")).alias("t"), E.advance_weight(F.col("c")).alias("w")).first()
    assert got["t"] == 'a b "x"...fin é z' and got["w"] == 0.28


def test_words_of_pages_are_shuffled_once(spark):
    """The texts, then the marks by page; rows and fragments keep that dealing."""
    docs = spark.createDataFrame([(i, "some words of a text " * 30) for i in range(3)], "doc_id long, text string")
    plan = R.fragments(R.rows(set_marks(docs)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_words_meet_edits_without_their_lines(spark):
    o = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.0, 5.0, 5.0, 5.0)], "doc_id long, page_index int, obj int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    e = spark.createDataFrame([(1, 0, 0, "a", "b", 0.0, 0.0, 5.0, 5.0)], "doc_id long, page_index int, edit int, find string, replace string, x0 double, y0 double, x1 double, y1 double")
    found = E.edit_targets(o, e)
    assert "posexplode(all#" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().members == [0]


def dealings(frame):
    """The exchanges of a plan without those of its parts that are read again."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x.split(", [plan_id")[0].strip() for x in plan.splitlines() if "Exchange" in x]


def by_document(dealt):
    return re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\), REPARTITION_BY_NUM$", dealt)


def test_pages_of_texts_shuffle_no_words(spark):
    """The texts are dealt by document, and nothing of fragments and columns is dealt again or written."""
    for query in (S.page_fragments, S.page_gutters, S.fragment_columns):
        found = dealings(query(spark, SF_DIR))
        assert len(found) == 1 and by_document(found[0])


def test_cells_and_lines_meet_fragments_as_texts_are_dealt(spark):
    """The texts, which lines read twice, and the few rows of tables."""
    for query in (S.table_cells, S.structured_lines):
        found = dealings(query(spark, SF_DIR))
        assert len(found) <= 3 and all(map(by_document, found))


def test_edits_meet_words_as_texts_are_dealt(spark):
    assert all(map(by_document, dealings(Q.edit_targets(spark, SF_DIR))))


def test_gathered_marks_have_the_lines_of_marks_as_rows(spark):
    texts = [(1, "a heading of four " + "words . . . . of it " * 200), (5, "One two " * 90), (15, "cells 12 of a table " * 150), (20, "x" * 9000 + " y " + "z" * 90), (30, None), (31, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    both = [R.page_lines(m).drop("line") for m in (set_pages(docs), set_marks(docs).repartition(3))]
    rows, again = (sorted(map(str, x.collect())) for x in both)
    assert rows == again and any("table=0" in r for r in rows)


def test_gaps_are_from_the_last_ink(spark):
    parts = R.fragments(R.rows(spark.createDataFrame([mark(1, 0, 0, "a", 0, 80), mark(1, 1, 0, " ", 6, 80), mark(1, 2, 0, "b", 20, 80), mark(1, 3, 1, "c", 26, 80)], MARKS)))
    assert sorted((r["fragment"], r["a0"], len(r["marks"])) for r in parts.collect()) == [(0, 0.0, 1), (1, 20.0, 1), (2, 26.0, 1)]
