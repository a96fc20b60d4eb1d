"""Queries of page structure, from marks to page measures, and their SQL.

All read ``documents`` set as pages. The SQL is a chain of views in the same order; its ordered folds are
recursive, one row a step.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from leafspark.operators import page_blocks as B
from leafspark.operators import page_rows as R
from leafspark.operators import scores
from leafspark.plans.layout_queries import TIGHT_SQL
from leafspark.sources.staging import staged
from leafspark.sources.tables import table
from leafspark.sources.typeset import HEIGHT, MARKS_SQL, PARAGRAPH, set_pages

WIDE, HIGH = 612.0, HEIGHT
PAGE, FAMILY, LANE = R.PAGE, R.FAMILY, B.LANE


def _r(name: str) -> Column:
    """Six decimals as the SQL has them; what lies next to a half goes up, whatever the order of sums left of it."""
    return (F.floor(F.col(name) * 1e6 + 0.5001) / 1e6).alias(name)


def _marks(s, d):
    return set_pages(table(s, d, "documents"))


def _structure(s, d):
    """Hinted lines and paragraphs."""
    return B.page_structure(_marks(s, d), WIDE, HIGH)


def _hinted(s, d):
    """The lines alone."""
    return B.hinted_lines(_marks(s, d), WIDE, HIGH)


def page_fragments(s, d):
    parts = R.flat(R.family_parts(_marks(s, d)))
    text = F.array_join(F.transform("marks", lambda m: m["text"]), " ")
    return parts.select(*FAMILY, "row", F.col("fragment").cast("int").alias("fragment"), text.alias("text"), _r("a0"), _r("a1"), _r("cross"))


def page_gutters(s, d):
    return R.gutters(R.family_parts(_marks(s, d))).select(*FAMILY, "left", "right", _r("c0"), _r("c1"), F.col("rows").cast("int").alias("rows"))


def fragment_columns(s, d):
    return R.page_fragments(_marks(s, d)).select(*FAMILY, "row", F.col("fragment").cast("int").alias("fragment"), F.col("column").cast("int").alias("column_index"))


def table_cells(s, d):
    t = R.tables(R.cells(R.page_fragments(_marks(s, d))))
    return t.select(*FAMILY, F.col("column").alias("column_index"), F.col("table").alias("table_no"), "row", F.col("table_row").cast("int").alias("table_row"), F.col("place").cast("int").alias("place"), _r("a0"), _r("a1"))


def structured_lines(s, d):
    return _hinted(s, d).select(*FAMILY, F.col("column").alias("column_index"), "row", "text", _r("a0"), _r("a1"), _r("baseline"), "role", F.col("level").alias("heading_level"), "list_level", _r("indent"), _r("pitch"))


def page_paragraphs(s, d):
    return B.paragraphs(_hinted(s, d)).select(*FAMILY, F.col("column").alias("column_index"), F.col("para").cast("int").alias("para"), "role", F.col("level").alias("heading_level"), F.col("n_lines").cast("int").alias("n_lines"), "text", "alignment", _r("confidence"), "ambiguous")


def page_blocks(s, d):
    b = B.blocks(B.paragraphs(_hinted(s, d)))
    return b.select(*FAMILY, F.col("column").alias("column_index"), "kind", F.col("n_paragraphs").cast("int").alias("n_paragraphs"), "x0", "y0", "x1", "y1", _r("confidence"), "ambiguous")


def page_regions(s, d):
    r = B.regions(B.blocks(B.paragraphs(_hinted(s, d))))
    return r.select(*PAGE, "region", F.col("n_blocks").cast("int").alias("n_blocks"), "x0", "y0", "x1", "y1", _r("confidence"))


def page_measures(s, d):
    n, p = _structure(s, d)
    m = B.page_measures(n, p, B.blocks(p), WIDE, HIGH)
    counts = [F.col(c).cast("int").alias(c) for c in ("n_lines", "n_words", "n_columns", "n_paragraphs", "n_headings", "n_blocks", "n_tables")]
    return m.select(*PAGE, *counts, "body_size", *map(_r, ("pitch", "grouping", "boundaries", "relations", "table_sure", "classified", "reflow_safe")))


def document_structure(s, d):
    """Each document's pages with several columns, tables, headings and list items."""
    n, p = _structure(s, d)
    return B.document_measures(n, p).select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("n_pages", "column_pages", "n_tables", "n_headings", "n_items")), _r("size"))


def line_places(s, d):
    """Each line with its paragraph and its block: the three join by key."""
    n, p = _structure(s, d)
    return B.line_places(n, p, B.blocks(p)).select(*PAGE, F.col("line_no").cast("int").alias("line_no"), F.col("column").alias("column_index"), F.col("para").cast("int").alias("para"), "role", "kind", "block_y")


def paragraph_f1(s, d):
    """How well paragraphs are found again: joins of neighbouring body lines against the six rows that were
    set together."""
    order = Window.partitionBy(*LANE).orderBy("baseline", "a0", "line_no")
    group = F.floor((F.col("y0") - 80) / (12 * PARAGRAPH + 8))
    n = _hinted(s, d).filter("table IS NULL").withColumn("group", group).withColumn("set", F.col("group") == F.lag("group").over(order))
    lines = B.paragraph_lines(n).filter("bucket = 0 AND column >= 0 AND role = 'body'")
    lines = staged(lines.select(*PAGE, "line_no", "set", "joined"), "joins")
    return scores.pair_f1(lines.filter("set"), lines.filter("joined"), [*PAGE, "line_no"])


_KEYS = "doc_id, page_index, bucket"
_LANE = f"{_KEYS}, col"
_R = "floor({0} * 1e6 + 0.5001) / 1e6"

_ROWS = f"""{MARKS_SQL},
turned AS (SELECT *, (((floor(rotation / 5 + 0.5) * 5) % 360 + 360) % 360)::INT AS bucket FROM marks WHERE length(text) > 0 AND font_size > 0),
spun AS (SELECT *, cos(radians(bucket)) AS c, sin(radians(bucket)) AS s FROM turned),
extents AS (
  SELECT *, least(x * c + y * s, (x + width) * c + y * s, x * c + (y + height) * s, (x + width) * c + (y + height) * s) AS a0,
         greatest(x * c + y * s, (x + width) * c + y * s, x * c + (y + height) * s, (x + width) * c + (y + height) * s) AS a1,
         least(y * c - x * s, y * c - (x + width) * s, (y + height) * c - x * s, (y + height) * c - (x + width) * s) AS c0,
         greatest(y * c - x * s, y * c - (x + width) * s, (y + height) * c - x * s, (y + height) * c - (x + width) * s) AS c1, mid_y * c - mid_x * s AS base FROM spun),
sized AS (SELECT * EXCLUDE (c, s), greatest(median(font_size) OVER (PARTITION BY {_KEYS}), 1) AS median_size FROM extents),
ordered_marks AS MATERIALIZED (
  SELECT *, greatest(1.2, median_size * 0.2) AS tolerance, row_number() OVER (PARTITION BY {_KEYS} ORDER BY base, a0, mark) AS i FROM sized),
row_steps AS (
  SELECT {_KEYS}, i, 0 AS row, base AS mean, c0 AS low, c1 AS high, 1 AS n FROM ordered_marks WHERE i = 1
  UNION ALL
  SELECT {_KEYS}, i, CASE WHEN joins THEN row ELSE row + 1 END, CASE WHEN joins THEN (mean * n + base) / (n + 1) ELSE base END,
         CASE WHEN joins THEN least(low, c0) ELSE c0 END, CASE WHEN joins THEN greatest(high, c1) ELSE c1 END, CASE WHEN joins THEN n + 1 ELSE 1 END
  FROM (SELECT m.doc_id, m.page_index, m.bucket, m.i, m.base, m.c0, m.c1, r.row, r.mean, r.low, r.high, r.n,
               abs(m.base - r.mean) <= m.tolerance OR greatest(0, least(m.c1, r.high) - greatest(m.c0, r.low)) / least(m.c1 - m.c0, r.high - r.low) >= 0.45 AS joins
        FROM row_steps r JOIN ordered_marks m ON m.doc_id = r.doc_id AND m.page_index = r.page_index AND m.bucket = r.bucket AND m.i = r.i + 1)),
in_rows AS (SELECT m.*, r.row FROM ordered_marks m JOIN row_steps r USING (doc_id, page_index, bucket, i)),
cut_marks AS (
  SELECT *, coalesce(item <> lag(item) OVER w OR a0 - lag(a1) OVER w > greatest(4.0, median_size * 0.9, greatest(font_size, lag(font_size) OVER w, 1) * 1.15), false)::INT AS cut
  FROM in_rows WINDOW w AS (PARTITION BY {_KEYS}, row ORDER BY a0, base, mark)),
mark_parts AS (SELECT *, sum(cut) OVER (PARTITION BY {_KEYS}, row ORDER BY a0, base, mark)::INT AS fragment FROM cut_marks),
parts AS (
  SELECT {_KEYS}, row, fragment, min(a0) AS a0, max(a1) AS a1, avg(base) AS base, max(median_size) AS median_size, min(c0) AS c0, max(c1) AS c1, count(*) AS n,
         string_agg(text, ' ' ORDER BY a0, mark) AS text, string_agg(text, '' ORDER BY a0, mark) AS packed FROM mark_parts GROUP BY ALL)"""

_GUTTERS = f"""{_ROWS},
row_texts AS (SELECT {_KEYS}, row, trim(string_agg(packed, ' ' ORDER BY a0, fragment)) AS t, string_agg(packed, '' ORDER BY a0, fragment) AS packed FROM parts GROUP BY ALL),
forms AS (SELECT {_KEYS} FROM row_texts WHERE t <> '' GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (regexp_matches(t, '\\.(\\s*\\.){{3,}}')) >= greatest(5, ceil(count(*) * 0.03))),
gaps AS (
  SELECT * FROM (SELECT {_KEYS}, row, lag(a1) OVER w AS l, a0 AS r, (lag(base) OVER w + base) / 2 AS base, greatest(6.0, median_size * 0.9) AS least_gap FROM parts
    WINDOW w AS (PARTITION BY {_KEYS}, row ORDER BY a0, fragment)) WHERE r - l >= least_gap),
ordered_gaps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY l, r, row) AS i FROM gaps),
gap_steps AS (
  SELECT {_KEYS}, i, 0 AS corridor, l, r, base AS low, base AS high, 1 AS n, least_gap FROM ordered_gaps WHERE i = 1
  UNION ALL
  SELECT {_KEYS}, i, CASE WHEN joins THEN corridor ELSE corridor + 1 END, CASE WHEN joins THEN greatest(pl, l) ELSE l END, CASE WHEN joins THEN least(pr, r) ELSE r END,
         CASE WHEN joins THEN least(low, base) ELSE base END, CASE WHEN joins THEN greatest(high, base) ELSE base END, CASE WHEN joins THEN n + 1 ELSE 1 END, least_gap
  FROM (SELECT g.doc_id, g.page_index, g.bucket, g.i, g.l, g.r, g.base, g.least_gap, s.l AS pl, s.r AS pr, s.corridor, s.low, s.high, s.n,
               g.l < s.r AND least(s.r, g.r) - greatest(s.l, g.l) >= g.least_gap AS joins
        FROM gap_steps s JOIN ordered_gaps g ON g.doc_id = s.doc_id AND g.page_index = s.page_index AND g.bucket = s.bucket AND g.i = s.i + 1)),
corridors AS (
  SELECT {_KEYS}, corridor, max(l) AS l, min(r) AS r, min(low) AS low, max(high) AS high, max(n) AS n, any_value(least_gap) AS least_gap FROM gap_steps GROUP BY ALL),
wide_corridors AS (
  SELECT *, coalesce(l > max(r) OVER (PARTITION BY {_KEYS} ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, false)::INT AS apart
  FROM corridors WHERE n >= 3 AND high - low >= {HIGH * 0.25} AND r - l >= least_gap),
merged_corridors AS (
  SELECT {_KEYS}, g, min(l) AS l, max(r) AS r, min(low) AS c0, max(high) AS c1, max(n) AS rows
  FROM (SELECT *, sum(apart) OVER (PARTITION BY {_KEYS} ORDER BY l, r) AS g FROM wide_corridors) GROUP BY ALL),
gutters AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY rows DESC, r - l DESC, l) AS best FROM merged_corridors) WHERE best < 4
  AND ({_KEYS}) NOT IN (SELECT ({_KEYS}) FROM forms)),
edges AS (SELECT {_KEYS}, list({{'l': l, 'r': r}} ORDER BY l) AS e FROM gutters GROUP BY ALL),
passed AS (SELECT p.*, e, coalesce(len(list_filter(e, lambda g: p.a0 >= g.r - 0.75)), 0) AS k FROM parts p LEFT JOIN edges USING ({_KEYS})),
placed AS (SELECT * EXCLUDE (e, k), CASE WHEN coalesce(a1 <= e[k + 1].l + 0.75, true) THEN k ELSE -1 END::INT AS col FROM passed)"""

_ALIGN = "CASE WHEN abs({a}.starts[i] - {b}.starts[i]) <= {near} THEN 'start' WHEN abs({a}.ends[i] - {b}.ends[i]) <= {near} THEN 'end' WHEN abs(({a}.starts[i] + {a}.ends[i]) / 2 - ({b}.starts[i] + {b}.ends[i]) / 2) <= {near} THEN 'center' END"
_NEAR = "greatest(10.0, m.median_size * 1.1)"
_SHARED = _ALIGN.format(a="s", b="m", near=_NEAR)

_TABLES = f"""{_GUTTERS},
cell_parts AS (
  SELECT p.*, coalesce(a0 - max(a1) OVER (PARTITION BY {_LANE}, p.row ORDER BY a0, fragment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= greatest(4.0, median_size * 0.55), false)::INT AS far
  FROM placed p JOIN row_texts t USING ({_KEYS}, row) WHERE col >= 0 AND NOT regexp_matches(t.packed, '\\.{{4,}}')),
cell_of AS (SELECT *, sum(far) OVER (PARTITION BY {_LANE}, row ORDER BY a0, fragment)::INT AS cell FROM cell_parts),
all_cells AS (
  SELECT {_LANE}, row, cell, min(a0) AS a0, max(a1) AS a1, sum(base * n) / sum(n) AS base, max(median_size) AS median_size, list(fragment ORDER BY fragment) AS fragments FROM cell_of GROUP BY ALL),
cell_rows AS (
  SELECT {_LANE}, row, list_avg(list(base ORDER BY cell)) AS base, list(a0 ORDER BY cell) AS starts, list(a1 ORDER BY cell) AS ends, max(median_size) AS median_size FROM all_cells GROUP BY ALL HAVING count(*) > 1),
ordered_rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {_LANE} ORDER BY base, row) AS i FROM cell_rows),
table_steps AS (
  SELECT {_LANE}, i, row, base, starts, ends, starts AS lo, ends AS hi, 0 AS tab, 0 AS modes FROM ordered_rows WHERE i = 1
  UNION ALL
  SELECT {_LANE}, i, row, base, starts, ends, CASE WHEN joins THEN list_transform(range(1, len(starts) + 1), lambda i: least(lo[i], starts[i])) ELSE starts END,
         CASE WHEN joins THEN list_transform(range(1, len(ends) + 1), lambda i: greatest(hi[i], ends[i])) ELSE ends END,
         CASE WHEN joins THEN tab ELSE tab + 1 END, CASE WHEN joins THEN modes ELSE 0 END
  FROM (SELECT m.doc_id, m.page_index, m.bucket, m.col, m.i, m.row, m.base, m.starts, m.ends, s.lo, s.hi, s.tab,
               len(list_distinct(list_transform(range(1, len(m.starts) + 1), lambda i: {_SHARED}))) AS modes,
               m.row > s.row AND len(m.starts) = len(s.starts) AND abs(m.base - s.base) <= greatest(18.0, m.median_size * 3.2)
               AND len(list_filter(range(1, len(m.starts) + 1), lambda i: ({_SHARED}) IS NULL)) = 0
               AND len(list_filter(range(1, len(m.starts)), lambda i: s.hi[i] > list_min(m.starts[i + 1:]) + {_NEAR} OR m.ends[i] > list_min(s.lo[i + 1:]) + {_NEAR})) = 0 AS joins
        FROM table_steps s JOIN ordered_rows m ON m.doc_id = s.doc_id AND m.page_index = s.page_index AND m.bucket = s.bucket AND m.col = s.col AND m.i = s.i + 1)),
grids AS (
  SELECT *, count(*) OVER g AS rows, max(modes) OVER g AS kinds, row_number() OVER (PARTITION BY {_LANE}, tab ORDER BY base, row) - 1 AS table_row
  FROM table_steps WINDOW g AS (PARTITION BY {_LANE}, tab)),
kept_rows AS (
  SELECT g.* FROM grids g LEFT JOIN (SELECT *, true AS form FROM forms) f USING ({_KEYS})
  WHERE rows >= CASE WHEN form THEN 3 ELSE 2 END AND NOT (rows = 2 AND kinds > 1) AND rows * len(starts) >= 4),
table_parts AS (
  SELECT {_LANE}, tab, k.row, table_row, c.cell, c.a0, c.a1, c.fragments, (c.a1 + lead(c.a0) OVER (PARTITION BY {_LANE}, tab, k.row ORDER BY c.cell)) / 2 AS mid
  FROM kept_rows k JOIN all_cells c USING ({_LANE}, row)),
table_edges AS (SELECT {_LANE}, tab, list(edge ORDER BY edge) AS e FROM (SELECT {_LANE}, tab, cell, avg(mid) AS edge FROM table_parts GROUP BY ALL HAVING edge IS NOT NULL) GROUP BY ALL),
table_cells AS (
  SELECT {_LANE}, tab, row, table_row::INT AS table_row, cell, a0, a1, fragments,
         (cell + max(len(list_filter(e, lambda x: (a0 + a1) / 2 >= x)) - cell) OVER (PARTITION BY {_LANE}, tab, row ORDER BY cell))::INT AS place
  FROM table_parts JOIN table_edges USING ({_LANE}, tab))"""

_TIGHT = TIGHT_SQL
_CJK = "[\\x{2e80}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ac00}-\\x{d7af}]"

_LINES = f"""{_TABLES},
held AS (SELECT {_LANE}, row, tab, table_row, place, unnest(fragments) AS fragment FROM table_cells),
looks AS (SELECT {_KEYS}, row, fragment, arg_min({{'f': family, 's': font_size, 'b': bold}}, {{'a': a0, 'm': mark}}) AS look FROM mark_parts GROUP BY ALL),
free_parts AS (
  SELECT p.*, look, look.s AS size, greatest(4.0, median_size * 2.5) AS near FROM placed p JOIN looks USING ({_KEYS}, row, fragment)
  LEFT JOIN held h USING ({_LANE}, row, fragment) WHERE h.tab IS NULL),
run_cuts AS (SELECT *, coalesce(a0 - lag(a1) OVER (PARTITION BY {_LANE}, row, look ORDER BY a0, fragment) > near, false)::INT AS cut FROM free_parts),
run_of AS (SELECT *, sum(cut) OVER (PARTITION BY {_LANE}, row, look ORDER BY a0, fragment) AS run FROM run_cuts),
runs AS (SELECT {_LANE}, row, look, run, min(a0) AS a0, max(a1) AS a1, max(median_size) AS median_size, min(near) AS near, any_value(size) AS size, list(fragment) AS fragments FROM run_of GROUP BY ALL),
line_cuts AS (
  SELECT *, coalesce(a0 - lag(a1) OVER w > near OR (a0 - lag(a1) OVER w < -greatest(1, median_size * 0.4) AND greatest(size, lag(size) OVER w) / least(size, lag(size) OVER w) > 1.5), false)::INT AS cut
  FROM runs WINDOW w AS (PARTITION BY {_LANE}, row ORDER BY a0, look, run)),
line_of AS (SELECT {_LANE}, row, sum(cut) OVER (PARTITION BY {_LANE}, row ORDER BY a0, look, run)::INT AS line, fragments FROM line_cuts),
line_parts AS (
  SELECT {_LANE}, row, line, NULL::INT AS tab, NULL::INT AS table_row, NULL::INT AS place, unnest(fragments) AS fragment FROM line_of
  UNION ALL SELECT {_LANE}, row, place, tab, table_row, place, fragment FROM held),
raw_lines AS (
  SELECT {_LANE}, row, line, l.tab, l.table_row, l.place, list(text ORDER BY a0, mark) AS texts, min(a0) AS a0, max(a1) AS a1, avg(base) AS baseline, min(x) AS x0, min(y) AS y0,
         max(x + width) AS x1, max(y + height) AS y1, count(*) AS n_words
  FROM line_parts l JOIN mark_parts m USING ({_KEYS}, row, fragment) GROUP BY ALL),
line_looks AS (
  SELECT {_LANE}, row, line, l.tab, family, font_size, bold, sum(length(text)) AS weight, min({{'a': a0, 'm': mark}}) AS seen FROM line_parts l JOIN mark_parts m USING ({_KEYS}, row, fragment) GROUP BY {_LANE}, row, line, l.tab, family, font_size, bold
  QUALIFY row_number() OVER (PARTITION BY {_LANE}, row, line, l.tab ORDER BY weight DESC, seen) = 1),
lines AS (
  SELECT r.* EXCLUDE (texts), family, font_size, bold, list_reduce(texts, lambda a, b: a || CASE WHEN {_TIGHT.format(a="a", b="b")} THEN '' ELSE ' ' END || b) AS text
  FROM raw_lines r JOIN line_looks k ON (r.doc_id, r.page_index, r.bucket, r.col, r.row, r.line) = (k.doc_id, k.page_index, k.bucket, k.col, k.row, k.line) AND r.tab IS NOT DISTINCT FROM k.tab)"""

_LAG = f"(PARTITION BY {_LANE} ORDER BY baseline, a0, line_no)"
_FOOT = "^\\s*(\\d{1,3}|[*†‡§¶]|\\[\\d{1,3}\\])\\s+\\S"
_MARK = "^\\s*([•▪◦‣∙·●○■□❖➤►*+–—\\-]|\\(?\\d{1,3}[.)]|\\(?[a-zA-Z][.)]|[ivxlcdmIVXLCDM]{1,6}[.)])\\s+\\S"
_LABEL = "^(?i)(fig(ure)?|tab(le)?|exhibit|chart|diagram)\\s*"
_CAPTION = f"(regexp_matches(t, '{_LABEL}(\\d{{1,3}}|[ivxlcdm]{{1,6}})\\s*([.:)\\-–—]|\\s)') OR regexp_matches(t, '{_LABEL}[a-z][.:)\\-–—]') OR regexp_matches(t, '^(?i)(source|note|notes)\\s*:'))"
_NUMBER = "regexp_matches(trim(regexp_replace(t, '\\s+', ' ', 'g')), '^(?i)(page ?)?\\d{1,4}( ?(of|/) ?\\d{1,4})?$')"
_SIMILAR = "(font_size / greatest(lag(font_size) OVER w, 0.1) BETWEEN 0.86 AND 1.16 AND family = lag(family) OVER w)"
_EDGE = "(abs(a0 - lag(a0) OVER w) <= 2 OR abs(a1 - lag(a1) OVER w) <= 2 OR abs((a0 + a1) / 2 - (lag(a0) OVER w + lag(a1) OVER w) / 2) <= 2)"
_SIDE = """CASE WHEN a0 - left_ > own * 2 AND right_ - a1 > own * 2 AND abs((a0 - left_) - (right_ - a1)) <= greatest(own * 1.5, ((a0 - left_) + (right_ - a1)) * 0.15) THEN 'center'
  WHEN a0 - left_ > own * 2 AND right_ - a1 <= own * 1.5 THEN 'right' ELSE 'left' END"""

_HINTED = f"""{_LINES},
numbered AS (SELECT *, trim(text) AS t, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY bucket, row, a0, col, line) AS line_no, floor(font_size / 0.25 + 0.5) * 0.25 AS quarter FROM lines WHERE trim(text) <> ''),
quarters AS (SELECT doc_id, page_index, quarter, sum(length(t) * quarter) AS weight, min(line_no) AS seen FROM numbered GROUP BY ALL),
bodies AS (SELECT doc_id, page_index, quarter AS body_size FROM quarters QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY weight DESC, seen) = 1),
ratios AS (
  SELECT n.*, body_size, greatest(font_size, 0.1) / greatest(body_size, 0.1) AS ratio, (y0 + (y1 - y0) / 2) / {HIGH} AS middle, max(font_size) OVER (PARTITION BY doc_id, page_index) AS largest,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_, len(string_split_regex(t, '\\s+')) AS words
  FROM numbered n JOIN bodies USING (doc_id, page_index)),
shares AS (SELECT *, CASE WHEN letters >= 3 THEN upper_ / letters ELSE 0 END AS share, NOT regexp_matches(t, '[.!?,;]$') AS open_ FROM ratios),
roles AS (
  SELECT *, CASE WHEN {_NUMBER} AND middle < 0.2 THEN 'header' WHEN {_NUMBER} AND middle > 0.8 THEN 'footer'
    WHEN regexp_matches(t, '{_FOOT}') AND ratio <= 0.92 AND middle > 0.6 AND length(t) >= 12 THEN 'footnote'
    WHEN ratio <= 1.1 AND middle < 0.085 THEN 'header' WHEN ratio <= 1.1 AND middle > 1 - 0.085 THEN 'footer'
    WHEN ratio >= 1.16 OR (bold AND ratio >= 0.95 AND length(t) <= 80 AND open_ AND (share >= 0.7 OR words <= 8)) OR (share >= 0.85 AND letters >= 4 AND length(t) <= 60 AND open_ AND words <= 10) THEN 'heading'
    WHEN regexp_matches(t, '{_MARK}') THEN 'list-item' WHEN ratio <= 1.05 AND {_CAPTION} AND length(t) <= 240 THEN 'caption' ELSE 'body' END AS role0 FROM shares),
levels AS (SELECT *, CASE WHEN role0 <> 'heading' THEN 0 WHEN ratio >= 1.16 AND font_size >= largest * 0.95 THEN 1 WHEN ratio >= 1.32 THEN 2 ELSE 3 END AS level0 FROM roles),
pitch_gaps AS (
  SELECT doc_id, page_index, baseline - lag(baseline) OVER w AS gap, role0 = lag(role0) OVER w AND baseline - lag(baseline) OVER w <= greatest(font_size, lag(font_size) OVER w) * 2.6 AS close
  FROM levels WINDOW w AS {_LAG}),
pitches AS (SELECT doc_id, page_index, median(gap) AS measured FROM pitch_gaps WHERE close AND gap > 0.5 GROUP BY ALL),
pitched AS (SELECT l.*, coalesce(measured, greatest(4, body_size * 1.25)) AS pitch FROM levels l LEFT JOIN pitches USING (doc_id, page_index)),
chains AS (
  SELECT *, (NOT coalesce(role0 NOT IN ('header', 'unknown') AND NOT regexp_matches(t, '{_FOOT}') AND baseline - lag(baseline) OVER w <= pitch * 1.8
    AND font_size <= lag(font_size) OVER w * 1.05 AND {_SIMILAR}, false))::INT AS cut FROM pitched WINDOW w AS {_LAG}),
tail_of AS (SELECT *, sum(cut) OVER {_LAG} AS chain FROM chains),
tails AS (SELECT *, role0 <> 'footnote' AND max((role0 = 'footnote')::INT) OVER (PARTITION BY {_LANE}, chain ORDER BY baseline, a0, line_no) = 1 AS tail FROM tail_of),
tailed AS (SELECT *, CASE WHEN tail THEN 'footnote' ELSE role0 END AS role1, CASE WHEN tail THEN 0 ELSE level0 END AS level1 FROM tails),
apart AS (
  SELECT *, coalesce(role1 = 'body' AND length(t) BETWEEN 1 AND 60 AND NOT regexp_matches(t, '[.,;:!?\\-]$') AND words <= 9 AND font_size >= body_size * 0.95
    AND lag(font_size) OVER w >= body_size * 0.9 AND lead(font_size) OVER w >= body_size * 0.9 AND letters >= 2 AND letters / greatest(1, length(regexp_replace(t, '\\s+', '', 'g'))) >= 0.6
    AND len(list_filter(string_split_regex(t, '\\s+'), lambda x: regexp_matches(x, '^[A-Za-z]$'))) / words <= 0.3
    AND length(lead(t) OVER w) >= 20 AND lead(a1) OVER w - lead(a0) OVER w >= {WIDE * 0.15} AND length(lag(t) OVER w) >= 20 AND a1 - a0 <= {WIDE} * 0.55
    AND baseline - lag(baseline) OVER w >= pitch * 1.5 AND lead(baseline) OVER w - baseline >= pitch * 1.5, false) AS heads FROM tailed WINDOW w AS {_LAG}),
final_roles AS (SELECT *, CASE WHEN heads THEN 'heading' ELSE role1 END AS role, CASE WHEN heads THEN 3 ELSE level1 END AS level FROM apart),
lane_bounds AS (SELECT {_LANE}, min(a0) AS l, max(a1) AS r, median(a1) AS m FROM final_roles WHERE role NOT IN ('header', 'footer') GROUP BY ALL),
bounded AS (
  SELECT f.*, CASE WHEN r > l THEN l ELSE 0 END AS left_, CASE WHEN r > l THEN r ELSE {WIDE} END AS right_, coalesce(m, {WIDE}) AS typical, greatest(font_size, 1) AS own FROM final_roles f LEFT JOIN lane_bounds USING ({_LANE})),
indented AS (SELECT *, CASE WHEN col >= 0 THEN greatest(0, a0 - left_) ELSE 0 END AS indent FROM bounded),
tabs AS (SELECT {_LANE}, list_sort(list_distinct(list(floor(indent * 2 + 0.5) / 2))) AS stops, any_value(body_size) AS body_size FROM indented WHERE role = 'list-item' GROUP BY ALL),
centres AS (
  SELECT {_LANE}, list_reduce(list_transform(stops, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > greatest(4, body_size * 0.6) THEN list_concat(a, x) ELSE a END) AS c FROM tabs),
hinted AS (
  SELECT i.*, {_SIDE} AS side, CASE WHEN role = 'list-item' THEN least(greatest(len(list_filter(c, lambda x: indent + 1 >= x)), 1), 6) ELSE 0 END::INT AS list_level
  FROM indented i LEFT JOIN centres USING ({_LANE}))"""

_UNIT = "least(greatest({0}, 0), 1)"
_PARAGRAPHS = f"""{_HINTED},
pair_values AS (
  SELECT *, baseline - lag(baseline) OVER w AS gap, (baseline - lag(baseline) OVER w) / greatest(0.1, pitch) AS gap_ratio, coalesce({_SIMILAR}, false) AS alike,
         font_size / greatest(lag(font_size) OVER w, 0.1) AS grown, {_EDGE} AS edge, a0 - lag(a0) OVER w AS shift, lag(side) OVER w AS last_side, greatest(lag(font_size) OVER w, 1) AS last_own,
         lag(a1) OVER w < typical - greatest(greatest(lag(font_size) OVER w, font_size, 1) * 2, 12) AS short,
         coalesce(lag(a1) OVER w < typical - greatest(greatest(lag(font_size) OVER w, 1) * 2, greatest(1, right_ - left_) * 0.18), false) AS ended,
         lag(family) OVER w AS last_family, row_number() OVER w AS i
  FROM hinted WHERE tab IS NULL WINDOW w AS {_LAG}),
pair_lines AS MATERIALIZED (
  SELECT *, {_UNIT.format("0.5 * " + _UNIT.format("(1.8 - gap_ratio) / 0.8") + " + 0.2 * CASE WHEN edge THEN 1.0 ELSE 0.25 END + 0.2 * CASE WHEN abs(grown - 1) <= 0.06 AND family = last_family THEN 1.0 ELSE 0.3 END + 0.1 * CASE WHEN short THEN 0.0 ELSE 1.0 END")} AS going FROM pair_values),
para_steps AS (
  SELECT {_LANE}, i, 0 AS para, role AS kind, level AS kind_level, CASE WHEN role = 'list-item' THEN indent ELSE 0 END AS kind_indent, false AS joined, NULL::DOUBLE AS score, false AS unsure FROM pair_lines WHERE i = 1
  UNION ALL
  SELECT {_LANE}, i, CASE WHEN d.go THEN para ELSE para + 1 END, CASE WHEN d.go THEN kind ELSE role END, CASE WHEN d.go THEN kind_level ELSE level END,
         CASE WHEN d.go THEN kind_indent WHEN role = 'list-item' THEN indent ELSE 0 END, d.go, d.score, d.unsure
  FROM (SELECT s.para, s.kind, s.kind_level, s.kind_indent, l.*, CASE
      WHEN l.role = 'list-item' THEN {{'go': false, 'score': 0.9::DOUBLE, 'unsure': false}}
      WHEN l.gap <= 0 OR (s.kind = 'list-item' AND l.role IN ('header', 'footer')) THEN {{'go': false, 'score': 0.95::DOUBLE, 'unsure': false}}
      WHEN s.kind = 'list-item' THEN CASE WHEN l.gap_ratio <= 1.8 AND l.alike AND l.indent >= s.kind_indent - l.last_own * 0.4
        THEN {{'go': true, 'score': {_UNIT.format("1 - (l.gap_ratio - 1) / 1.6")}::DOUBLE, 'unsure': l.gap_ratio > 1.55}} ELSE {{'go': false, 'score': 0.7::DOUBLE, 'unsure': false}} END
      WHEN l.role IN ('header', 'footer') THEN CASE WHEN s.kind = l.role AND l.gap_ratio <= 1.8 THEN {{'go': true, 'score': 0.8::DOUBLE, 'unsure': false}} ELSE {{'go': false, 'score': 0.9::DOUBLE, 'unsure': false}} END
      WHEN s.kind IN ('header', 'footer') THEN {{'go': false, 'score': 0.95::DOUBLE, 'unsure': false}}
      WHEN 'heading' IN (s.kind, l.role) THEN CASE WHEN s.kind = l.role AND s.kind_level = l.level AND l.alike AND l.gap_ratio <= 1.8 THEN {{'go': true, 'score': 0.85::DOUBLE, 'unsure': l.gap_ratio > 1.5}} ELSE {{'go': false, 'score': 0.9::DOUBLE, 'unsure': false}} END
      WHEN 'caption' IN (s.kind, l.role) THEN CASE WHEN s.kind = l.role AND l.alike AND l.gap_ratio <= 1.8 THEN {{'go': true, 'score': 0.85::DOUBLE, 'unsure': false}}
        WHEN s.kind = 'caption' AND l.role = 'body' AND l.alike AND l.font_size <= l.body_size * 1.02 AND l.gap_ratio <= 1.5 THEN {{'go': true, 'score': 0.7::DOUBLE, 'unsure': true}} ELSE {{'go': false, 'score': 0.8::DOUBLE, 'unsure': false}} END
      WHEN s.kind <> l.role OR NOT l.alike THEN {{'go': false, 'score': 0.95::DOUBLE, 'unsure': false}}
      WHEN l.gap_ratio > 1.4 THEN {{'go': false, 'score': {_UNIT.format("0.5 + (l.gap_ratio - 1.4) * 2")}::DOUBLE, 'unsure': l.gap_ratio < 1.4 + 0.25}}
      WHEN l.ended THEN {{'go': false, 'score': 0.8::DOUBLE, 'unsure': false}}
      WHEN l.shift > greatest(2, l.last_own * 0.6) THEN {{'go': false, 'score': 0.75::DOUBLE, 'unsure': false}}
      WHEN l.last_side IN ('center', 'right') AND l.last_side <> l.side THEN {{'go': false, 'score': 0.7::DOUBLE, 'unsure': false}}
      ELSE {{'go': true, 'score': {_UNIT.format("0.25 + 0.3 * " + _UNIT.format("(1.4 - l.gap_ratio) / (1.4 - 1)") + " + 0.25 * l.going + 0.2 * " + _UNIT.format("1 - abs(l.grown - 1) / 0.16"))}::DOUBLE, 'unsure': l.gap_ratio > 1.2 OR abs(l.grown - 1) > 0.09}} END AS d
    FROM para_steps s JOIN pair_lines l ON l.doc_id = s.doc_id AND l.page_index = s.page_index AND l.bucket = s.bucket AND l.col = s.col AND l.i = s.i + 1)),
para_lines AS (
  SELECT l.* EXCLUDE (i, gap, gap_ratio, alike, grown, shift, last_side, last_own, short, ended, last_family, going), para, joined, score, unsure FROM pair_lines l JOIN para_steps USING ({_LANE}, i)),
all_lines AS (
  SELECT {_LANE}, para, line_no, baseline, a0, a1, text, t, role, level, list_level, font_size, bold, indent, side, own, left_, right_, x0, y0, x1, y1, body_size, pitch, joined, score, unsure, NULL::INT AS tab FROM para_lines
  UNION ALL SELECT {_LANE}, -1 - line_no, line_no, baseline, a0, a1, text, t, 'table-cell', 0, 0, font_size, bold, indent, side, own, left_, right_, x0, y0, x1, y1, body_size, pitch, false, NULL, false, tab FROM hinted WHERE tab IS NOT NULL),
told AS (
  SELECT *, lag(text) OVER w AS last_text, row_number() OVER w AS k, count(*) OVER (PARTITION BY {_LANE}, para) AS n, a0 - left_ <= own * 1.6 AND right_ - a1 <= own * 1.6 AS fills
  FROM all_lines WINDOW w AS (PARTITION BY {_LANE}, para ORDER BY baseline, a0, line_no)),
written AS (
  SELECT *, CASE WHEN k = 1 AND role = 'list-item' THEN ltrim(regexp_replace(t, '{_MARK.removesuffix(chr(92) + "S")}', '')) WHEN k = 1 THEN t
    WHEN rtrim(last_text, ' ') = '' OR ltrim(text, ' ') = '' OR rtrim(last_text, ' ') LIKE '%-' OR regexp_matches(rtrim(last_text, ' '), '{_CJK}$') OR regexp_matches(ltrim(text, ' '), '^{_CJK}') THEN t ELSE ' ' || t END AS piece FROM told),
grouped AS (
  SELECT {_LANE}, para, arg_min(role, k) AS role, arg_min(level, k) AS level, arg_min(list_level, k) AS list_level, trim(string_agg(piece, '' ORDER BY k)) AS text, count(*) AS n_lines,
         min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(font_size, k) AS font_size, arg_min(bold, k) AS bold, any_value(body_size) AS body_size, any_value(pitch) AS pitch, any_value(tab) AS tab,
         avg(score) FILTER (joined) AS inner_, coalesce(bool_or(joined AND unsure), false) AS ambiguous, count(*) FILTER (side = 'center') AS c, count(*) FILTER (side = 'right') AS r,
         coalesce(bool_and(fills) FILTER (k < n OR n = 1), false) AS full_, any_value(score) FILTER (k = 1 AND para > 0) AS cut
  FROM written GROUP BY ALL),
joined_cuts AS (SELECT *, CASE WHEN para >= 0 THEN lead(cut) OVER (PARTITION BY {_LANE} ORDER BY para) END AS next_cut FROM grouped),
paragraphs AS (
  SELECT *, CASE WHEN c >= greatest(1, n_lines * 0.6) THEN 'center' WHEN r >= greatest(1, n_lines * 0.6) THEN 'right' WHEN n_lines >= 2 AND full_ THEN 'justify' ELSE 'left' END AS alignment,
         {_UNIT.format("coalesce(inner_, CASE role WHEN 'heading' THEN CASE WHEN font_size / greatest(body_size, 0.1) >= 1.16 THEN 0.95 WHEN bold THEN 0.85 ELSE 0.7 END WHEN 'caption' THEN 0.78 WHEN 'footnote' THEN 0.75 WHEN 'header' THEN 0.88 WHEN 'footer' THEN 0.88 WHEN 'list-item' THEN 0.9 WHEN 'table-cell' THEN 0.72 ELSE 0.8 END::DOUBLE) * coalesce(0.55 + 0.45 * " + _UNIT.format("cut") + ", 1) * coalesce(0.55 + 0.45 * " + _UNIT.format("next_cut") + ", 1)")}::DOUBLE AS confidence
  FROM joined_cuts)"""

_BLOCKS = f"""{_PARAGRAPHS},
kinds AS (SELECT *, CASE role WHEN 'list-item' THEN 'list' WHEN 'table-cell' THEN 'table' ELSE role END AS kind FROM paragraphs),
block_cuts AS (
  SELECT *, coalesce(y0 - lag(y1) OVER w > greatest(pitch * 1.1, font_size * 1.6) OR y0 - lag(y1) OVER w < -pitch, false)::INT AS apart
  FROM kinds WHERE tab IS NULL WINDOW w AS (PARTITION BY {_LANE}, kind, level, list_level, alignment ORDER BY y0, x0, para)),
block_of AS (SELECT *, sum(apart) OVER (PARTITION BY {_LANE}, kind, level, list_level, alignment ORDER BY y0, x0, para) AS g FROM block_cuts),
blocks AS (
  SELECT {_LANE}, kind, count(*) AS n_paragraphs, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
         {_UNIT.format("avg(confidence) - CASE WHEN bool_or(ambiguous) THEN 0.05 ELSE 0 END")} AS confidence, bool_or(ambiguous) AS ambiguous, list(para) AS paras
  FROM block_of GROUP BY {_LANE}, kind, level, list_level, alignment, g
  UNION ALL SELECT {_LANE}, 'table', count(*), min(x0), min(y0), max(x1), max(y1), {_UNIT.format("avg(confidence)")}, bool_or(ambiguous), list(para) FROM kinds WHERE tab IS NOT NULL GROUP BY {_LANE}, tab)"""

_K = f"{_KEYS}, col AS column_index"


def _sql(views: str, select: str) -> str:
    return f"WITH RECURSIVE {views}\n{select}"


SQL = {
    "page_fragments": _sql(_ROWS, f"SELECT {_KEYS}, row, fragment, text, {_R.format('a0')} AS a0, {_R.format('a1')} AS a1, {_R.format('base')} AS \"cross\" FROM parts"),
    "page_gutters": _sql(_GUTTERS, f"SELECT {_KEYS}, l AS \"left\", r AS \"right\", {_R.format('c0')} AS c0, {_R.format('c1')} AS c1, rows::INT AS rows FROM gutters"),
    "fragment_columns": _sql(_GUTTERS, f"SELECT {_KEYS}, row, fragment, col AS column_index FROM placed"),
    "table_cells": _sql(_TABLES, f"SELECT {_K}, tab AS table_no, row, table_row, place, {_R.format('a0')} AS a0, {_R.format('a1')} AS a1 FROM table_cells"),
    "structured_lines": _sql(_HINTED, f"SELECT {_K}, row, text, {_R.format('a0')} AS a0, {_R.format('a1')} AS a1, {_R.format('baseline')} AS baseline, role, level AS heading_level, list_level, {_R.format('indent')} AS indent, {_R.format('pitch')} AS pitch FROM hinted"),
    "page_paragraphs": _sql(_PARAGRAPHS, f"SELECT {_K}, para::INT AS para, role, level AS heading_level, n_lines::INT AS n_lines, text, alignment, {_R.format('confidence')} AS confidence, ambiguous FROM paragraphs"),
    "page_blocks": _sql(_BLOCKS, f"SELECT {_K}, kind, n_paragraphs::INT AS n_paragraphs, x0, y0, x1, y1, {_R.format('confidence')} AS confidence, ambiguous FROM blocks"),
    "page_regions": _sql(_BLOCKS, f"""SELECT doc_id, page_index, region, count(*)::INT AS n_blocks, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, {_R.format('avg(confidence)')} AS confidence
FROM (SELECT *, CASE WHEN kind IN ('header', 'footer', 'table') THEN kind WHEN several AND col >= 0 THEN 'column' ELSE 'content' END AS region, row_number() OVER () AS id
      FROM (SELECT *, max(CASE WHEN bucket = 0 THEN col ELSE 0 END) OVER (PARTITION BY doc_id, page_index) > 0 AS several FROM blocks))
GROUP BY doc_id, page_index, region, CASE region WHEN 'table' THEN id WHEN 'column' THEN col ELSE -1 END"""),
    "page_measures": _sql(_BLOCKS, f"""SELECT doc_id, page_index, n_lines::INT AS n_lines, n_words::INT AS n_words, n_columns::INT AS n_columns, n_paragraphs::INT AS n_paragraphs, n_headings::INT AS n_headings, n_blocks::INT AS n_blocks, n_tables::INT AS n_tables,
  body_size, {_R.format('pitch')} AS pitch, {_R.format(_UNIT.format('0.55 * mean + 0.25 * held / n_lines + 0.2 * (1 - unsure)'))} AS grouping, {_R.format(_UNIT.format('0.85 * mean + 0.15 * (1 - unsure)'))} AS boundaries,
  {_R.format(_UNIT.format('0.4 * coalesce(same, 1) + 0.35 * coalesce(edge, 1) + 0.25'))} AS relations, {_R.format('coalesce(table_mean, 0.9)')} AS table_sure, {_R.format(_UNIT.format('0.6 * known + 0.4 * mean'))} AS classified,
  {_R.format(_UNIT.format('0.7 * (1 - ' + _UNIT.format(f'covered / {WIDE * HIGH}') + ') + 0.3 * (1 - unsure)'))} AS reflow_safe
FROM (SELECT doc_id, page_index, count(*) AS n_lines, sum(n_words) AS n_words, any_value(body_size) AS body_size, any_value(pitch) AS pitch, count(DISTINCT col) FILTER (bucket = 0 AND col >= 0) AS n_columns FROM hinted GROUP BY ALL)
JOIN (SELECT doc_id, page_index, count(*) AS n_paragraphs, avg(confidence) AS mean, avg(ambiguous::INT) AS unsure, sum(n_lines) AS held, avg((role <> 'unknown')::INT) AS known, count(*) FILTER (role = 'heading') AS n_headings FROM paragraphs GROUP BY ALL) USING (doc_id, page_index)
JOIN (SELECT doc_id, page_index, count(*) AS n_blocks, count(*) FILTER (kind = 'table') AS n_tables, sum(CASE WHEN kind = 'table' THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS covered, avg(confidence) FILTER (kind = 'table') AS table_mean FROM blocks GROUP BY ALL) USING (doc_id, page_index)
LEFT JOIN (SELECT doc_id, page_index, avg(same::INT) AS same, avg(edge::INT) AS edge FROM (
  SELECT doc_id, page_index, {_EDGE} AS edge, abs(font_size / greatest(lag(font_size) OVER w, 0.1) - 1) <= 0.06 AND family = lag(family) OVER w AS same FROM para_lines WINDOW w AS (PARTITION BY {_LANE}, para ORDER BY baseline, a0, line_no)) WHERE edge IS NOT NULL GROUP BY ALL) USING (doc_id, page_index)"""),
    "document_structure": _sql(_PARAGRAPHS, f"""SELECT doc_id, n_pages::INT AS n_pages, column_pages::INT AS column_pages, n_tables::INT AS n_tables, n_headings::INT AS n_headings, n_items::INT AS n_items, {_R.format('size')} AS size
FROM (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (columns > 1) AS column_pages, sum(tables) AS n_tables, sum(body_size * words) / sum(words) AS size
      FROM (SELECT doc_id, page_index, count(DISTINCT col) FILTER (bucket = 0 AND col >= 0) AS columns, count(DISTINCT {{'b': bucket, 'c': col, 't': tab}}) FILTER (tab IS NOT NULL) AS tables, any_value(body_size) AS body_size, sum(n_words) AS words FROM hinted GROUP BY ALL) GROUP BY ALL)
JOIN (SELECT doc_id, count(*) FILTER (role = 'heading') AS n_headings, count(*) FILTER (role = 'list-item') AS n_items FROM paragraphs GROUP BY ALL) USING (doc_id)"""),
    "line_places": _sql(_BLOCKS, f"""SELECT doc_id, page_index, line_no::INT AS line_no, col AS column_index, para::INT AS para, p.role, b.kind, b.y0 AS block_y
FROM all_lines l JOIN paragraphs p USING ({_LANE}, para) JOIN (SELECT {_LANE}, kind, y0, unnest(paras) AS para FROM blocks) b USING ({_LANE}, para)"""),
    "paragraph_f1": _sql(_PARAGRAPHS, f"""SELECT hits, truth, found, hits / found AS precision, hits / truth AS recall, 2 * (hits / found) * (hits / truth) / (hits / found + hits / truth) AS f1
FROM (SELECT count(*) FILTER (joined AND together) AS hits, count(*) FILTER (together) AS truth, count(*) FILTER (joined) AS found
      FROM (SELECT *, floor((y0 - 80) / {12 * PARAGRAPH + 8}) = lag(floor((y0 - 80) / {12 * PARAGRAPH + 8})) OVER {_LAG} AS together FROM para_lines) WHERE bucket = 0 AND col >= 0 AND role = 'body')"""),
}
QUERIES = {f.__name__: f for f in (page_fragments, page_gutters, fragment_columns, table_cells, structured_lines, page_paragraphs, page_blocks, page_regions, page_measures, document_structure, line_places, paragraph_f1)}
