"""Queries of names, fonts, recognised texts and mirrored pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import names as N
from leafspark.operators import pages as P
from leafspark.sources.tables import PAGES_SQL, doc_pages, literal, literal_sql, table

WANTED = (
    "(0, '../a/b.pdf'), (1, '   '), (2, '...'), (3, 'x.PDF'), (4, 'dir/'), (5, NULL), (6, ' .hidden '), (7, 'plain')",
    "id int, wanted string",
    "SELECT 1000 + p_partkey, CASE p_size % 4 WHEN 0 THEN '/tmp/' ELSE '' END || p_name || CASE p_partkey % 3 WHEN 0 THEN '.Pdf' WHEN 1 THEN '.txt' ELSE repeat('long', 40) END FROM {part}",
)
FONTS = (
    "(0, 'ABCDEF+CMBX12'), (1, 'CMTI10'), (2, 'CMSSBX10'), (3, 'Arial-BoldMT'), (4, 'DejaVu Sans Mono'), (5, 'Palatino-BdIt'), (6, ''), (7, NULL), (8, 'LMRoman10-Italic'), (9, 'sans-serif'), (10, 'Times-It')",
    "id int, name string",
    "SELECT 1000 + p_partkey, CASE p_size % 5 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'TimesNewRoman' WHEN 2 THEN 'CourierNew' WHEN 3 THEN 'ABCDEF+CMR' || CAST(p_size AS STRING) ELSE p_name END || CASE p_partkey % 4 WHEN 0 THEN '-Bold' WHEN 1 THEN ',Italic' WHEN 2 THEN '-BoldObliqueMT' ELSE '' END FROM {part}",
)


def output_names(s, d):
    wanted = F.col("wanted")
    return literal(s, d, *WANTED).select("id", N.safe_file_name(wanted, F.lit("out"), ".pdf").alias("pdf"), N.safe_file_name(wanted, F.lit("out"), ".zip").alias("zip"))


def ocr_texts(s, d):
    return table(s, d, "documents").select("doc_id", N.ocr_text(F.col("text")).alias("text"))


def font_names(s, d):
    return literal(s, d, *FONTS).select("id", N.font_signals(F.col("name")).alias("s")).select("id", "s.family", "s.bold", "s.italic")


def flipped_pages(s, d):
    """Order lines name pages to mirror, odd ones across, even ones down; every seventh part means all pages."""
    spec = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 1, "horizontal").otherwise("vertical").alias("axis"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_suppkey") % 5).alias("page_index")
    )
    return P.flipped(doc_pages(table(s, d, "documents")), spec)


_LATIN = "[^\\x20-\\x7e\\x{a1}-\\x{ac}\\x{ae}-\\x{ff}]"
_ONE = tuple("".join(x[k] for x in N.ONE_FOR_ONE).replace("'", "''") for k in (0, 1))
_PLAIN = f"translate(text, '{_ONE[0]}', '{_ONE[1]}')"
for _a, _b in N.LONGER:
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
_NAME = "CASE WHEN coalesce(c, '') = '' THEN 'out{0}' WHEN lower(c) LIKE '%{0}' THEN c ELSE c || '{0}' END"


def _tells(signs: tuple[str, ...]) -> str:
    return "len(list_filter(p, lambda x: " + " OR ".join(f"regexp_matches(x, '{s}')" for s in signs) + ")) > 0"


SQL = {
    "output_names": f"""WITH w AS (SELECT id, left(trim(regexp_replace(regexp_replace(string_split_regex(trim(wanted), '[\\\\/]')[-1], '[\\x00-\\x1f\\x7f]', '', 'g'), '^\\.+', '')), {N.LONGEST}) AS c FROM {literal_sql(*WANTED)})
SELECT id, {_NAME.format('.pdf')} AS pdf, {_NAME.format('.zip')} AS zip FROM w""",
    "ocr_texts": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[\\t\\n\\r\\f\\x0b]', ' ', 'g'), '{_LATIN}', '', 'g'), ' +', ' ', 'g')) AS text FROM documents",
    "font_names": f"""WITH f AS (SELECT id, list_transform(string_split_regex(coalesce(name, ''), '[\\s,;]+'), lambda x: lower(regexp_replace(regexp_replace(x, '{N.SUBSET}', ''), '{N.FOUNDRY}', ''))) AS p FROM {literal_sql(*FONTS)})
SELECT id, CASE {" ".join(f"WHEN {_tells(v)} THEN '{k}'" for k, v in N.FAMILIES.items())} END AS family, {_tells(N.BOLD)} AS bold, {_tells(N.ITALIC)} AS italic FROM f""",
    "flipped_pages": f"""WITH {PAGES_SQL}, s AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 = 1 AS across, CASE WHEN l_partkey % 7 > 0 THEN l_suppkey % 5 END AS page_index FROM lineitem),
f AS (SELECT p.doc_id, p.page_index, coalesce(bool_or(across), false) AS horizontal, coalesce(bool_or(NOT across), false) AS vertical FROM doc_pages p LEFT JOIN s ON s.doc_id = p.doc_id AND (s.page_index IS NULL OR s.page_index = p.page_index) GROUP BY 1, 2)
SELECT *, count(*) FILTER (horizontal OR vertical) OVER (PARTITION BY doc_id) AS flipped FROM f""",
}
QUERIES = {name: globals()[name] for name in SQL}
