"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into paragraphs, its lines, and a paragraph into leaves: they end after a sentence mark and a
space, and after a word of eight or more characters, so that text without sentence marks is cut as well.
A section is a run of paragraphs that ends with one whose hash begins with 0 to 3, so that an edit moves no
boundary but its own. A leaf's hash is SHA-256 of its text; a paragraph's, a section's and the root's are
those of their children's hashes; each level has its own tag. Roots test equality; of two trees with
different roots, ``edited_leaves`` goes down the sections, then the paragraphs, that only one has.

The fingerprint is text of bounded length: the root, a colon, and the least ``SKETCH`` of the distinct
leaves' hashes, 16 hex digits each. Likeness is 1 for equal roots, else twice the shared leaves over all
leaves (each text's distinct ones that aren't empty), which is exact up to ``SKETCH`` leaves in each text
and estimated by the least hashes beyond.

Finding the next document needs no global window: ids are range-partitioned and sorted, and only each
partition's first id is compared across partitions.

Defined results: a null text counts as empty, and an empty text has one empty leaf; a document that is
alone is its own next; a null id is the last in descending order; documents of one id follow each other
by a hash of their texts; rows repeated in full are one document and give as many equal rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import broadcast_up_to, staged, table

#: Stand after every leaf's and every paragraph's end; a text that holds them already is cut there as well.
MARK, LINE = "\x01", "\x02"
#: After each of these, and after a long word, a leaf ends.
ENDS = (". ", "! ", "? ")
LONG_WORD = r"([^ \n]{8,} )"
#: Leaves in a fingerprint.
SKETCH = 128


def with_tree(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the tree of ``text``: root, and sections (hash, paragraphs (hash, leaves))."""
    hashed = lambda tag, parts: F.sha2(F.concat(F.lit(tag), F.array_join(parts, "")), 256)
    cut = F.regexp_replace(text, LONG_WORD, "$1" + MARK)
    for end in ENDS:
        cut = F.replace(cut, F.lit(end), F.lit(end + MARK))
    lines = F.split(F.replace(cut, F.lit("\n"), F.lit("\n" + LINE)), LINE)
    leaves = F.transform(lines, lambda line: F.transform(F.split(line, MARK), lambda leaf: F.sha2(F.concat(F.lit("L"), leaf), 256)))
    n = F.size("_paragraphs")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(F.col("_paragraphs"), i)["hash"] < "4"))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_last"), k - 1))
    section = lambda own: F.struct(hashed("S", F.transform(own, lambda p: p["hash"])).alias("hash"), own.alias("paragraphs"))
    return (
        df.withColumn("_leaves", leaves)
        .withColumn("_paragraphs", F.transform("_leaves", lambda own: F.struct(hashed("P", own).alias("hash"), own.alias("leaves"))))
        .withColumn("_last", last)
        .withColumn("_sections", F.transform("_last", lambda e, k: section(F.slice("_paragraphs", before(k) + 1, e - before(k)))))
        .withColumn(name, F.struct(hashed("R", F.transform("_sections", lambda s: s["hash"])).alias("root"), F.col("_sections").alias("sections")))
        .drop("_leaves", "_paragraphs", "_last", "_sections")
    )


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: s["paragraphs"]))


def _all_leaves(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: p["leaves"]))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text``."""
    some = F.filter(_all_leaves(_paragraphs(F.col("_tree.sections"))), lambda h: h != F.sha2(F.lit("L"), 256))
    sketch = F.slice(F.array_sort(F.array_distinct(F.transform(some, lambda h: F.substring(h, 1, 16)))), 1, SKETCH)
    return with_tree(df, text, "_tree").withColumn(name, F.concat(F.col("_tree.root"), F.lit(":"), F.array_join(sketch, ","))).drop("_tree")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone."""
    leaves = lambda x: F.filter(F.split(F.substring_index(x, ":", -1), ","), lambda h: h != "")
    # Up to here both sketches have all their texts' leaves; "g" is after any digit.
    upto = lambda s: F.when(F.size(s) >= SKETCH, F.array_max(s)).otherwise(F.lit("g"))
    known = lambda s, most: F.size(F.filter(s, lambda h: h <= most))
    # Sketches and their limit go through arrays of one element, so that they are computed once and not for every hash.
    held = F.array(F.struct(leaves(a).alias("x"), leaves(b).alias("y")))
    held = F.transform(held, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), F.least(upto(s["x"]), upto(s["y"])).alias("most")))
    shares = F.transform(held, lambda s: F.try_divide(
        F.lit(2.0) * known(F.array_intersect(s["x"], s["y"]), s["most"]), known(s["x"], s["most"]) + known(s["y"], s["most"])))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.coalesce(F.get(shares, F.lit(0)), F.lit(0.0)))


def edited_leaves(a: Column, b: Column) -> Column:
    """Where tree b has leaves that tree a has not: their section, paragraph in it and leaf in that, from
    0. Only sections, and in them only paragraphs, that a lacks are looked into; none if the roots agree."""
    lacking = lambda own, other: F.filter(own, lambda x: ~F.array_contains(F.transform(other, lambda o: o["hash"]), x["hash"]))
    differing = lacking(a["sections"], b["sections"])
    paragraphs = _paragraphs(differing)
    section_hashes, paragraph_hashes, leaf_hashes = F.transform(a["sections"], lambda s: s["hash"]), F.transform(paragraphs, lambda p: p["hash"]), _all_leaves(paragraphs)

    def in_paragraph(p: Column, i: Column, k: Column) -> Column:
        at = F.transform(p["leaves"], lambda h, n: F.when(~F.array_contains(leaf_hashes, h), F.struct(i.alias("section"), k.alias("paragraph"), n.alias("leaf"))))
        return F.when(F.array_contains(paragraph_hashes, p["hash"]), F.array_compact(F.slice(at, 1, 0))).otherwise(F.array_compact(at))

    def in_section(s: Column, i: Column) -> Column:
        at = F.flatten(F.transform(s["paragraphs"], lambda p, k: in_paragraph(p, i, k)))
        return F.when(F.array_contains(section_hashes, s["hash"]), F.slice(at, 1, 0)).otherwise(at)

    found = F.flatten(F.transform(b["sections"], in_section))
    return F.when(a["root"] == b["root"], F.slice(found, 1, 0)).otherwise(found)


def _key(id_col: Column, text: Column) -> Column:
    """One value for an id and a text; rows repeated in full share it."""
    return F.sha2(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), text), 256)


def _order(prefix: str = "") -> list[Column]:
    return [F.col(prefix + "doc_id").asc_nulls_first(), F.col(prefix + "key").desc()]


def followers(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, key, text)`` to key, n_chars, copies and, of the document whose next this one is
    in descending order of id, before_key and before_chars."""
    rows = docs.groupBy("doc_id", "key").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ring = staged(rows.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "ring")
    place = Window.partitionBy("part").orderBy(*_order())
    rows = ring.withColumn("place", F.row_number().over(place))
    for c in ("key", "n_chars"):
        rows = rows.withColumn(f"up_{c}", F.lead(c).over(place))
    # The first row of each partition comes after the last of the one before; round the ring at the end.
    first = rows.filter("place = 1").select("part", F.col("key").alias("k"), F.col("n_chars").alias("n"))
    parts, around = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select(
        F.col("part"),
        F.coalesce(F.lead("k").over(parts), F.first("k").over(around)).alias("k"),
        F.coalesce(F.lead("n").over(parts), F.first("n").over(around)).alias("n"),
    )
    return rows.join(broadcast_up_to(staged(heads, "heads"), 100_000), "part").select(
        "key", "n_chars", "copies", F.coalesce("up_key", "k").alias("before_key"), F.coalesce("up_n_chars", "n").alias("before_chars")
    )


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its text with the last half replaced by
    the next document's beginning, and the fingerprints' likeness."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _key(F.col(id_col), text).alias("key"))
    once = Window.partitionBy("key").orderBy("doc_id")
    own = rows.join(followers(rows), "key").withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    own = with_fingerprint(own, F.col("text"), "fingerprint")
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    gift = own.select(
        F.col("before_key").alias("key"),
        F.substring("text", F.lit(1), half("before_chars")).alias("gift"),
        F.col("fingerprint").alias("next_fingerprint"),
    )
    both = own.join(gift, "key").withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half("n_chars")).cast("int")), "gift")
    )
    both = with_fingerprint(both, F.col("edited"), "edited_fingerprint")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


_SQL_CUT = "string_split(replace(replace(replace(replace(regexp_replace({0}, '([^ \\n]{{8,}} )', '\\1' || chr(1), 'g'), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(10), chr(10) || chr(2)), chr(2))"
_SQL_LEAVES = f"list_transform({_SQL_CUT}, lambda line: list_transform(string_split(line, chr(1)), lambda x: sha256('L' || x)))"
_SQL_PARAGRAPHS = "list_transform({0}, lambda own: sha256('P' || array_to_string(own, '')))"
_SQL_LAST = "list_filter(range(1, len({0}) + 1), lambda i: i = len({0}) OR {0}[i][1] < '4')"
_SQL_ROOT = "sha256('R' || array_to_string(list_transform({1}, lambda e, k: sha256('S' || array_to_string({0}[(CASE WHEN k = 1 THEN 1 ELSE {1}[k - 1] + 1 END):e], ''))), ''))"
_SQL_SKETCH = f"list_sort(list_distinct(list_transform(list_filter(flatten({{0}}), lambda h: h <> sha256('L')), lambda h: h[1:16])))[1:{SKETCH}]"
_SQL_NEAR = (
    f"CASE WHEN {{0}}[1:64] = {{1}}[1:64] THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * len(list_filter(list_intersect({{2}}, {{3}}), lambda h: h <= m)) "
    f"/ nullif(len(list_filter({{2}}, lambda h: h <= m)) + len(list_filter({{3}}, lambda h: h <= m)), 0), 0.0::DOUBLE) END"
)
_SQL_MOST = f"least(CASE WHEN len({{0}}) >= {SKETCH} THEN {{0}}[{SKETCH}] ELSE 'g' END, CASE WHEN len({{1}}) >= {SKETCH} THEN {{1}}[{SKETCH}] ELSE 'g' END)"
_TEXTS = ("text", "edited", "next")
SQL = {
    "op6_merkle": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
                  sha256(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key FROM documents),
r AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, key),
                         first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, key)) AS next FROM t),
e AS (SELECT *, text[1:n_chars - n_chars // 2] || next[1:n_chars // 2] AS edited FROM r),
l AS (SELECT doc_id, n_chars, edited, {", ".join(f"{_SQL_LEAVES.format(c)} AS l{k}" for k, c in enumerate(_TEXTS))} FROM e),
p AS (SELECT *, {", ".join(f"{_SQL_PARAGRAPHS.format(f'l{k}')} AS p{k}, {_SQL_SKETCH.format(f'l{k}')} AS s{k}" for k in range(3))} FROM l),
s AS (SELECT *, {", ".join(f"{_SQL_LAST.format(f'p{k}')} AS e{k}" for k in range(3))} FROM p),
f AS (SELECT *, {", ".join(f"{_SQL_ROOT.format(f'p{k}', f'e{k}')} || ':' || array_to_string(s{k}, ',') AS f{k}" for k in range(3))} FROM s),
n AS (SELECT *, {_SQL_MOST.format("s0", "s1")} AS m FROM f),
o AS (SELECT *, {_SQL_NEAR.format("f0", "f1", "s0", "s1")} AS near_edited FROM n),
q AS (SELECT * EXCLUDE (m), {_SQL_MOST.format("s0", "s2")} AS m FROM o)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, f0 AS fingerprint, f1 AS edited_fingerprint, near_edited,
       {_SQL_NEAR.format("f0", "f2", "s0", "s2")} AS near_next
FROM q
"""
}
QUERIES = {"op6_merkle": op6_merkle}
