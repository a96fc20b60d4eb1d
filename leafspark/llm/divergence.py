"""Source divergence audit by sort-based streaming.

Tasks read documents once and combine what they read: (lang, term, source), the first document of the
block, its documents and occurrences. These partial runs are dealt by (lang, term), sorted by (lang,
term, source, document), a hash of the first two leading so that rows compare by numbers, and scanned as
run lengths to one row for each kept term. No further shuffle of terms follows: each such run adds to
the partial sums of all pairs of sources of its language and gives its terms that stand out; the sums
of the tasks are merged by one more scan over sorted rows.

Occurrences and documents are combined before anything is shuffled: a term that is in every document
costs one row for each block and source, so of a block's rows no term has more than there are sources,
and no key is hot. A block ends where its distinct entries reach ``ENTRIES``; a long text is read in
pieces. The pairs of sources are the result's own size.

All arithmetic is on integers: floor(10^9 a / b) is taken in three steps of 10^3, so that nothing
overflows while a language has less than 9 * 10^15 terms.

Defined results: null text, language and source are ''; a row of ``docs`` is a document, repeated
rows and null ids included; a source without terms takes part with counts of zero; a language without
kept terms gives its pairs the value 0 and no terms; a language with one source has no pairs; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import short_batches, staged, table

#: The query's parameters.
MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct entries of a block, bytes of a text read at once, cells of a matrix, and groups in a broadcast.
ENTRIES, PIECE, CELLS, GROUPS = 500_000, 1 << 20, 1 << 21, 100_000

#: A-Z lower-cased, other letters and bytes from 0x80 as they are, the rest blank.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_RUNS = "lang string, source string, term binary, document long, docs long, n long"


def _pieces(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    start, plain = 0, text.translate(_LETTERS)
    while start < len(plain):
        end = plain.find(b" ", start + piece)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def _block(counts: dict, docs: dict, first) -> Iterator[pa.RecordBatch]:
    for (lang, source), c in counts.items():
        n, seen = len(c), docs[lang, source]
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(c.keys(), pa.binary(), size=n),
                pa.repeat(pa.scalar(first, pa.int64()), n), pa.array(map(seen.__getitem__, c), pa.int64(), size=n), pa.array(c.values(), pa.int64(), size=n),
            ],
            names=["lang", "source", "term", "document", "docs", "n"],
        )


def _partial_runs(entries: int, piece: int):
    """Documents to partial runs; the empty term stands for the group itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, first, held = {}, {}, None, 0
        for batch in batches:
            for doc, text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (lang, source) not in counts:
                    counts[lang, source], docs[lang, source] = Counter({b"": 0}), Counter()
                first = doc if not held else first
                c, seen = counts[lang, source], set()
                before = len(c)
                for terms in _pieces(text, piece):
                    c.update(terms)
                    seen.update(terms)
                docs[lang, source].update(seen)
                held += 1 + len(c) - before
                if held >= entries:
                    yield from _block(counts, docs, first)
                    counts, docs, held = {}, {}, 0
        if counts:
            yield from _block(counts, docs, first)

    return read


def _starts(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        col = batch.column(key).combine_chunks()
        new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _run_lengths(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows to one for each run of equal ``keys``, with the sums of docs and n."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select([*keys, "docs", "n"])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        at = _starts(rows, keys)
        sums = {c: pa.array(np.add.reduceat(rows.column(c).to_numpy(), at)) for c in ("docs", "n")}
        runs = rows.select(keys).take(pa.array(at)).append_column("docs", sums["docs"]).append_column("n", sums["n"])
        held = runs.slice(len(at) - 1)
        yield runs.slice(0, len(at) - 1)
    if held is not None:
        yield held


def _kept_terms(min_docs: int):
    """Sorted runs to one row for each term of enough documents, and one of the empty term for the groups."""

    def whole(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(at[1:], rows.num_rows)
        docs = np.add.reduceat(rows.column("docs").to_numpy(), at)
        n = np.add.reduceat(rows.column("n").to_numpy(), at)
        groups = rows.select(["lang", "term"]).take(pa.array(at))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]), pa.int32()), rows.column(c).combine_chunks()) for c in ("source", "n")]
        keep = (docs >= min_docs) | pc.equal(groups.column("term"), b"").to_numpy()
        out = pa.Table.from_arrays([*groups.columns, pa.array(n), *lists], names=["lang", "term", "n", "sources", "counts"])
        yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for runs in _run_lengths(batches, ["lang", "term", "source"]):
            rows = runs if held is None else pa.concat_tables([held, runs])
            if rows.num_rows:
                at = _starts(rows, ["lang", "term"])
                held = rows.slice(at[-1])
                if len(at) > 1:
                    yield from whole(rows.slice(0, at[-1]).combine_chunks(), at[:-1])
        if held is not None:
            yield from whole(held.combine_chunks(), np.zeros(1, dtype=np.int64))

    return scan


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, exactly."""
    whole, rest = np.divmod(count.astype(np.int64), total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


class _Language:
    """One language's sums over the runs that a task has seen: of each source's with the sources after it."""

    def __init__(self, lang: str, sources: pa.Array, totals: np.ndarray, kept: int, cells: int):
        self.lang, self.sources, self.names = lang, sources, sources.to_pylist()
        self.totals, self.total = totals + SMOOTH * kept, int(totals.sum()) + SMOOTH * kept
        size = len(self.names)
        self.pairs = np.zeros((size, size), dtype=np.int64) if size * size <= cells else None
        self.cells = size * size if self.pairs is not None else size

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Adds whole runs and gives their terms; sums that are too wide to be held are given at once."""
        size = len(self.names)
        lists, flat = rows.column("counts").combine_chunks(), rows.column("sources").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(flat).to_numpy())
        col = pc.index_in(flat.flatten(), value_set=self.sources).to_numpy()
        counts = np.zeros((rows.num_rows, size), dtype=np.int64)
        counts[row, col] = lists.flatten().to_numpy()
        p, q = share(counts + SMOOTH, self.totals), share(rows.column("n").to_numpy() + SMOOTH, self.total)
        for i in range(size - 1):
            sums = np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(axis=0)
            if self.pairs is None:
                yield self.partial(i, sums)
            else:
                self.pairs[i, i + 1 :] += sums
        t, s = np.nonzero((counts > 0) & (p > q[:, None]))
        yield _audit(pa.repeat(self.lang, len(t)), self.sources.take(pa.array(s)), rows.column("term").combine_chunks().take(pa.array(t)), (p - q[:, None])[t, s], pa.nulls(len(t), pa.list_(pa.int64())))

    def partial(self, i: int, sums: np.ndarray) -> pa.RecordBatch:
        return _audit(pa.array([self.lang]), self.sources.slice(i, 1), pa.nulls(1, pa.binary()), np.array([i]), pa.array([sums]))

    def sums(self) -> Iterator[pa.RecordBatch]:
        for i in range(len(self.names) - 1 if self.pairs is not None else 0):
            yield self.partial(i, self.pairs[i, i + 1 :])


#: Terms have an item and a value, partial sums a source's place in ``value`` and its sums with those after it.
_AUDIT = "lang string, source string, item binary, value long, sums array<long>"


def _audit(langs: pa.Array, sources: pa.Array, items: pa.Array, values: np.ndarray, sums: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, sources, items, pa.array(values.astype(np.int64)), sums], names=["lang", "source", "item", "value", "sums"])


def _audited(cells: int):
    """Whole runs, of languages in any order, to terms and the task's partial sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Language] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("lang").combine_chunks()
            at = [*_starts(rows, ["lang"]), rows.num_rows]
            for a, b in zip(at, at[1:], strict=False):
                part = rows.slice(a, b - a)
                lang = part.column("lang")[0].as_py()
                if lang not in held:
                    if sum(x.cells for x in held.values()) > cells:
                        for language in held.values():
                            yield from language.sums()
                        held = {}
                    head = part.slice(0, 1)
                    totals = head.column("group_totals").combine_chunks().flatten().to_numpy()
                    held[lang] = _Language(lang, head.column("group_sources").combine_chunks().flatten(), totals, head.column("kept")[0].as_py(), cells)
                step = max(1, cells // max(1, len(held[lang].names)))
                for i in range(0, part.num_rows, step):
                    yield from held[lang].add(part.slice(i, step))
        for language in held.values():
            yield from language.sums()

    return scan


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial sums to one row for each source."""
    names, held = ["lang", "source", "value", "sums"], None
    for batch in batches:
        for lang, source, place, sums in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            values = np.array(sums, dtype=np.int64)
            if held is not None and held[:2] == (lang, source):
                values += held[3]
            elif held is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(names, held, strict=True))])
            held = (lang, source, place, values)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, held, strict=True))])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", entries: int = ENTRIES, piece: int = PIECE, cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source's terms are from
    those of the other sources of its language, and which of its terms stand out from the language's."""
    short_batches(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("document"), named(text_col).cast("binary").alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source")
    )
    runs = read.mapInArrow(_partial_runs(entries, piece), _RUNS).withColumn("key", F.xxhash64("lang", "term"))
    runs = runs.repartition("lang", "term").sortWithinPartitions("key", "lang", "term", "source", "document").drop("key")
    kept = staged(
        runs.mapInArrow(_kept_terms(min_docs), "lang string, term binary, n long, sources array<string>, counts array<long>"), "terms"
    )
    is_term = F.octet_length("term") > 0
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count_if(is_term).alias("kept"))
    pairs_of = F.array_sort(F.collect_list(F.struct("source", "total")))
    langs = staged(
        groups.groupBy("lang").agg(pairs_of.alias("g")).join(sizes, "lang")
        .select("lang", "kept", F.col("g.source").alias("group_sources"), F.col("g.total").alias("group_totals")),
        "langs",
    )
    held = langs.agg(F.sum(F.size("group_sources"))).first()[0] or 0
    beside = F.broadcast(langs) if held <= GROUPS else langs
    found = staged(kept.filter(is_term).join(beside, "lang").mapInArrow(_audited(cells), _AUDIT), "found")
    parts = found.filter("sums IS NOT NULL").select("lang", "source", "value", "sums")
    parts = parts.repartition("lang", "source").sortWithinPartitions("lang", "source").mapInArrow(_summed, "lang string, source string, value long, sums array<long>")
    after = F.slice("group_sources", (F.col("value") + 2).cast("int"), F.size("sums"))
    once = parts.join(beside, "lang").select("lang", "source", F.explode(F.arrays_zip(after.alias("item"), "sums")).alias("x"))
    once = once.select("lang", "source", F.col("x.item").alias("item"), F.col("x.sums").alias("value"))
    names = langs.filter("kept = 0").select("lang", F.explode("group_sources").alias("source"))
    bare = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = once.unionByName(bare).select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    terms = found.filter("item IS NOT NULL").select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
SQL = {
    "op13_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (g.total::HUGEINT + {SMOOTH} * l.v) AS p,
         1 + {SCALE}::HUGEINT * (k.n + {SMOOTH}) // (l.total::HUGEINT + {SMOOTH} * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {TOP}
"""
}
