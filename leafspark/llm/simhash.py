"""SimHash near-dedup with pigeonring filtering.

A fingerprint has eight segments of eight bits on a ring. If two fingerprints differ in at most three
bits, some start on the ring has every chain of ``l`` consecutive segments differ in at most
``floor(3 l / 8)`` bits: none in the first two segments and at most one in the first five. One bit
leaves two of the segments three to five untouched, so each fingerprint is filed under 24 keys (8
starts, 3 choices of those two segments) of 32 equal bits; fingerprints that meet there must satisfy
the whole chain of budgets before the full Hamming check. Only distinct fingerprints take part, so
copies cost one row each.

Where more than ``crowd`` fingerprints share a key, they differ only outside the key's four segments
by three bits at most, so instead of being paired each one names the values within two flips and within
one flip of those segments; two within three flips name a common value. The links are then those of
the meeting points, and rows grow with the crowd and not with its square.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links
like any other; repeated rows and equal fingerprints are linked; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leafspark.llm.common import short_batches, staged, table
from leafspark.llm.components import components

SEED = 42
DISTANCE = 3
#: Hashes counted at once, to bound memory on very long texts.
CHUNK = 1 << 16
SEGMENTS, WIDTH = 8, 8
#: The two segments after the first two that stay equal, as steps from the start.
EQUAL_PAIRS = ((2, 3), (2, 4), (3, 4))

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of one text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(_hash, shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rotated(x: Column, segments: int) -> Column:
    """``x`` turned so that segment ``segments`` comes lowest."""
    k = WIDTH * segments
    return x if not k else F.shiftrightunsigned(x, k).bitwiseOR(F.shiftleft(x, 64 - k))


def _mask(steps) -> int:
    return sum(0xFF << (WIDTH * s) for s in steps)


def _keys(fp: Column) -> Column:
    """The 24 filing keys: shape, and the fingerprint's bits in the shape's segments."""
    return F.array(*(
        F.struct(
            F.lit(start * 3 + pair).cast("byte").alias("shape"),
            fp.bitwiseAND(F.lit(_signed(_place(start, (0, 1, *steps))))).alias("bits"),
        )
        for start in range(SEGMENTS)
        for pair, steps in enumerate(EQUAL_PAIRS)
    ))


def _place(start: int, steps) -> int:
    return sum(0xFF << (WIDTH * ((start + s) % SEGMENTS)) for s in steps)


def within_chain(x: Column, shape: Column) -> Column:
    """Whether the differing bits ``x`` keep every chain budget from the shape's start."""

    def from_start(start: int) -> Column:
        r = _rotated(x, start)
        budgets = [(n, DISTANCE * n // SEGMENTS) for n in range(1, SEGMENTS + 1)]
        # A longer chain with the same budget implies the shorter one.
        tight = [(n, b) for n, b in budgets if (n + 1, b) not in budgets]
        return reduce(lambda a, b: a & b, (F.bit_count(r.bitwiseAND(F.lit(_signed(_mask(range(n)))))) <= b for n, b in tight))

    case = F.when(F.lit(False), F.lit(False))
    for start in range(SEGMENTS):
        case = case.when(F.floor(shape / 3) == start, from_start(start))
    return case


def near_links(fps: DataFrame, crowd: int = 1000) -> DataFrame:
    """Distinct fingerprints ``fps(fp)`` to links ``(a, b)``, enough of them to give the right components."""
    filed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.shape", "k.bits")
    met = staged(
        filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shape", "bits"))).filter("n > 1"), "met"
    )
    few = met.filter(F.col("n") <= crowd)
    other = few.select(F.col("fp").alias("other"), "shape", "bits")
    x = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = (
        few.join(other, ["shape", "bits"])
        .filter((F.col("fp") < F.col("other")) & within_chain(x, F.col("shape")) & (F.bit_count(x) <= DISTANCE))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    return pairs.union(_meeting_links(met.filter(F.col("n") > crowd)))


def _meeting_links(crowded: DataFrame) -> DataFrame:
    """Links under crowded keys by values within one and two flips of the bits outside the key."""
    masks = F.array(*(F.lit(_signed(_place(start, (0, 1, *steps)))) for start in range(SEGMENTS) for steps in EQUAL_PAIRS))
    free = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)),
        lambda one: one.bitwiseAND(F.element_at(masks, F.col("shape") + 1)) == 0,
    )
    two = F.flatten(F.transform("free", lambda a: F.transform(F.filter("free", lambda b: b > a), lambda b: a.bitwiseOR(b))))
    near = F.concat(F.array(F.lit(0).cast("long")), F.col("free"))
    spots = (
        crowded.withColumn("free", free)
        .withColumn("flips", F.concat(F.transform(near, lambda m: F.struct(m.alias("m"), F.lit(True).alias("close"))),
                                      F.transform(two, lambda m: F.struct(m.alias("m"), F.lit(False).alias("close")))))
        .select("fp", "shape", "bits", F.explode("flips").alias("f"))
        .select("fp", "shape", F.col("fp").bitwiseXOR(F.col("f.m")).alias("spot"), "f.close")
    )
    host = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("shape", "spot"))
    return spots.withColumn("host", host).filter("host <> fp").select(F.col("host").alias("a"), F.col("fp").alias("b"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, crowd: int, *more: Column) -> DataFrame:
    """Each row's doc_id, fp and ``more``, and its group's component_id."""
    short_batches(docs.sparkSession)
    marked = staged(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"), *more), "fingerprints")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = components(near_links(marked.select("fp").distinct(), crowd))
    linked = reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = linked.join(least, "component").select("fp", "component_id")
    return marked.join(names, "fp")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    return _labelled(docs, id_col, text_col, crowd).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 1000) -> DataFrame:
    """The rows of least id of each component, with all their columns. A row goes by its id and text together,
    so a repeated id loses only the rows whose text is a copy; rows without id stay."""
    mark = lambda: F.xxhash64(text_col).alias("mark")
    gone = _labelled(docs, id_col, text_col, crowd, mark()).filter("doc_id <> component_id").select("doc_id", "mark")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), mark())
    return whole.join(gone, ["doc_id", "mark"], "left_anti").select("row.*")


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_pigeonring": op3_simhash_pigeonring}
SQL: dict[str, str] = {}
