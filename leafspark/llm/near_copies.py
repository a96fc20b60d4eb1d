"""Near-copy removal: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash bands: forty keys of eight minima each, under at least one of which two
documents of similarity 0.8 meet with probability 0.9994 (0.85: 0.999996). A SimHash radius that covers 0.8
is ten bits and more, which leaves the pigeonring's keys too few bits to file by. Every candidate pair is then
decided on the shingles themselves, so no row goes without a text that is in fact near. Only distinct
shingle sets take part, so copies cost one row each.

Where more than ``crowd`` sets share a key, each is first paired with the sixteen least of them. Groups are then
formed, and a second pass pairs what of a crowded key is still in different groups. So every two near sets that
share a key end in one group, and a crowd of near copies costs rows as its size and not as its square; only
sets that share a crowded key without being near are compared one by one.

Defined results: words are lower-cased bytes between white space; a text of fewer than five words is one
shingle, and one without words the empty shingle; a null text counts as empty; a group is a connected
component of near pairs, and its row of least id stays; rows without an id stay; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from leafspark.llm.common import short_batches, staged
from leafspark.llm.components import components

SEED = 42
WORDS = 5
#: Similarity from which two texts are near, as a fraction.
NEAR = (4, 5)
BANDS, ROWS = 40, 8
#: Nodes of a crowded key that all others of it are paired with.
HOSTS = 16
#: Hashes permuted at once, to bound memory on very long texts.
CHUNK = 512

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_random = np.random.default_rng(SEED)
_FLIPS = _random.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _random.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> set[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < WORDS:
        return {b" ".join(w)}
    return set(map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False)))


def is_near(a: str | None, b: str | None) -> bool:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both * NEAR[1] >= (len(x) + len(y) - both) * NEAR[0]


def sketch(text: str | None) -> tuple[int, np.ndarray]:
    """A name of the text's shingle set, and its keys, as signed 64-bit numbers."""
    found = shingles(text)
    h = np.sort(np.fromiter(map(_hash, found), dtype=np.uint64, count=len(found)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), CHUNK):
        np.minimum(least, ((h[i : i + CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    keys = np.fromiter((xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(BANDS, ROWS))), dtype=np.uint64, count=BANDS)
    return int(np.uint64(_hash(h.tobytes())).astype(np.int64)), keys.view(np.int64)


@F.pandas_udf(StructType().add("node", LongType()).add("keys", ArrayType(LongType())))
def _sketches(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sketch(t) for t in text], columns=["node", "keys"])


@F.pandas_udf(BooleanType())
def _is_near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([is_near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def meetings(sketches: DataFrame) -> DataFrame:
    """``sketches(node, keys)`` of distinct nodes to ``(key, node, n)`` of the keys that several share."""
    filed = sketches.select("node", F.explode("keys").alias("key"))
    hosts = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return staged(filed.join(hosts, "key"), "met")


def candidates(met: DataFrame, crowd: int) -> DataFrame:
    """Pairs ``(a, b)``, each once, a < b: all of a key that few share, and of a crowded key those with its
    least nodes."""
    few = met.filter(F.col("n") <= crowd)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b")
    many = met.filter(F.col("n") > crowd).select("key", "node")
    place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    hosts = many.withColumn("place", place).filter(F.col("place") <= HOSTS).select("key", F.col("node").alias("host"))
    met_hosts = many.join(hosts, "key").filter("node <> host")
    return pairs.union(met_hosts.select(F.least("node", "host").alias("a"), F.greatest("node", "host").alias("b"))).distinct()


def across(met: DataFrame, labels: DataFrame, crowd: int) -> DataFrame:
    """The pairs of crowded keys that ``labels(node, component)`` leaves apart. A key's largest component is never
    paired with itself, so a key whose nodes are all linked gives no row."""
    rows = met.filter(F.col("n") > crowd).select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    rows = staged(rows.join(split.select("key", "main"), "key"), "apart")
    strays = rows.filter("component <> main").select("key", F.col("node").alias("a"), F.col("component").alias("of_a"))
    others = rows.select("key", F.col("node").alias("b"), F.col("component").alias("of_b"), "main")
    pairs = strays.join(others, "key").filter("of_a <> of_b AND (of_b = main OR a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(docs: DataFrame, sketches: DataFrame, text_col: str, crowd: int) -> DataFrame:
    """Near pairs that connect all that are near under a shared key; ``sketches(mark, node, keys)`` of ``docs``."""
    met = meetings(sketches.groupBy("node").agg(F.first("keys").alias("keys")))
    marks = sketches.groupBy("node").agg(F.min("mark").alias("mark")).join(met.select("node").distinct(), "node")
    texts = docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).join(marks, "mark")
    texts = staged(texts.dropDuplicates(["node"]).select("node", "text"), "texts")
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias("text_" + c)) for c in "ab")

    def decided(pairs: DataFrame) -> DataFrame:
        return staged(pairs.join(a, "a").join(b, "b").filter(_is_near("text_a", "text_b")).select("a", "b"), "near")

    near = decided(candidates(met, crowd))
    if met.filter(F.col("n") > crowd).isEmpty():
        return near
    return near.union(decided(across(met, components(near), crowd)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 50) -> DataFrame:
    """The rows of least id of each group, with all their columns. A row goes by its id and text together, so
    a repeated id loses only the rows whose text is a copy; rows without id stay."""
    short_batches(docs.sparkSession)
    marked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), _sketches(F.col(text_col)).alias("s"))
    marked = staged(marked.select("doc_id", "mark", "s.node", "s.keys"), "sketches")
    labels = components(near_pairs(docs, marked, text_col, crowd))
    reps = marked.groupBy("node").agg(F.min("doc_id").alias("rep")).join(labels, "node", "left")
    reps = reps.withColumn("component", F.coalesce("component", "node"))
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    names = reps.join(least, "component").select("node", "least")
    gone = marked.select("doc_id", "mark", "node").join(names, "node").filter("doc_id <> least").select("doc_id", "mark")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"))
    return whole.join(gone, ["doc_id", "mark"], "left_anti").select("row.*")
