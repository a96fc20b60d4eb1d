"""Prefix trie of conversations from sorted turn arrays.

A turn becomes the SHA-256 of its role and text and the count of its words, so texts aren't shuffled.
Turn arrays are range-sorted over the whole table by (turns, conv_id): a node of the trie is an
interval of adjacent rows whose longest common prefixes reach its depth. Each task sweeps its rows with
a stack of open intervals; the common prefix of a row and the one before says how many of them close.
Intervals on the path of a task's first or last row may go on next door; they leave as partial sums, two
paths a partition at most, and one ordered scan over these stitches them with the same stack. Sums over
a subtree are carried up as intervals close. Parents are joined by the ids that tasks give to nodes:
a node that crosses partitions has one in each, so its children don't share one key.

Many copies of one conversation cross partitions by their ids; the decimal ids that end at a node reach
the stitching in pieces of ``PIECE`` bytes, since SHA-256 over a sequence has to be taken in order. A
conversation is one row of digests, so its number of turns is bounded by a task's memory. The driver
gathers a sample of turn arrays for the splitters and nothing else.

Defined results: null role and text are empty; turns are ordered by number, null first, then by digest;
repeated rows are further turns; rows without conv_id take no part; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm.common import short_batches, staged, table

WORD = r"[^\x20\x09-\x0D]+"
#: The query's parameters: conversations begin as the first of their twenty does.
FAMILY, HEAD = 20, 4
#: Bytes of one piece of ids, and rows of one batch of nodes.
PIECE, ROWS = 1 << 20, 4096

#: ``open`` rows are parts of a node that may cross partitions, ``alias`` rows name what a node is called.
_NODES = (
    "kind string, part long, seq long, id long, parent long, depth long, digest binary, conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, words long, ends binary"
)
_SCHEMA = pa.schema(
    [("kind", pa.string()), *((c, pa.int64()) for c in ("part", "seq", "id", "parent", "depth")), ("digest", pa.binary()),
     *((c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "words")), ("ends", pa.binary())]
)


class _Node:
    """An open interval: what is known so far of a node. ``ends`` holds ",id" for each member of its length."""

    __slots__ = ("digest", "ids", "least", "convs", "children", "leaves", "saved", "words", "ends", "first", "sha")

    def __init__(self, digest: bytes, id_: int, words: int, first: bool):
        self.digest, self.ids, self.words, self.first = digest, [id_], words, first
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.sha = bytearray(), None

    def take(self, least: int | None, convs: int, children: int, leaves: int, saved: int) -> None:
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def hash(self, ids: bytes) -> None:
        """Adds ids that end here; the first comma of all is left out."""
        if ids:
            fresh = self.sha is None
            self.sha = hashlib.sha256() if fresh else self.sha
            self.sha.update(ids[1:] if fresh else ids)

    def close(self, parent: _Node | None) -> None:
        """All members are known: the node's own part of its subtree's sums, handed to the parent."""
        self.hash(bytes(self.ends))
        self.leaves += not self.children
        self.saved += (self.convs - 1) * self.words
        if parent is not None:
            parent.take(self.least, self.convs, 1, self.leaves, self.saved)

    def row(self, kind: str, depth: int, parent: int | None, part: int = 0, seq: int = 0, ends: bytes | None = None) -> dict:
        done = ((self.sha or hashlib.sha256()).hexdigest()).encode() if ends is None else ends
        return {
            "kind": kind, "part": part, "seq": seq, "id": self.ids[0], "parent": parent, "depth": depth, "digest": self.digest, "conv_id": self.least,
            "n_convs": self.convs, "n_children": self.children, "n_leaves": self.leaves, "saved": self.saved, "words": self.words, "ends": done,
        }


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)


def _closed(stack: list[_Node], depth: int) -> Iterator[tuple[_Node, int, int | None]]:
    """Closes the open intervals below ``depth``: node, its depth and its parent's id."""
    while len(stack) > depth:
        node = stack.pop()
        parent = stack[-1] if stack else None
        if not node.first:
            node.close(parent)
        yield node, len(stack), parent.ids[0] if parent else None


def _sweep(piece: int):
    """Sorted turn arrays of one partition to its nodes and the parts of those that may cross it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stack, path, part, made, before = [], [], 0, 0, None
        for batch in batches:
            for conv, digests, words, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):  # noqa: B007
                common = 0
                if before is None:
                    stack.append(_Node(b"", part << 40, 0, True))
                    made = 1
                else:
                    for a, b in zip(before, digests, strict=False):
                        if a != b:
                            break
                        common += 1
                    for node, depth, parent in _closed(stack, common + 1):
                        if not node.first:
                            yield node.row("node", depth, parent)
                for digest, count in zip(digests[common:], words[common:], strict=True):
                    stack.append(_Node(digest, part << 40 | made, count, before is None))
                    made += 1
                if before is None:
                    path = list(stack)
                stack[-1].take(conv, 1, 0, 0, 0)
                stack[-1].ends += b",%d" % conv
                before = digests
        seq = 0
        for depth, node in [*enumerate(path), *((i, n) for i, n in enumerate(stack) if not n.first)]:
            for at in range(0, max(1, len(node.ends)), piece):
                yield node.row("open", depth, None, part, seq, bytes(node.ends[at : at + piece]))
                node.least, node.convs, node.children, node.leaves, node.saved, seq = None, 0, 0, 0, 0, seq + 1

    return lambda batches: _batched(rows(batches))


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in the partitions' order, each partition's first path and then its last, to whole nodes."""

    def done(stack: list[_Node], depth: int) -> Iterator[dict]:
        for node, at, parent in _closed(stack, depth):
            yield node.row("node", at, parent)
            for alias in node.ids:
                yield node.row("alias", at, parent) | {"id": alias, "ends": None}

    def rows() -> Iterator[dict]:
        stack: list[_Node] = []
        for batch in batches:
            for r in batch.to_pylist():
                depth = r["depth"]
                if depth < len(stack) and stack[depth].digest == r["digest"]:
                    if stack[depth].ids[-1] != r["id"]:
                        stack[depth].ids.append(r["id"])
                else:
                    yield from done(stack, depth)
                    stack.append(_Node(r["digest"], r["id"], r["words"], False))
                stack[depth].take(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"])
                stack[depth].hash(r["ends"])
        yield from done(stack, 0)

    return _batched(rows())


def turn_arrays(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its ``turns`` in order, each a struct of digest and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = convs.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.unhex(F.sha2(marked.cast("binary"), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"),
    )
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns"))


def family_heads(arrays: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """Arrays whose first h turns are those of the first conversation of their family, h = crc32(id) mod ``head``."""
    firsts = arrays.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, head - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    own: Column = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head_turns = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return arrays.join(firsts, F.col("first") == F.col("conv_id") - F.col("conv_id") % family, "left").select("conv_id", F.concat(head_turns, own).alias("turns"))


def prefix_trie(arrays: DataFrame, piece: int = PIECE) -> DataFrame:
    """``arrays(conv_id, turns)`` to one row for each node of their trie; see the contract's columns."""
    spark = arrays.sparkSession
    short_batches(spark)
    flat = staged(arrays.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")), "turns")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = flat.repartitionByRange(parts, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    swept = staged(ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_sweep(piece), _NODES), "intervals")
    seams = swept.filter("kind = 'open'").repartition(1).sortWithinPartitions("part", "seq")
    stitched = staged(seams.mapInArrow(_stitch, _NODES), "stitched")
    nodes = swept.union(stitched).filter("kind = 'node'")
    names = swept.filter("kind = 'node' AND n_children > 0").union(stitched.filter("kind = 'alias'"))
    names = names.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(names, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").cast("string").alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(family_heads(turn_arrays(table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": rf"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295) % {HEAD} AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
nodes AS (
  SELECT turns[1:depth] AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM p GROUP BY ALL),
w AS (
  SELECT a.*, (SELECT count(*) FROM nodes b WHERE b.depth = a.depth + 1 AND b.key[1:a.depth] = a.key) AS n_children,
         (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(key[depth].text, '{WORD}')) END AS saved
  FROM nodes a),
up AS (SELECT key[1:d] AS key, d AS depth, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w)),
sums AS (SELECT key, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sums USING (key, depth) LEFT JOIN nodes parent ON parent.depth = w.depth - 1 AND parent.key = w.key[1:w.depth - 1]
"""
}
