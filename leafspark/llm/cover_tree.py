"""Exact top-k search by inner product with cover trees over queries and data.

A node of a tree has a centre, which is one of its points, and the exact greatest distance of its
points from it. Its children's centres are chosen farthest first, the node's own centre being the first:
at the scale they reach they are apart by it and cover all points within it. For a query node with centre
p and radius s and a data node with centre c and radius r no inner product exceeds
p.c + |p| r + |c| s + s r; a pair of nodes whose bound is below the worst kth score of the node's queries
is left out with all that is below it.

The top of the tree over all rows, queries and data together, is fit on at most ``SAMPLE`` rows, the
least by a hash; every row is then filed under its nearest leaf, a cell, and the cells' radii are taken
over all rows. The sample's kth score is each query's first bound. Pairs of cells are pruned by these
radii on the driver: there are at most ``SAMPLE`` cells however many rows there are. Cells fill slots of
about ``SLOT`` rows one after the other, a crowded cell as many as it needs by a hash of its rows, so no
slot grows with the data. A query goes to the slots of the cells that are left for its own, where trees
over the slot's rows and over a batch of queries are descended together, and leaves are then compared
best bound first. Each slot returns at most k rows a query, and a window keeps the best of them.

Results don't depend on the sample: it decides what is pruned. Scores are exact in 64-bit floating
point while every squared norm is below 2^53; with greater ones they are taken in 64-bit integers, and a
squared norm from 2^63 raises ValueError.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors are filled up with zeros; each row with an id divisible by ``every`` is a query, its own row and
no other is left out; rows without id are candidates, last of equal scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import short_batches, staged, table

#: The query's parameters.
GRID, EVERY, K = 1024, 100, 10
#: Rows that the top of the tree is fit on; rows of a slot; children of a node; points of a leaf; of a cell's part of the sample.
SAMPLE, SLOT, FAN, LEAF, CELL = 4096, 1 << 16, 16, 48, 32
#: What rounding may take from a bound, of the greatest product and besides.
ROUNDING, MORE = 1e-9, 1e-3
EXACT = 2.0**53


@dataclass
class Tree:
    """Nodes in arrays, parents before children; ``order`` lists points so that each node's are adjacent."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: list[list[int]]

    @property
    def leaves(self) -> list[int]:
        return [i for i, below in enumerate(self.children) if not below]


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    diff = points - centre
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def build(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    """The cover tree of ``points``. Points at distance zero from their centre aren't parted."""
    order = np.arange(len(points))
    centre, radius, start, end, children = [], [], [], [], []
    work = [(0, len(points), 0, None)] if len(points) else []
    while work:
        a, b, c, parent = work.pop()
        rows = order[a:b]
        away = distances(points[rows], points[c])
        node = len(centre)
        centre.append(c)
        radius.append(float(away.max()))
        start.append(a)
        end.append(b)
        children.append([])
        if parent is not None:
            children[parent].append(node)
        if b - a <= leaf or radius[node] == 0:
            continue
        least, owner, centres = away, np.zeros(b - a, dtype=np.int64), [c]
        while len(centres) < fan and least.max() > 0:
            far = int(rows[least.argmax()])
            to = distances(points[rows], points[far])
            owner[to < least] = len(centres)
            least = np.minimum(least, to)
            centres.append(far)
        by = np.argsort(owner, kind="stable")
        order[a:b] = rows[by]
        edges = a + np.searchsorted(owner[by], np.arange(len(centres) + 1))
        work += [(int(edges[i]), int(edges[i + 1]), x, node) for i, x in enumerate(centres) if edges[i] < edges[i + 1]]
    as_ints = lambda x: np.array(x, dtype=np.int64)
    return Tree(order, as_ints(centre), np.array(radius), as_ints(start), as_ints(end), children)


def bounds(p: np.ndarray, s: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """No inner product of a point within s of p and one within r of c is above these; pairwise by row."""
    far, wide = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (p, c))
    return np.einsum("ij,ij->i", p, c) + far * r + wide * s + s * r + MORE + ROUNDING * (far + s) * (wide + r)


def node_pairs(queries: np.ndarray, q: Tree, data: np.ndarray, d: Tree, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs that may hold a score of at least the query's ``floor``, with their bounds."""
    worst = np.array([floor[q.order[a:b]].min() for a, b in zip(q.start, q.end, strict=True)])
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    inner_q, inner_d = (np.array([bool(x) for x in t.children]) for t in (q, d))
    while len(a):
        top = bounds(queries[q.centre[a]], q.radius[a], data[d.centre[b]], d.radius[b])
        keep = top >= worst[a]
        a, b, top = a[keep], b[keep], top[keep]
        ends = ~(inner_q[a] | inner_d[b])
        done.append((a[ends], b[ends], top[ends]))
        a, b = a[~ends], b[~ends]
        down_q = inner_q[a] & (~inner_d[b] | (q.radius[a] > d.radius[b]))
        next_a = [np.full(len(q.children[x]), y, dtype=np.int64) for x, y in zip(a[down_q], b[down_q], strict=True)]
        pairs = [(np.array(q.children[x], dtype=np.int64), y) for x, y in zip(a[down_q], next_a, strict=True)]
        pairs += [(np.full(len(d.children[y]), x, dtype=np.int64), np.array(d.children[y], dtype=np.int64)) for x, y in zip(a[~down_q], b[~down_q], strict=True)]
        a = np.concatenate([x for x, _ in pairs]) if pairs else a[:0]
        b = np.concatenate([y for _, y in pairs]) if pairs else b[:0]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


@dataclass
class Slot:
    """The rows of one slot: their own numbers, ids with a mark for null ones, and vectors."""

    row: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray
    points: np.ndarray
    tree: Tree


def best(slot: Slot, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place in the slot and score of each query's best k of the slot that reach its ``floor``."""
    q = build(queries)
    a, b, top = node_pairs(queries, q, slot.points, slot.tree, floor)
    by = np.lexsort((-top, a))
    a, b, top = a[by], b[by], top[by]
    kinds = np.float64 if exact else np.int64
    low = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
    for x, y in zip(edges, edges[1:], strict=False):
        node = int(a[x])
        who = q.order[q.start[node] : q.end[node]]
        mine = queries[who].astype(kinds)
        held = np.full((len(who), k), -np.inf)
        at, step = x, 1
        while at < y and top[at] >= low[who].min():
            to = min(y, at + step)
            places = np.concatenate([slot.tree.order[slot.tree.start[n] : slot.tree.end[n]] for n in b[at:to]])
            scores = mine @ slot.points[places].astype(kinds).T
            usable = slot.row[places][None, :] != own[who][:, None]
            held = -np.partition(-np.concatenate([held, np.where(usable, scores, -np.inf)], axis=1), k - 1, axis=1)[:, :k]
            low[who] = np.maximum(low[who], held[:, k - 1])
            i, j = np.nonzero(usable & (scores >= low[who][:, None]))
            found.append((who[i], places[j], scores[i, j]))
            at, step = to, min(32, step * 2)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    who, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= low[who]
    who, place, score = who[keep], place[keep], score[keep]
    by = np.lexsort((slot.ids[place], slot.unnamed[place], -score, who))
    who, place, score = who[by], place[by], score[by]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], place[rank < k], score[rank < k]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers to rows of floats, filled up with zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _placing(centres: np.ndarray, sample: np.ndarray, sample_ids: list, every: int, k: int, width: int):
    """Rows to their cells; queries also get the kth score among the sample's other rows."""
    half = np.einsum("ij,ij->i", centres, centres) / 2
    ids = np.array([-1 if x is None else x for x in sample_ids], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, id_col, vectors = batch.columns
            x = _matrix(vectors, width)
            cell = (x @ centres.T - half).argmax(axis=1)
            diff = x - centres[cell]
            named = id_col.is_valid().to_numpy(zero_copy_only=False)
            vec = id_col.fill_null(1).to_numpy()
            is_query = named & (vec % every == 0)
            floor = np.full(len(x), -np.inf)
            if len(sample) > k:
                scores = x[is_query] @ sample.T
                scores[vec[is_query][:, None] == ids[None, :]] = -np.inf
                floor[is_query] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            away = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            yield pa.RecordBatch.from_arrays(
                [rows, id_col, vectors, pa.array(cell), pa.array(away), pa.array(is_query), pa.array(floor)],
                names=["row", "vec_id", "v", "cell", "away", "is_query", "floor"],
            )

    return place


def _cell_pairs(centres: np.ndarray, cells: list, target: int) -> tuple[list, list]:
    """Where each cell's rows lie on the axis of slots, and the ranges of slots that a cell's queries go to."""
    axis, begin = [], 0
    for c in sorted(cells, key=lambda c: c["cell"]):
        axis.append((c["cell"], begin, c["n"]))
        begin += c["n"]
    c, r = centres[[x[0] for x in axis]], np.array([x["radius"] for x in sorted(cells, key=lambda c: c["cell"])])
    goes = []
    for g in (x for x in cells if x["queries"]):
        n = len(axis)
        top = bounds(np.repeat(centres[g["cell"]][None, :], n, axis=0), np.full(n, g["query_radius"]), c, r)
        ranges: list[list[int]] = []
        for (_, at, rows), reached in zip(axis, top >= g["worst"], strict=True):
            if reached:
                low, high = at // target, (at + rows - 1) // target
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(ranges[-1][1], high)
                else:
                    ranges.append([low, high])
        goes.append((g["cell"], [tuple(x) for x in ranges]))
    return axis, goes


def _searching(k: int, width: int, exact: bool):
    """Rows of slots, each slot's data before its queries, to the best of each query there."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[pa.RecordBatch] = []
        slot, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, kinds = batch.column("slot").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(slots * 2 + kinds, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if slots[a] != at:
                    data, slot, at = [], None, slots[a]
                if not kinds[a]:
                    data.append(part)
                    continue
                if slot is None:
                    if not data:
                        continue
                    rows = pa.Table.from_batches(data).combine_chunks()
                    ids = rows.column("vec_id").combine_chunks()
                    points = _matrix(rows.column("v").combine_chunks(), width)
                    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
                    slot = Slot(rows.column("row").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), unnamed, points, build(points))
                    data = []
                who, place, score = best(slot, _matrix(part.column("v"), width), part.column("row").to_numpy(), part.column("floor").to_numpy(), k, exact)
                took = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(took), part.column("vec_id").take(took), pa.array(slot.ids[place], mask=slot.unnamed[place]), pa.array(score.astype(np.int64))],
                    names=["row", "query_id", "vec_id", "score"],
                )

    return search


def on_grid(vectors: DataFrame, grid: int = GRID, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and ``v``, the components' places on a grid of 1/``grid``; unusable vectors go."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * grid).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, slot_rows: int = SLOT, sample_rows: int = SAMPLE) -> DataFrame:
    """``vectors(vec_id, v array<long>)`` to query_id, rank, vec_id, score: the k greatest inner products of
    each row whose id is divisible by ``every`` with the other rows."""
    spark = vectors.sparkSession
    short_batches(spark)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("square")).first()
    n, width, square = stats["n"], stats["width"] or 0, stats["square"] or 0.0
    if square >= 2.0**63:
        raise ValueError("scores don't fit in 64 bits")
    picked = vectors.withColumn("h", F.xxhash64("vec_id", "v")).orderBy("h", "vec_id").limit(sample_rows).collect()
    sample = np.zeros((len(picked), width))
    for i, x in enumerate(picked):
        sample[i, : len(x["v"])] = x["v"]
    if not width or not n:
        sample = np.zeros((max(1, len(picked)), max(1, width)))
    width = sample.shape[1]
    top = build(sample, leaf=CELL)
    centres = sample[top.centre[top.leaves]]
    ids = [x["vec_id"] for x in picked]
    known = sample if square < EXACT and len(ids) == len(sample) else sample[:0]
    place = _placing(centres, known, ids[: len(known)], every, k, width)
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    placed = staged(numbered.mapInArrow(place, "row long, vec_id long, v array<long>, cell long, away double, is_query boolean, floor double"), "placed")
    asked = F.col("is_query")
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.count_if(asked).alias("queries"),
        F.max(F.when(asked, F.col("away"))).alias("query_radius"), F.min(F.when(asked, F.col("floor"))).alias("worst"),
    ).collect()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // slot_rows), 1)
    target = max(1, -(-n // slots))
    axis, goes = _cell_pairs(centres, cells, target)
    axis = F.broadcast(spark.createDataFrame(axis, "cell long, begin long, rows long"))
    goes = F.broadcast(spark.createDataFrame(goes, "cell long, ranges array<struct<low: long, high: long>>"))
    spread = F.col("begin") + F.pmod(F.xxhash64("row"), F.col("rows"))
    data = placed.join(axis, "cell").select(F.floor(spread / target).cast("int").alias("slot"), F.lit(False).alias("is_query"), "cell", "row", "vec_id", "v", "floor")
    reached = F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"].cast("int"), r["high"].cast("int")))))
    queries = placed.filter(asked).join(goes, "cell").select(reached.alias("slot"), F.lit(True).alias("is_query"), "cell", "row", "vec_id", "v", "floor")
    by_slot = data.union(queries).repartitionById(slots, "slot").sortWithinPartitions("slot", "is_query", "cell")
    found = by_slot.mapInArrow(_searching(k, width, square < EXACT), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(on_grid(table(spark, sf_dir, "embeddings")))


QUERIES = {"op11_cover_tree": op11_cover_tree}
SQL = {
    "op11_cover_tree": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({GRID} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
}
