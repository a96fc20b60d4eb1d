"""Dedup of long repeats by run-compressed Burrows-Wheeler indexes.

Every string of ``LENGTH`` bytes that also starts in a document of smaller id is removed. The corpus is
cut into blocks of whole documents, and the search into buckets that Spark shuffles:

1. A string of 50 bytes has one least-hashed piece of 24 bytes. Consecutive strings with the same piece
   make a run; equal strings are in runs of one piece, and the piece's hash names their bucket. A bucket
   first sees only the 32-bit hashes of each block's pieces and answers which ones two documents share.
2. The runs of shared pieces go to their buckets. There the distinct runs, in order of their smallest
   document, are sorted into a Burrows-Wheeler transform of contexts of 50 bytes. It is kept run-length
   coded; no run crosses from one context into another, so the first row of each context is a run's end
   and its sample names the smallest document of the context. All runs are then streamed backwards
   through the index side by side: each step is one rank query, and where 50 bytes have matched, the
   context is cut back to 49 and the sample at its start is the owner of the match.
3. Matches owned by a smaller document go back to their blocks, where they are joined to spans.

A text that equals one of smaller id is removed whole and takes no part. Nothing is sampled: the hashes
only choose buckets and leave out pieces of which there is just one, and bytes are compared by the index.

Defined results: a null text counts as empty; texts under 50 bytes lose nothing; documents of one id take
nothing from each other; a document without an id neither loses nor takes anything; an empty table gives
no rows; other columns are ignored by ``repeat_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm.common import short_batches, staged, table

LENGTH, PIECE = 50, 24
#: Pieces in a string, and bytes of a block and of a bucket's part of the corpus.
WINDOW = LENGTH - PIECE + 1
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Strings in a run at most, and positions that are hashed at once.
LONGEST, STRIDE = 200, 1 << 18
#: Bytes of runs that are indexed at once.
PART_BYTES = 2 << 20

_BLOCK = "block long, ids array<long>, sizes array<long>, digests array<binary>, data binary"
_U = np.uint64


def _packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _array(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to blocks of whole documents."""
    number, ids, texts, total = TaskContext.get().partitionId() << 32, [], [], 0

    def block() -> pa.RecordBatch:
        digests = [hashlib.sha256(t).digest() for t in texts]
        columns = [[number], [ids], [[*map(len, texts)]], [digests and digests], [_packed(b"".join(texts))]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "sizes", "digests", "data"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if texts and total + len(raw) > BLOCK_BYTES:
                yield block()
                number, ids, texts, total = number + 1, [], [], 0
            ids.append(doc)
            texts.append(raw)
            total += len(raw)
    if texts:
        yield block()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


_POWER = [_U(pow(0x2545F4914F6CDD1D, 1 << k, 1 << 64)) for k in range(4)]


def _least_pieces(data: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes, the least hash of its pieces."""
    h = _mixed(data.astype(_U) + _U(1))
    by_length = {}
    for k in range(4):
        h = h[: -(1 << k)] * _POWER[k] + h[1 << k :]
        by_length[2 << k] = h
    m = _mixed(by_length[16][:-8] * _POWER[3] + by_length[8][16:])
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    return np.minimum(m[: -(WINDOW - 16)], m[WINDOW - 16 :])


def _runs(data: np.ndarray, ids: list, sizes: np.ndarray, skip: np.ndarray):
    """(start, strings, document's place, hash) of the runs of a block's documents but those to skip."""
    starts = np.cumsum(sizes) - sizes
    # The last place in each document where a string starts; none in those that take no part.
    take = (sizes >= LENGTH) & ~skip & np.array([x is not None for x in ids], dtype=bool)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(data) - LENGTH + 1, 0), STRIDE):
        m = _least_pieces(data[at : at + STRIDE + LENGTH - 1])
        place = np.arange(at, at + len(m))
        doc = np.searchsorted(starts, place, side="right") - 1
        good = take[doc] & (place + LENGTH <= starts[doc] + sizes[doc])
        new = np.ones(len(m), dtype=bool)
        new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        ends = np.flatnonzero(np.append(new | ~good, True))
        count = ends[np.searchsorted(ends, first, side="right")] - first
        pieces = -(-count // LONGEST)
        index = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[index] + nth * LONGEST
        for k, x in enumerate((begin + at, np.minimum(LONGEST, count[index] - nth * LONGEST), doc[begin], m[begin])):
            out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, dtype=_U if k == 3 else np.int64) for k, x in enumerate(out)]


def _hash_of(m: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 32 bits that stand for the piece in it."""
    m = _mixed(m)
    return ((m >> _U(32)) % _U(buckets)).astype(np.int64), (m & _U(0xFFFFFFFF)).astype(np.uint32)


def _piece_sets(buckets: int):
    """Blocks to the pieces each bucket sees of them, with whether two documents of the block share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                _, _, doc, m = _runs(_array(row["data"], np.uint8), row["ids"], sizes, np.zeros(len(sizes), dtype=bool))
                bucket, key = _hash_of(m, buckets)
                whole = bucket.astype(_U) << _U(32) | key.astype(_U)
                order = np.argsort(whole, kind="stable")
                whole, doc = whole[order], doc[order]
                head = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
                last = np.append(head[1:], len(whole)) - 1
                # Documents stand in order within a piece.
                many = doc[head] != doc[last] if len(head) else np.zeros(0, dtype=bool)
                whole = whole[head]
                of = (whole >> _U(32)).astype(np.int64)
                cut = np.searchsorted(of, np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cut))
                keys = (whole & _U(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([row["block"]] * len(used), pa.int64()),
                     pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary()),
                     pa.array([np.packbits(many[cut[b] : cut[b + 1]]).tobytes() for b in used], pa.binary())], ["bucket", "block", "keys", "many"]
                )

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Which of a bucket's pieces are in two documents, as the keys of each block that are."""
    keys = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["keys"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(k)] for x, k in zip(rows["many"], keys, strict=True)])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    sort = flat[order]
    head = np.append(True, sort[1:] != sort[:-1])
    at = np.flatnonzero(head)
    shared = (np.diff(np.append(at, len(sort))) > 1) | (np.maximum.reduceat(many[order], at) > 0)
    good = np.zeros(len(flat), dtype=bool)
    good[order] = shared[np.cumsum(head) - 1]
    ends = np.cumsum([len(k) for k in keys])
    parts = [k[good[e - len(k) : e]].tobytes() for k, e in zip(keys, ends, strict=True)]
    return pa.table([rows["bucket"], rows["block"], pa.array(parts, pa.binary())], ["bucket", "block", "keys"])


def _send_runs(buckets: int):
    """A block, its shared pieces and its whole copies to the runs that go to each bucket."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for row in blocks.to_pylist():
            sizes = np.array(row["sizes"], dtype=np.int64)
            skip = np.zeros(len(sizes), dtype=bool)
            known = []
            for bucket, keys, copies in zip(replies["bucket"].to_pylist(), replies["keys"], replies["copies"].to_pylist(), strict=True):
                if copies is not None:
                    skip[copies] = True
                else:
                    known.append(np.frombuffer(keys.as_buffer(), "<u4").astype(_U) | _U(bucket << 32))
            data = _array(row["data"], np.uint8)
            start, count, doc, m = _runs(data, row["ids"], sizes, skip)
            bucket, key = _hash_of(m, buckets)
            shared = np.sort(np.concatenate(known)) if known else np.zeros(0, dtype=_U)
            whole = bucket.astype(_U) << _U(32) | key.astype(_U)
            found = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, whole), max(len(shared) - 1, 0))] == whole) if len(shared) else np.zeros(0, np.int64)
            found = found[np.argsort(bucket[found], kind="stable")]
            cut = np.searchsorted(bucket[found], np.arange(buckets + 1))
            ids = np.array([x or 0 for x in row["ids"]], dtype=np.int64)
            for b in np.flatnonzero(np.diff(cut)):
                own = found[cut[b] : cut[b + 1]]
                size = count[own] + LENGTH - 1
                text = data[np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                for k, x in enumerate((int(b), row["block"], _packed(np.stack([start[own], size, ids[doc[own]]]).astype("<i8")), _packed(key[own].astype("<u4")), _packed(text))):
                    out[k].append(x)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["bucket", "block", "places", "keys", "text"])

    return run


class RunLengthIndex:
    """The run-length coded transform of texts, each ended by a symbol of its own kind (0), with the
    number of the first text that has it as the sample at each context's first row."""

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        """``text``: symbols 0 to 256; ``owner``: of each symbol, the number of its text, ascending."""
        n = self.n = len(text)
        padded = np.concatenate([text, np.zeros(LENGTH, dtype=text.dtype)]).astype(np.int64)
        key = padded[:n].copy()
        for k in range(1, 7):
            key = key * 257 + padded[k : n + k]
        rank = self._ranks(key)
        for width in (7, 14):
            rank = self._ranks(rank * (n + 1) + self._shifted(rank, width))
        # 28 symbols and the 28 that end the context are the context's 50, and likewise 49.
        by_49 = rank * (n + 1) + self._shifted(rank, LENGTH - 1 - 28)
        by_50 = rank * (n + 1) + self._shifted(rank, LENGTH - 28)
        rows = np.argsort(by_50, kind="stable")
        context = np.append(True, by_50[rows][1:] != by_50[rows][:-1])
        self.shorter = np.append(np.flatnonzero(np.append(True, by_49[rows][1:] != by_49[rows][:-1])), n)
        before = text[rows - 1].astype(np.int64)
        new = context.copy()
        new[1:] |= before[1:] != before[:-1]
        self.start = np.flatnonzero(new)
        self.sample = owner[rows[self.start]]
        head, size = before[self.start], np.diff(np.append(self.start, n))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=257))])
        order = np.argsort(head, kind="stable")
        self.keys = head[order] * (n + 1) + self.start[order]
        self.sizes = size[order]
        total = np.cumsum(self.sizes) - self.sizes
        # Of the runs of one symbol, those before: the symbol's rows before the run.
        self.before = total - self.first[head[order]]

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        sort = key[order]
        out = np.empty(len(key), dtype=np.int64)
        out[order] = np.cumsum(np.append(1, sort[1:] != sort[:-1]))
        return out

    @staticmethod
    def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), dtype=rank.dtype)])

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first row of the symbol followed by what the row's interval stands for."""
        q = symbol * (self.n + 1)
        j = np.searchsorted(self.keys, q + row) - 1
        key = self.keys[j]
        own = (j >= 0) & (key >= q)
        rank = np.where(own, self.before[j] + np.minimum(row - (key - q), self.sizes[j]), 0)
        return self.first[symbol] + rank

    def owners(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The owner of every string of LENGTH symbols of the texts that end (exclusive) at ``ends``; the
        texts are streamed backwards, all of them a symbol at a time."""
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        strings = sizes - LENGTH + 1
        base = np.empty(len(order), dtype=np.int64)
        in_order = np.empty(len(order), dtype=np.int64)
        in_order[order] = strings
        base = (np.cumsum(in_order) - in_order)[order]
        out = np.empty(int(strings.sum()), dtype=np.int64)
        row = np.zeros(len(order), dtype=np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -t))
            at = row[:active]
            if t >= LENGTH:
                at = self.shorter[np.searchsorted(self.shorter, at, side="right") - 1]
            at = self.back(text[ends[:active] - 1 - t].astype(np.int64), at)
            row[:active] = at
            if t >= LENGTH - 1:
                out[base[:active] + sizes[:active] - 1 - t] = self.sample[np.searchsorted(self.start, at)]
        return out


def _owned(strings: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs and their documents to (run, begin, end) of what documents of smaller id own."""
    coded = strings.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    # Distinct runs in order of their smallest document.
    order = np.argsort(least, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    number, least = place[number], least[order]
    distinct = coded.dictionary.take(pa.array(order))
    off = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(order) + 1]
    length = np.diff(off)
    symbols = np.zeros(int(off[-1]) + len(order), dtype=np.int32)
    inside = np.arange(int(off[-1])) + np.repeat(np.arange(len(order)), length)
    symbols[inside] = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)[: off[-1]].astype(np.int32) + 1
    index = RunLengthIndex(symbols, np.repeat(np.arange(len(order)), length + 1))
    owned = least[index.owners(symbols, off[1:] + np.arange(len(order)), length)]
    # Every run against the owners of its strings.
    count = length - LENGTH + 1
    base = np.cumsum(count) - count
    n = count[number]
    first = np.cumsum(n) - n
    hit = owned[np.repeat(base[number] - first, n) + np.arange(int(n.sum()))] < np.repeat(doc, n)
    edge = np.zeros(len(hit), dtype=bool)
    edge[first] = True
    begin = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    end = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)))
    run = np.searchsorted(first, begin, side="right") - 1
    return run, begin - first[run], end - first[run] + LENGTH


def _matches(rows: pa.Table) -> pa.Table:
    """A bucket's runs to the spans that a smaller document owns, by block."""
    blocks = rows["block"].to_pylist()
    places = [_array(x.as_py(), "<i8").reshape(3, -1) for x in rows["places"]]
    start, size, doc = np.concatenate(places, axis=1)
    block = np.repeat(np.arange(len(blocks)), [p.shape[1] for p in places])
    key = np.concatenate([_array(x.as_py(), "<u4") for x in rows["keys"]])
    raw = np.concatenate([_array(x.as_py(), np.uint8) for x in rows["text"]])
    # Pieces of one document only, once whole copies are left out, are of no use.
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    lonely = np.minimum.reduceat(doc[order], at) == np.maximum.reduceat(doc[order], at)
    good = np.ones(len(key), dtype=bool)
    good[order] = ~np.repeat(lonely, np.diff(np.append(at, len(key))))
    offsets = np.concatenate([[0], np.cumsum(size)])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    # A piece's runs stay together, so that the pieces can be taken in parts of bounded size.
    keep = np.flatnonzero(good)
    parts = int(size[keep].sum()) // PART_BYTES + 1
    found = []
    for part in range(parts):
        own = keep[key[keep] % parts == part]
        if len(own):
            run, begin, end = _owned(strings.take(pa.array(own)), doc[own])
            found.append(np.stack([own[run], start[own[run]] + begin, start[own[run]] + end]))
    run, begin, end = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    order = np.argsort(block[run], kind="stable")
    run, spans = run[order], np.stack([begin, end])[:, order]
    cut = np.searchsorted(block[run], np.arange(len(blocks) + 1))
    used = np.flatnonzero(np.diff(cut))
    return pa.table(
        [pa.array([blocks[k] for k in used], pa.int64()), pa.array([_packed(spans[:, cut[k] : cut[k + 1]].astype("<i8")) for k in used], pa.binary())],
        ["block", "spans"],
    )


def _removed(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """A block with its spans and whole copies to one row a document."""
    out: list[list] = [[], [], [], [], []]
    for row in blocks.to_pylist():
        data = _array(row["data"], np.uint8)
        sizes = np.array(row["sizes"], dtype=np.int64)
        ends = np.cumsum(sizes)
        change = np.zeros(len(data) + 1, dtype=np.int64)
        for spans, copies in zip(replies["spans"].to_pylist(), replies["copies"].to_pylist(), strict=True):
            if copies is not None:
                copies = np.array(copies, dtype=np.int64)
                copies = copies[sizes[copies] >= LENGTH]
                np.add.at(change, ends[copies] - sizes[copies], 1)
                np.add.at(change, ends[copies], -1)
            else:
                begin, end = _array(spans, "<i8").reshape(2, -1)
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        for doc, a, b in zip(row["ids"], ends - sizes, ends, strict=True):
            own = gone[a:b]
            kept = data[a:b][~own]
            n_spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            for k, x in enumerate((doc, b - a, int(own.sum()), n_spans, kept.tobytes())):
                out[k].append(x)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, and the bytes kept."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = staged(texts.mapInArrow(_blocks, _BLOCK), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), 4 * spark.sparkContext.defaultParallelism)
    # Whole copies of a text of smaller id, by their places in each block.
    listed = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "doc")).select(
        "block", "place", F.col("doc.ids").alias("id"), F.col("doc.digests").alias("digest")
    )
    listed = listed.filter("id is not null")
    least = listed.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    copies = listed.join(least, "digest").filter("id > least").groupBy("block").agg(F.collect_list("place").alias("copies"))
    copies = staged(copies, "copies")

    pieces = blocks.mapInArrow(_piece_sets(buckets), "bucket long, block long, keys binary, many binary")
    shared = staged(pieces.groupBy("bucket").applyInArrow(_shared, "bucket long, block long, keys binary"), "shared")
    # A block without shared pieces has no strings to send.
    replies = shared.select("block", "bucket", "keys", F.lit(None).cast("array<int>").alias("copies")).union(
        copies.select("block", F.lit(None).cast("long"), F.lit(None).cast("binary"), "copies")
    )
    sent = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _send_runs(buckets), "bucket long, block long, places binary, keys binary, text binary"
    )
    spans = staged(sent.groupBy("bucket").applyInArrow(_matches, "block long, spans binary"), "spans")
    marks = spans.withColumn("copies", F.lit(None).cast("array<int>")).union(copies.select("block", F.lit(None).cast("binary"), "copies"))
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_run_length_index": op4_run_length_index}
SQL: dict[str, str] = {}
