"""Byte-level BPE encoding and decoding.

Spark splits the texts by the vocabulary's pattern. Blocks of whole documents are shuffled as the numbers
of their words and a list of their distinct words. All blocks' distinct words are shuffled by word, so that
each is folded once in the corpus: higher-order functions fold the ranked merges over its byte ids. The
tokens go back to the blocks that asked, where the documents are put together.

The rank map is a literal: an array of (pair, rank) entries placed by hash and displacement, so that a
pair is found by two array reads. The fold keeps a word's ids and the ranks of its neighbouring pairs; a merge
asks for the two new pairs alone. Decoding reads each id's piece from a literal array, in hexadecimal,
joins the pieces and turns them into bytes, all in Spark.

A block holds at most ``block_words`` words or one document. It sends a word once, however often it stands
there, and a bucket of words grows with the number of distinct words that the blocks send, not with a word.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; any UTF-8 text round-trips; an empty table gives no rows; other
columns are ignored. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from leafspark.llm.common import short_batches, table

#: Ranks and token ids have so many bits; what doesn't merge looks up a greater number.
RANK_BITS = 17
NEVER = 1 << RANK_BITS
#: To the end of an array.
REST = 1 << 30
BLOCK_WORDS = 3_000_000
#: Words in one row of the fold, and bytes of stored input for a task of the fold.
CHUNK, TASK_BYTES = 250, 16 << 20
#: Characters of a plan's description.
PLAN_CHARS = 1 << 16
#: Tokens in a batch of documents.
OUT_TOKENS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _xxh64(x: np.ndarray, seed) -> np.ndarray:
    """XXH64 of longs, as the SQL function xxhash64 has it."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, dtype=np.uint64) + p5 + np.uint64(8)
        h = turn(h ^ (turn(x.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


class RankMap:
    """The pairs of tokens that join to a token, as literal arrays for SQL.

    A pair is one number, left then right. Its hash finds a displacement, and the hash with that the
    pair's own slot. The entry there is XORed with the pair: what is left is the rank if the pair has
    one, and NEVER or more if it hasn't.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.pad = max(ranks.values()) + 1
        if self.pad >= NEVER - 1:
            raise ValueError("more tokens than the rank map has bits for")
        pairs = {
            left << RANK_BITS | right: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        }
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        self.slot_bits = max(8, int(len(keys) * 1.15).bit_length())
        self.bucket_mask = (1 << (self.slot_bits - 2)) - 1
        self.moves, self.entries = self._placed(keys, values)
        self.bytes_ = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Of each pair of single bytes.
        self.first = np.full((256, 256), NEVER, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    def _placed(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashed = _xxh64(keys, 42)
        bucket = (hashed & np.uint64(self.bucket_mask)).astype(np.int64)
        moves = np.zeros(self.bucket_mask + 1, dtype=np.int64)
        # An empty slot has a pair that no token is the right of.
        entries = np.full(1 << self.slot_bits, (NEVER - 1) << RANK_BITS, dtype=np.int64)
        taken = np.zeros(1 << self.slot_bits, dtype=bool)
        # Every bucket, the fullest first, looks for a displacement that sends its keys to free slots.
        fullness = np.bincount(bucket)[bucket]
        for full in np.unique(fullness)[::-1]:
            left = np.flatnonzero(fullness == full)
            for move in range(1 << 15):
                if not len(left):
                    break
                slot = (_xxh64(np.full(len(left), move), hashed[left]) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
                head = np.unique(slot, return_index=True)[1]
                good = np.zeros(len(left), dtype=bool)
                good[head] = ~taken[slot[head]]
                refused = np.zeros(self.bucket_mask + 1, dtype=bool)
                refused[bucket[left[~good]]] = True
                done = ~refused[bucket[left]]
                entries[slot[done]] = keys[left[done]] << RANK_BITS | values[left[done]]
                taken[slot[done]] = True
                moves[bucket[left[done]]] = move
                left = left[~done]
            else:
                raise ValueError("the rank map does not fit its slots")
        return moves, entries

    @staticmethod
    def _literal(x: np.ndarray) -> Column:
        # One string that the optimizer turns into an array once.
        return F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast("array<bigint>")

    def literal(self) -> Column:
        """The map as one value."""
        return F.struct(self._literal(self.moves).alias("moves"), self._literal(self.entries).alias("entries"))

    def look_up(self, pairs: Column, literal: Column) -> Column:
        """An array of pairs, each left then right, to their ranks; NEVER or more where there is none."""

        def rank(pair: Column) -> Column:
            move = F.get(literal["moves"], F.xxhash64(pair).bitwiseAND(F.lit(self.bucket_mask)).cast("int"))
            slot = F.shiftrightunsigned(F.xxhash64(pair, move), 64 - self.slot_bits).cast("int")
            return F.get(literal["entries"], slot).bitwiseXOR(F.shiftleft(pair, RANK_BITS))

        return F.transform(pairs, rank)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(word: Column, ranks: RankMap, literal: Column) -> Column:
    """A word, as its byte ids ``t`` between two pads and the ranks ``r`` of their neighbouring pairs, to
    its tokens between pads: a fold that joins the least-ranked pair, leftmost first, until none joins."""

    def pair(left: Column, right: Column) -> Column:
        return F.shiftleft(left, RANK_BITS).bitwiseOR(right)

    def join(s: Column) -> Column:
        t, r = s["t"], s["r"]

        def at(i: Column) -> Column:
            # r[i - 1] is the rank of the pair at t[i - 1] and t[i], and the id of what they join to.
            new = F.get(r, i - 1)
            return F.struct(
                F.concat(F.slice(t, F.lit(1), i - 1), F.array(new), F.slice(t, i + 2, F.lit(REST))).alias("t"),
                F.concat(
                    F.slice(r, F.lit(1), i - 2),
                    ranks.look_up(F.array(pair(F.get(t, i - 2), new), pair(new, F.get(t, i + 1))), literal),
                    F.slice(r, i + 2, F.lit(REST)),
                ).alias("r"),
            )

        return F.when(F.array_min(r) < NEVER, _let(F.array_position(r, F.array_min(r)).cast("int"), at)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(3), F.size(word["r"])), word, lambda s, _: join(s), lambda s: s["t"])


def _text_of(words: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of words."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    return np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1], memoryview(words.buffers()[2] or b"")


def _starts(ranks: RankMap, kind: pa.DataType):
    """A function from words to the state the fold begins with."""
    byte_ids, first, pad = ranks.bytes_, ranks.first, ranks.pad

    def starts(words: pa.Array) -> pa.Array:
        words = words.cast(pa.large_binary())
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + n + 1]
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        word = np.repeat(np.arange(n), size)
        # Pads stand before and after each word; a rank stands between any two neighbours.
        t = np.full(len(raw) + 2 * n, pad, dtype=np.int64)
        t[np.arange(len(raw)) + 2 * word + 1] = byte_ids[raw]
        r = np.full(len(raw) + n, NEVER, dtype=np.int64)
        inner = np.ones(len(raw), dtype=bool)
        inner[offsets[1:] - 1] = False
        pairs = np.flatnonzero(inner)
        r[pairs + word[pairs] + 1] = first[raw[pairs], raw[pairs + 1]]
        steps = np.arange(n + 1)
        lists = [pa.ListArray.from_arrays((offsets + k * steps).astype(np.int32), x) for k, x in ((2, t), (1, r))]
        return pa.StructArray.from_arrays(lists, fields=list(kind))

    return starts


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their bytes' places, lowest first, which compress better so."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(block_words: int, schema: pa.Schema):
    """Batches of (doc_id, words) to blocks: documents, how many words each has, all their words by number
    and the distinct words, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (ids, words, counts, total) = TaskContext.get().partitionId() << 32, ([], [], [], 0)

        def block() -> pa.RecordBatch:
            coded = pa.chunked_array(words).combine_chunks() if len(words) > 1 else words[0]
            indices = coded.indices.to_numpy(zero_copy_only=False)
            often = np.argsort(-np.bincount(indices, minlength=len(coded.dictionary)), kind="stable")
            place = np.empty(len(often), dtype=np.int64)
            place[often] = np.arange(len(often))
            offsets, text = _text_of(coded.dictionary.take(pa.array(often)))
            one = lambda x, f: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=f.type)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), one(pa.concat_arrays(ids), schema.field(1)), one(pa.array(np.concatenate(counts), pa.int32()), schema.field(2)),
                 pa.array([_planes(place[indices])], pa.binary()), pa.array([_planes(np.diff(offsets))], pa.binary()),
                 pa.array([zstandard.compress(text[: offsets[-1]], 3)], pa.binary())], schema=schema
            )

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if total and total + len(flat) > block_words:
                yield block()
                number, (ids, words, counts, total) = number + 1, ([], [], [], 0)
            ids.append(batch.column(0))
            words.append(flat.dictionary_encode())
            if len(words) % 16 == 0:  # one dictionary for all so far
                words = [pa.chunked_array(words).unify_dictionaries().combine_chunks()]
                pa.default_memory_pool().release_unused()
            counts.append(lists.value_lengths().to_numpy(zero_copy_only=False))
            total += len(flat)
        if ids:
            words = [pa.chunked_array(words).unify_dictionaries().combine_chunks()]
            yield block()

    return run


def _places(x: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return _planes(np.diff(x, prepend=0))


def _asked(buckets: int):
    """Blocks to their distinct words, parted by a hash of the word: places in the block, sizes, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, _, _, _, sizes, data = (c[k].as_py() for c in batch.columns)
                offsets = np.concatenate([[0], np.cumsum(_numbers(sizes).astype(np.int64))])
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(data))])
                bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                offsets, text = _text_of(words.take(pa.array(order)))
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cut))
                parts = [(cut[b], cut[b + 1]) for b in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([number] * len(used), pa.int64()), pa.array([_places(order[a:b]) for a, b in parts], pa.binary()),
                     pa.array([_planes(np.diff(offsets[a : b + 1])) for a, b in parts], pa.binary()),
                     pa.array([zstandard.compress(text[offsets[a] : offsets[b]], 3) for a, b in parts], pa.binary())], ["bucket", "block", "places", "sizes", "data"]
                )

    return run


def _pack(ranks: RankMap, schema: pa.Schema):
    """A bucket's words to rows of some hundred distinct ones as the fold begins with them, and, for each
    block that has them, the word's number, block and place, compressed."""
    starts = _starts(ranks, schema.field("words").type.value_type)

    def packed(rows: list) -> Iterator[pa.RecordBatch]:
        block, places, sizes, data = zip(*rows, strict=True)
        places = [np.cumsum(_numbers(x.as_py()).astype(np.int64)) for x in places]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([_numbers(x.as_py()) for x in sizes]).astype(np.int64))])
        raw = b"".join(zstandard.decompress(x.as_py()) for x in data)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(which, kind="stable")
        which, place = which[order], np.concatenate(places)[order]
        block = np.repeat([b.as_py() for b in block], [*map(len, places)])[order]
        for at in range(0, len(coded.dictionary), CHUNK):
            part = coded.dictionary.slice(at, CHUNK)
            own = slice(*np.searchsorted(which, [at, at + len(part)]))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), starts(part), type=schema.field(0).type), pa.array([_places(which[own] - at)], pa.binary()),
                 pa.array([_planes(np.concatenate([block[own] >> 32, block[own] & 0xFFFFFFFF]))], pa.binary()), pa.array([_planes(place[own])], pa.binary())], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for bucket, *row in zip(*batch.columns, strict=True):
                if rows and bucket.as_py() != last:
                    yield from packed(rows)
                    rows = []
                last = bucket.as_py()
                rows.append(row)
        if rows:
            yield from packed(rows)

    return run


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words' tokens to, for each block that has some of them, their places, sizes and tokens."""
    for batch in batches:
        lists = batch.column(0)
        words = lists.flatten()
        if not len(words):
            continue
        flat = words.flatten().to_numpy(zero_copy_only=False)
        padded = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        # Less the pads around each word.
        start, size = np.cumsum(padded) - padded + 1, padded - 2
        per_row = lists.value_lengths().to_numpy(zero_copy_only=False)
        whole = lambda k: [_numbers(x.as_py()).astype(np.int64) for x in batch.column(k)]
        which = np.concatenate([np.cumsum(x) + b for x, b in zip(whole(1), np.cumsum(per_row) - per_row, strict=True)])
        # Of block numbers the upper halves stand before the lower ones.
        high, low = np.concatenate([x.reshape(2, -1) for x in whole(2)], axis=1)
        block, place = high << 32 | low, np.concatenate(whole(3))
        order = np.lexsort((place, block))
        which, block, place = which[order], block[order], place[order]
        head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        n = size[which]
        tokens = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.cumsum(n)
        cuts = [*zip(head, np.append(head[1:], len(block)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[head], pa.int64()), pa.array([_places(place[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(n[a:b]) for a, b in cuts], pa.binary()),
             pa.array([_planes(tokens[ends[a] - n[a] : ends[b - 1]]) for a, b in cuts], pa.binary())], ["block", "places", "sizes", "tokens"]
        )


def _documents(schema: pa.Schema):
    """A block and its words' tokens to one row a document."""

    def batch(docs: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([*map(len, parts)], dtype=np.int64)
        offsets, tokens = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate(parts)
        raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(4 * offsets), pa.py_buffer(tokens)])
        return pa.RecordBatch.from_arrays([docs, pa.array(lengths), raw, pa.ListArray.from_arrays(offsets, tokens, type=schema.field(3).type)], schema=schema)

    def documents(docs: pa.Array, counts: np.ndarray, number: np.ndarray, replies: list) -> Iterator[pa.RecordBatch]:
        read = lambda k: [np.zeros(0, np.int64), *(_numbers(x[k]).astype(np.int64) for x in replies)]
        place, n, flat = np.concatenate([*map(np.cumsum, read(0))]), np.concatenate(read(1)), np.concatenate(read(2)).astype("<i4")
        start, size = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        start[place], size[place] = np.cumsum(n) - n, n
        last = np.cumsum(counts)
        parts, done, total = [], 0, 0
        for i, (a, b) in enumerate(zip(last - counts, last, strict=True)):
            own = number[a:b]
            m = size[own]
            parts.append(flat[np.repeat(start[own] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))])
            total += len(parts[-1])
            if total > OUT_TOKENS or i == len(counts) - 1:
                yield batch(docs.slice(done, len(parts)), parts)
                parts, done, total = [], i + 1, 0

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        known = [*zip(*(replies[c].to_pylist() for c in ("places", "sizes", "tokens")), strict=True)]
        out = []
        for k in range(blocks.num_rows):
            counts = blocks["counts"][k].values.to_numpy(zero_copy_only=False)
            out += documents(blocks["docs"][k].values, counts, _numbers(blocks["numbers"][k].as_py()), known)
        return pa.Table.from_batches(out, schema=schema)

    return run


def decoded(tokens: Column, path: str) -> Column:
    """The bytes that an array of token ids stands for: their pieces joined."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    pieces = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(tokens, lambda i: F.get(pieces, i)), ""))


def _tasks(docs: DataFrame) -> int:
    """Tasks of the shuffles: by the size of the input as the plan knows it, and by its splits."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    splits, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    return max(1, min(max(2 * cores, size // TASK_BYTES), 16 * splits))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the
    same as an array, ``tokens``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    short_batches(spark)
    # The literals would be in every description of the plan that the driver keeps.
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("bkmgBKMG")) > PLAN_CHARS:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    ranks = RankMap(load_ranks(path))
    kind = docs.schema[id_col].dataType
    # (?U): white space, letters and numbers by Unicode.
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("(?U)" + pattern), F.lit(0)).alias("words"),
    )
    shape = StructType([
        StructField("block", LongType()), StructField("docs", ArrayType(kind)), StructField("counts", ArrayType(IntegerType())),
        *(StructField(c, BinaryType()) for c in ("numbers", "word_sizes", "word_data")),
    ])
    # Both the words and the documents are read from this one shuffle.
    tasks = _tasks(docs)
    blocks = words.mapInArrow(_blocks(block_words, to_arrow_schema(shape)), shape).repartition(tasks, "block")

    word = StructType([StructField("t", ArrayType(LongType())), StructField("r", ArrayType(LongType()))])
    packed = StructType([StructField("words", ArrayType(word)), *(StructField(c, BinaryType()) for c in ("which", "blocks", "places"))])
    asked = blocks.mapInArrow(_asked(tasks), "bucket long, block long, places binary, sizes binary, data binary")
    folded = asked.repartitionById(tasks, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_pack(ranks, to_arrow_schema(packed)), packed).select(
        # The literal stands outside of the fold: a description of the plan repeats it at each level it is nested in.
        _let(ranks.literal(), lambda m: F.transform("words", lambda w: merged(w, ranks, m))).cast("array<array<int>>").alias("tokens"), "which", "blocks", "places"
    )
    # A shuffle of its own, so that a task never has two Python workers at once.
    replies = folded.repartition(tasks, "places").mapInArrow(_replies, "block long, places binary, sizes binary, tokens binary")
    out = StructType([StructField("doc_id", kind), StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("tokens", ArrayType(IntegerType()))])
    return blocks.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(_documents(to_arrow_schema(out)), out)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded(F.col("tokens"), path), 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
