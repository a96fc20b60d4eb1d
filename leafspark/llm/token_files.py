"""Token ids in binary files, coded by a static range asymmetric numeral system.

Documents are range-partitioned and sorted by id; each task is one shard, cut into segments of whole
documents. One pass counts the ids, and the counts, scaled to a power of two, are the frequency table
that all blocks share. A segment is coded in independent blocks. In a block, token i belongs to lane
i mod ``LANES``; the lanes' 64-bit states send 32-bit words to one interleaved stream. Every
``CHECK`` steps a checkpoint keeps the lanes' states and the place in the stream, so that decoding
can start there, and a CRC-32 covers the block's ids.

The files are Parquet: ``segments`` has a row for each segment (shard, place, ids before it in the
shard, its documents and their lengths, its blocks), ``frequencies`` a row for each id in use. A block is

    magic "RANB", version, lanes, step count, ids, words: u32 each; CRC-32 of the ids: u32;
    states at the start: lanes x u64; for each checkpoint: word offset u32, lanes x u64; words: u32 each

with all numbers little-endian.

Defined results: a null text counts as empty and has the end id alone; null document ids come first;
documents of one id stand side by side, in the order of their texts; an empty table makes empty files;
other columns are ignored. Text that spells a special token becomes that token, as the library has it
by default. A block whose
checksum doesn't match raises an error.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from leafspark.llm.common import broadcast_up_to, new_path, short_batches, staged, table

END = 2
LANES, STEPS, CHECK = 64, 1024, 256
BLOCK = LANES * STEPS
SEGMENT = 16 * BLOCK
SCALE = 20
LOW = np.uint64(1 << 31)
#: Distinct words a worker remembers the ids of.
MEMO = 600_000
#: Marks of ASCII but the apostrophe, which may begin a contraction.
MARKS = string.punctuation.replace("'", "")
#: Letters whose lower case and normal form are letters by any Unicode version.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u0481\u048a-\u0527]+$"
#: Bytes of text that are cut into words at once.
TEXT_BYTES = 2 << 20
_HEAD = struct.Struct("<4s6I")


class Coder:
    """The frequency table, with what coding and decoding look up in it."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        top = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(top, dtype=np.uint64)
        self.freq[ids] = freqs
        self.base = np.cumsum(self.freq) - self.freq
        self.common = int(ids[np.argmax(freqs)]) if len(ids) else 0

    def by_slot(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def frequencies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, none below one; the most frequent ids take up the rounding."""
    if len(ids) > 1 << SCALE:
        raise ValueError("more ids in use than the table has room for")
    if not len(ids):
        return counts
    freqs = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    order = np.lexsort((ids, -freqs))
    rest = (1 << SCALE) - int(freqs.sum())
    if rest > 0:
        freqs[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        cut = min(-rest, int(freqs[i]) - 1)
        freqs[i] -= cut
        rest += cut
    return freqs


def encode_blocks(ids: np.ndarray, coder: Coder) -> list[bytes]:
    """A segment's ids to blocks: the full ones side by side, then what is left."""
    full = len(ids) // BLOCK * BLOCK
    out = _encode(ids[:full].reshape(-1, STEPS, LANES), np.full(full // BLOCK, BLOCK), coder) if full else []
    if rest := len(ids) - full:
        steps = -(-rest // LANES)
        last = np.full(steps * LANES, coder.common, dtype=ids.dtype)
        last[:rest] = ids[full:]
        out += _encode(last.reshape(1, steps, LANES), np.array([rest]), coder)
    return out


def _encode(ids: np.ndarray, sizes: np.ndarray, coder: Coder) -> list[bytes]:
    n, steps, _ = ids.shape
    state = np.full((n, LANES), LOW, dtype=np.uint64)
    sent, words, marks = [], [], []
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        s = ids[:, t]
        f = coder.freq[s]
        over = state >= f << np.uint64(31 - SCALE + 32)
        sent.append(over)
        words.append((state & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        state = np.where(over, state >> shift, state)
        q = state // f
        state = (q << scale) + (state - q * f) + coder.base[s]
        if t and t % CHECK == 0:
            marks.append(state)
    # From here on in reading order: step by step, and the lanes of a step in turn.
    over, word = np.stack(sent[::-1], axis=1), np.stack(words[::-1], axis=1)
    marks = marks[::-1]
    out = []
    for k in range(n):
        stream = word[k][over[k]]
        before = np.concatenate([[0], np.cumsum(over[k].sum(axis=1))])
        flat = ids[k].reshape(-1)[: sizes[k]].astype("<u4")
        checks = b"".join(struct.pack("<I", before[(j + 1) * CHECK]) + m[k].astype("<u8").tobytes() for j, m in enumerate(marks))
        head = _HEAD.pack(b"RANB", 1, LANES, steps, int(sizes[k]), len(stream), zlib.crc32(flat.tobytes()))
        out.append(head + state[k].astype("<u8").tobytes() + checks + stream.astype("<u4").tobytes())
    return out


def parse_block(block: bytes):
    """(steps, ids, crc, starts, words): starts has (step, word offset, states) of the start and of each checkpoint."""
    magic, version, lanes, steps, n, n_words, crc = _HEAD.unpack_from(block)
    if (magic, version, lanes) != (b"RANB", 1, LANES):
        raise ValueError("not a block of this format")
    at = _HEAD.size
    starts = [(0, 0, np.frombuffer(block, "<u8", LANES, at))]
    at += 8 * LANES
    for step in range(CHECK, steps, CHECK):
        starts.append((step, struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", LANES, at + 4)))
        at += 4 + 8 * LANES
    return steps, n, crc, starts, np.frombuffer(block, "<u4", n_words, at)


def decode_blocks(blocks: list[bytes], coder: Coder, slots: np.ndarray) -> np.ndarray:
    """Blocks to their ids. All checkpoints of blocks of one length are decoded side by side."""
    parsed = [parse_block(b) for b in blocks]
    out: list = [None] * len(blocks)
    for steps in {p[0] for p in parsed}:
        own = [k for k, p in enumerate(parsed) if p[0] == steps]
        words = np.concatenate([*(parsed[k][4] for k in own), np.zeros(1, dtype="<u4")]).astype(np.uint64)
        base = np.cumsum([0, *(len(parsed[k][4]) for k in own)])[:-1]
        starts = [(i, *s) for i, k in enumerate(own) for s in parsed[k][3]]
        ids = np.empty((len(own), steps, LANES), dtype=np.uint32)
        for length in {min(CHECK, steps - s[1]) for s in starts}:
            run = [s for s in starts if min(CHECK, steps - s[1]) == length]
            which, first = np.array([s[0] for s in run]), np.array([s[1] for s in run])
            place = base[which] + np.array([s[2] for s in run])
            state = np.stack([s[3] for s in run]).astype(np.uint64)
            for t in range(length):
                slot = state & np.uint64((1 << SCALE) - 1)
                s = slots[slot.astype(np.int64)]
                ids[which, first + t] = s
                state = coder.freq[s] * (state >> np.uint64(SCALE)) + slot - coder.base[s]
                low = state < LOW
                take = np.cumsum(low, axis=1)
                # A damaged block may ask for more words than there are; its checksum tells.
                word = words[np.minimum(np.where(low, place[:, None] + take - 1, 0), len(words) - 1)]
                state = np.where(low, state << np.uint64(32) | word, state)
                place = place + take[:, -1]
        for i, k in enumerate(own):
            flat = ids[i].reshape(-1)[: parsed[k][1]]
            if zlib.crc32(flat.astype("<u4").tobytes()) != parsed[k][2]:
                raise ValueError("a block's checksum does not match its ids")
            out[k] = flat
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as the tokenizer takes them, and the closing marks that it parts from the letters before them. It makes
    lower case, but in special tokens. Only letters that every Unicode version knows are parted from marks."""
    plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))
    words = pc.if_else(plain, pc.ascii_lower(words), words)
    heads = pc.ascii_rtrim(words, characters=MARKS)
    size = pc.binary_length(heads).to_numpy(zero_copy_only=False)
    marks = pc.binary_length(words).to_numpy(zero_copy_only=False) - size
    marks[~pc.match_substring_regex(heads, LETTERS).to_numpy(zero_copy_only=False)] = 0
    # The array is fresh, so its buffers begin with its first word.
    raw, at = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(words.buffers()[1], dtype=np.int32)[1 : len(words) + 1] - marks
    upto = np.cumsum(marks)
    tails = raw[np.repeat(at - (upto - marks), marks) + np.arange(int(marks.sum()))]
    tails = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.append(0, upto).astype(np.int32)), pa.py_buffer(tails)])
    return pc.if_else(pa.array(marks > 0), heads, words), tails


class _Words:
    """Ids of the words a worker has met. White space never reaches a token of this vocabulary, so a
    text's ids are those of its words, between ASCII white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a run of letters, digits or marks.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype="<u4")
        self.words = self.used = 0

    def _put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers words whose ids stand one word after the other."""
        n, end = self.words + len(words), self.used + len(ids)
        if n > len(self.size):
            self.start, self.size = np.resize(self.start, 2 * n), np.resize(self.size, 2 * n)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        self.flat[self.used : end] = ids
        self.size[self.words : n] = sizes
        self.start[self.words : n] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(words, range(self.words, n), strict=True))
        self.words, self.used = n, end

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one word after the other, and how many each has."""
        n = self.size[number]
        return self.flat[np.repeat(self.start[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are encoded many to a text and told apart by the tokens that end them."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        single = [k for k, t in enumerate(texts) if not t.isalpha()]
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(group):
                single += group
            else:
                self._put([words[k] for k in group], ids, np.diff(cut, prepend=0))
        lists = [coded.ids for coded in self.tokenizer.encode_batch_fast([texts[k] for k in single], add_special_tokens=False)]
        self._put([words[k] for k in single], np.fromiter(chain.from_iterable(lists), dtype="<u4"), np.fromiter(map(len, lists), dtype=np.int64))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > MEMO:
            self.clear()
        number = self.number
        new = [w for w in words if w not in number]
        if new:
            self._encode(new)
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))


_WORDS: dict[str, _Words] = {}


def encode_texts(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, and how many each has."""
    if path not in _WORDS:
        _WORDS[path] = _Words(path)
    known = _WORDS[path]
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    heads, tails = _parted(coded.dictionary)
    parts = pa.concat_arrays([heads, tails]).dictionary_encode()
    number = known.numbers(parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
    # A word's ids are those of its two parts.
    flat, n = known.ids(number[parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()])
    size = n.reshape(-1, 2).sum(axis=1)
    start, word = np.cumsum(size) - size, coded.indices.to_numpy(zero_copy_only=False)
    n = size[word]
    ids = flat[np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    upto = np.concatenate([[0], np.cumsum(n)])
    per_doc = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    length = np.diff(upto[per_doc])
    return np.insert(ids, np.cumsum(length), end_id).astype("<u4"), length + 1


def _segments(path: str, end_id: int, schema: pa.Schema):
    """Sorted (doc_id, text) batches to segments of whole documents with their raw ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, ids, total = [], [], [], 0

        def segment() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=t)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([place], pa.int32()), pa.array([before], pa.int64()), one(pa.concat_arrays(docs), schema.field(3).type),
                 one(pa.array(n, pa.int64()), schema.field(4).type), pa.array([np.concatenate(ids).tobytes()], pa.binary())], schema=schema
            )

        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES, prepend=0, append=-1))
            for at, end in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                if at == end:
                    continue
                batch = whole.slice(int(at), int(end - at))
                tokens, length = encode_texts(path, batch.column(1), end_id)
                docs.append(batch.column(0))
                lengths.append(length)
                ids.append(tokens)
                total += len(tokens)
                if total >= SEGMENT:
                    yield segment()
                    place, before = place + 1, before + total
                    docs, lengths, ids, total = [], [], [], 0
        if docs:
            yield segment()

    return run


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files of all rows of ``docs``, in ascending order of id, under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType
    head = [StructField("shard", IntegerType()), StructField("place", IntegerType()), StructField("first", LongType()),
            StructField("docs", ArrayType(kind)), StructField("lengths", ArrayType(LongType()))]
    raw = StructType([*head, StructField("ids", BinaryType())])
    coded = StructType([*head, StructField("blocks", ArrayType(BinaryType()))])
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id")
    segments = staged(
        ordered.sortWithinPartitions("doc_id", "text").mapInArrow(_segments(tokenizer, end_id, to_arrow_schema(raw)), raw), "segments"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                found = np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # One row for each id in use: at most the vocabulary.
    counts = segments.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, freqs = counts["id"].to_numpy(), frequencies(counts["id"].to_numpy(), counts["n"].to_numpy())
    spark.createDataFrame([*zip(ids.tolist(), freqs.tolist(), strict=True)], "id long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    coder = Coder(ids, freqs)
    out_schema = to_arrow_schema(coded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                blocks = encode_blocks(np.frombuffer(batch.column(5)[k].as_buffer(), "<u4").astype(np.int64), coder)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(5)), pa.array([blocks], pa.list_(pa.binary()))], schema=out_schema)

    segments.mapInArrow(encode, coded).write.option("compression", "none").parquet(f"{path}/segments")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), ids (little-endian
    unsigned 32-bit, with the end id)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(spark)
    table_ = spark.read.schema("id long, freq long").parquet(f"{path}/frequencies").orderBy("id").toPandas()
    coder = Coder(table_["id"].to_numpy(), table_["freq"].to_numpy())
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["docs"].dataType.elementType
    out = StructType([StructField("shard", IntegerType()), StructField("doc_id", kind), StructField("offset", LongType()), StructField("ids", BinaryType())])
    schema = to_arrow_schema(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = coder.by_slot()
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, docs, lengths, blocks = (batch.column(c)[k] for c in range(5))
                flat = decode_blocks(blocks.as_py(), coder, slots).astype("<u4")
                n = lengths.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(n)
                for at in range(0, len(n), 512):
                    part = range(at, min(at + 512, len(n)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.as_py()] * len(part), pa.int32()), docs.values.slice(at, len(part)),
                         pa.array([first.as_py() + int(ends[i] - n[i]) for i in part], pa.int64()),
                         pa.array([flat[ends[i] - n[i] : ends[i]].tobytes() for i in part], pa.binary())], schema=schema
                    )

    # One row for each shard, that is for each task that wrote.
    sums = segments.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = segments.select("shard", "first", "docs", "lengths", "blocks").mapInArrow(decode, out)
    return rows.join(broadcast_up_to(bases, 100_000), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "ids")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_files(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {"op10_token_files": op10_token_files}
SQL: dict[str, str] = {}
