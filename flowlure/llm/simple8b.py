"""Token-id output in Simple-8b words (operator 5).

A 64-bit word holds a 4-bit selector and up to 60 values of equal width. Ids are cut into
blocks of ``BLOCK``; the block table gives each block's first word, so a reader may decode
any block alone or all of them at once with numpy. Values of 60 bits and more are escapes:
their word holds a place in a table of raw 64-bit values at the end.

Payload layout (little-endian): magic ``S8B1``, uint32 ids per block, uint64 ids, words and
escapes, uint64 first word per block, the words, the escapes. A payload is one row of a
Parquet file, which gives Spark's task commit: a lost executor leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlure.llm.parts import library_encoder, slices

#: Fixed values of the coding: values per word and their width, by selector 1 to 14 (0: escape).
SELECTORS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
BLOCK = 1024
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIQQQ")

FILE_SCHEMA = "shard int, part int, first long, n_ids long, doc_ids binary, doc_sizes binary, payload binary"


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """Simple-8b payload of non-negative integers (any order, repeats, none at all)."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    highest = int(v.max()) if n else 0
    narrow = v.astype(np.uint32) if highest < 1 << 32 else v
    left = np.resize(np.arange(min(block, max(n, 1)), 0, -1, dtype=np.int32), n)
    if n % block and n > block:
        left[n // block * block:] = np.arange(n % block, 0, -1)
    kind = np.where(v >> np.uint64(60) > 0, 0, 1).astype(np.uint8) if highest >> 60 else np.ones(n, np.uint8)
    ends = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    for s, (count, width) in enumerate(SELECTORS[1:], start=2):
        if count > n:
            break
        fits = left >= count
        if highest >> width:  # a word's values are narrow where no wide one is counted among them
            np.cumsum(narrow >= 1 << width, out=ends[1:])
            fits[: n - count + 1] &= ends[count:] == ends[: n - count + 1]
            if not fits.any():
                break
        kind[fits] = s
    take = np.array([1, *(c for c, _ in SELECTORS)])[kind]
    # Every block follows its own chain of words; all blocks take a step at once.
    at, steps = np.arange(0, n, block, dtype=np.int64), []
    stops = np.minimum(at + block, n)
    while len(at):
        steps.append(at)
        at = at + take[at]
        more = at < stops
        at, stops = at[more], stops[more]
    firsts = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
    kinds = kind[firsts].astype(np.uint64)
    words = kinds << np.uint64(60)
    escapes = v[firsts[kinds == 0]]
    words[kinds == 0] |= np.arange(len(escapes), dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS, start=1):
        rows = np.flatnonzero(kinds == s)
        for k in range(count if len(rows) else 0):
            words[rows] |= v[firsts[rows] + k] << np.uint64(width * k)
    table = np.searchsorted(firsts, np.arange(0, n, block)).astype("<u8")
    return HEAD.pack(MAGIC, block, n, len(words), len(escapes)) + table.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode(payload: bytes, blocks: slice = slice(None)) -> np.ndarray:
    """Values of a payload, or of some of its blocks only."""
    magic, block, n, n_words, n_escapes = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n_blocks = -(-n // block)
    raw = np.frombuffer(payload, "<u8", offset=HEAD.size)
    table = np.concatenate([raw[:n_blocks], [n_words]]).astype(np.int64)
    words, escapes = raw[n_blocks: n_blocks + n_words], raw[n_blocks + n_words:]
    lo, hi, step = blocks.indices(n_blocks)
    if step != 1:
        raise ValueError("blocks are read in order")
    words = words[table[lo]: table[max(lo, hi)]] if n_blocks else words
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS), 0])[kinds]
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    low = np.uint64((1 << 60) - 1)
    rows = np.flatnonzero(kinds == 0)
    out[starts[rows]] = escapes[(words[rows] & low).astype(np.int64)]
    for s, (count, width) in enumerate(SELECTORS, start=1):
        rows = np.flatnonzero(kinds == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(rows) else 0):
            out[starts[rows] + k] = ((words[rows] & low) >> np.uint64(width * k)) & mask
    return out


def with_end_ids(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each document, and the sizes with it."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def write_ids(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, spaced: bool = False) -> None:
    """Encode every text and write Simple-8b files under ``path`` in ascending doc_id order.

    Rows need doc_id and text; other columns are not read. Rows without doc_id have no place
    in the order and are not written. NULL text counts as empty (one end id). Rows with the same doc_id are all written, in order of their text; an empty
    table writes no rows. Documents are range-partitioned by doc_id, so shard order is id
    order and no task holds more than its own range.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, part, first = library_encoder(vocabulary, spaced), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in slices(batch.column(1)):
                ids, sizes = with_end_ids(*encoder(texts), end_id)
                row = [shard, part, first, len(ids), doc_ids[at: at + len(sizes)].astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), encode(ids)]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["shard", "part", "first", "n_ids", "doc_ids", "doc_sizes", "payload"])
                part, first = part + 1, first + len(ids)

    ordered = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written files: doc_id, start (ids before it in all files), n_tokens, ids binary (uint32)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # A payload says where it begins in its shard, so only shards, one per task that wrote, are added up.
    index = files.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = index.select("shard", (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"]).astype("<u4")
                sizes = np.frombuffer(row["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                for a in range(0, len(sizes), 4096):
                    some = range(a, min(a + 4096, len(sizes)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.frombuffer(row["doc_ids"], "<i8")[some.start: some.stop]),
                        pa.array(row["first"] + ends[some.start: some.stop] - sizes[some.start: some.stop]),
                        pa.array(sizes[some.start: some.stop]),
                        pa.array([ids[ends[i] - sizes[i]: ends[i]].tobytes() for i in some], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    columns = files.join(F.broadcast(before), "shard").select((F.col("before") + F.col("first")).alias("first"), "doc_ids", "doc_sizes", "payload")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
