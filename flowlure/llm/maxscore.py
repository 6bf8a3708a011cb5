"""Ranked lexical search by Block-Max MaxScore (operator 12).

``build_index`` cuts the documents into shards and gives each shard an inverted index of all
its terms: postings in blocks of BLOCK documents, each with the greatest term count and the
least length in it, so a block's bound follows whatever the corpus statistics are. Documents
of a shard are numbered by rising length, which keeps the bounds of a block tight.

``search`` takes the queries in blocks of bounded size. In a shard, a query's lists are
ordered by their global bounds; lists that together cannot reach the k-th best score so far
are non-essential. Essential lists bring candidates, a window of documents at a time; block
maxima of the non-essential lists reject candidates before any of their blocks is
decompressed. Shards give their k best per query, and those heaps are merged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.parts import slices
from flowlure.llm.tables import drop_kept, keep
from flowlure.llm.words import text_bytes

#: Bytes of text per shard; bounds a task's memory.
SHARD_BYTES = 12_000_000
#: Postings per block.
BLOCK = 128
#: Documents that candidates are drawn from at once.
WINDOW = 2048
#: Characters of query terms that are worked on at once, on average over the blocks of queries: bounds what the driver and each task hold.
QUERY_CHARS = 2_000_000
#: Characters of terms: digits, letters, all beyond ASCII; A-Z are lower-cased.
TERM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
INDEX = "shard long, term string, block int, first int, last int, most int, least int, count int, payload binary, words long"
HIT = "query long, doc_id long, score long"

_FOLD = np.full(256, 0x20, np.uint8)
for _low, _high, _shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x41, 0x5A, 32), (0x80, 0xFF, 0)):
    _FOLD[_low: _high + 1] = np.arange(_low, _high + 1) + _shift


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the low ones first, the last byte of each value under 128: (bytes, bytes per value)."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - size
    for k in range(5):
        has = size > k
        if not has.any():
            break
        out[begin[has] + k] = (values[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unvarint(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    ends = np.flatnonzero(last)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, ends - begin + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, begin)


def _bounds(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


def index_shard(shard: int, ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """The rows of one shard: its documents (term NULL), then the blocks of its terms by rising term."""
    raw, ends = text_bytes(texts)
    low = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_FOLD[raw].tobytes()))
    lists = pc.split_pattern(low, " ")
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    held = real.to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(held)])[starts - starts[0]]
    n = np.diff(begins)
    coded = flat.filter(real).dictionary_encode()
    del flat, lists, low, raw
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return None
    local = np.full(len(n), -1, np.int64)
    local[order] = np.arange(len(order))
    by_name = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    d = len(order)
    keys = rank[coded.indices.to_numpy()] * d + np.repeat(local, n)
    keys, tf = np.unique(keys, return_counts=True)
    term, doc = np.divmod(keys, d)
    sizes = np.bincount(term, minlength=len(by_name))  # postings per term, none is empty
    blocks = -(-sizes // BLOCK)
    number = np.arange(int(blocks.sum())) - np.repeat(_bounds(blocks)[:-1], blocks)
    begin = np.repeat(_bounds(sizes)[:-1], blocks) + number * BLOCK
    count = np.diff(np.append(begin, len(keys)))
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    length = n[order]
    packed, width = varint(np.column_stack([gap, tf]).reshape(-1))
    at = _bounds(width)[_bounds(count) * 2]
    doc_ids = ids[order]
    head = np.concatenate([doc_ids, length]).astype(np.int64).tobytes()
    payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) + 1, [None, pa.py_buffer(np.concatenate([[0], len(head) + at]).astype(np.int64)), pa.py_buffer(head + packed.tobytes())])
    names = coded.dictionary.take(by_name).take(pa.array(np.repeat(np.arange(len(by_name)), blocks)))
    ints = lambda first, rest: pa.array(np.concatenate([[first], rest]).astype(np.int32))
    columns = [
        pa.array(np.full(len(begin) + 1, shard, np.int64)),
        pa.concat_arrays([pa.array([None], pa.string()), names.cast(pa.string())]),
        ints(0, number), ints(0, doc[begin]), ints(d - 1, doc[begin + count - 1]),
        ints(0, np.maximum.reduceat(tf, begin)), ints(0, np.minimum.reduceat(length[doc], begin)), ints(d, count),
        payload.cast(pa.binary()),
        pa.concat_arrays([pa.array([int(length.sum())], pa.int64()), pa.nulls(len(begin), pa.int64())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of about SHARD_BYTES of text, however the rows came in batches."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        if held:
            ids, texts = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            held.clear()
            rows = index_shard((part << 32) + number, ids.to_numpy(), texts)
            number, size = number + 1, 0
            if rows is not None:
                for at in range(0, rows.num_rows, 50_000):
                    yield rows.slice(at, 50_000)

    for batch in batches:
        for at, texts in slices(batch.column(1), SHARD_BYTES):
            mine = pc.sum(pc.binary_length(texts)).as_py() or 0
            if size + mine > SHARD_BYTES:
                yield from emit()
            held.append((batch.column(0).slice(at, len(texts)), texts))
            size += mine
    yield from emit()


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of ``docs``: see INDEX; a shard's row without a term holds its documents.

    Rows without doc_id, which no result could name, and rows without a term take no part,
    in the statistics either. Each other row is a document of its own, rows alike too. Only
    doc_id and text are read.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(named.mapInArrow(_index, INDEX), "block-index")


class Shard:
    """The lists of one shard that a block of queries asks for."""

    def __init__(self, rows: pd.DataFrame, n_docs: int, n_words: int):
        head = rows[rows["term"].isna()].iloc[0]
        both = np.frombuffer(head["payload"], np.int64)
        self.ids, length = both[: len(both) // 2], both[len(both) // 2:]
        self.m = self._m(length, n_docs, n_words)
        self.lists = {}
        for term, found in rows[rows["term"].notna()].sort_values(["term", "block"]).groupby("term", sort=False):
            least = self._m(found["least"].to_numpy(np.int64), n_docs, n_words)
            self.lists[term] = (found["first"].to_numpy(np.int64), found["last"].to_numpy(np.int64), self._part(found["most"].to_numpy(np.int64), least), found["count"].to_numpy(np.int64), found["payload"].to_numpy())
        self.open: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0  # blocks decompressed so far

    @staticmethod
    def _m(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
        return 100 - 25 + (25 * n * n_docs) // n_words

    @staticmethod
    def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def postings(self, term: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what each adds to a score of weight 1) of some blocks of a list; a block is decompressed once."""
        first, _, _, count, payload = self.lists[term]
        new = [b for b in blocks.tolist() if (term, b) not in self.open]
        if new:
            values = unvarint(np.frombuffer(b"".join(payload[new]), np.uint8))
            gap, tf = values[::2], values[1::2]
            begin = _bounds(count[new])
            so_far = np.cumsum(gap)
            doc = so_far - np.repeat(so_far[begin[:-1]] - first[new], count[new])
            part = self._part(tf, self.m[doc])
            for b, i, j in zip(new, begin, begin[1:]):
                self.open[term, b] = doc[i:j], part[i:j]
        self.opened += len(new)
        found = [self.open[term, b] for b in blocks.tolist()]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def search(self, query: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of the k best for weighted terms; ties to the smaller doc_id."""
        lists = sorted(((int(self.lists[t][2].max()) * w, t, w) for t, w in query if w > 0 and t in self.lists))
        reach = np.cumsum([b for b, _, _ in lists])  # what the lists up to each can add at most
        best_ids, best, floor, essential = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
        for low in range(0, len(self.m), WINDOW):
            while essential < len(lists) and reach[essential] < floor:
                essential += 1
            if essential == len(lists):
                break
            score = np.zeros(min(WINDOW, len(self.m) - low), np.int64)
            high = low + len(score)
            for _, term, weight in lists[essential:]:
                first, last = self.lists[term][:2]
                blocks = np.arange(np.searchsorted(last, low), np.searchsorted(first, high))
                if len(blocks):
                    doc, part = self.postings(term, blocks)
                    i, j = np.searchsorted(doc, [low, high])
                    score[doc[i:j] - low] += part[i:j] * weight
            found = np.flatnonzero(score)
            score, found = score[found], found + low
            score, found = self._others(lists[:essential], score, found, floor)
            if len(found):
                best_ids, best = np.concatenate([best_ids, self.ids[found]]), np.concatenate([best, score])
                order = np.lexsort([best_ids, -best])[:k]
                best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    floor = max(1, int(best[-1]))  # a document of equal score may have the smaller doc_id
        return best_ids, best

    def _others(self, lists: list, score: np.ndarray, found: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores with the non-essential lists, of the documents that can still reach ``floor``."""
        can = []
        for _, term, weight in lists:
            first, last, bound = self.lists[term][:3]
            block = np.minimum(np.searchsorted(last, found), len(last) - 1)
            inside = (first[block] <= found) & (found <= last[block])
            can.append((np.where(inside, bound[block], 0) * weight, np.where(inside, block, -1)))
        total = score + sum((c for c, _ in can), np.zeros(len(score), np.int64))
        alive = np.arange(len(found))
        for (_, term, weight), (adds, block) in zip(reversed(lists), reversed(can)):
            alive = alive[total[alive] >= floor]
            if not len(alive):
                break
            at = alive[block[alive] >= 0]
            if not len(at):
                continue
            doc, part = self.postings(term, np.unique(block[at]))
            place = np.minimum(np.searchsorted(doc, found[at]), len(doc) - 1)
            real = np.where(doc[place] == found[at], part[place], 0) * weight
            score[at] += real
            total[at] += real - adds[at]
        alive = alive[score[alive] >= floor]
        return score[alive], found[alive]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def terms_of(queries: DataFrame) -> DataFrame:
    """(query, term, times) of (query, text)."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = queries.select("query", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("query", "term").agg(F.count("*").alias("times"))


def _search_block(index: DataFrame, terms: DataFrame, k: int, n_docs: int, n_words: int) -> DataFrame:
    """Hits of one block of queries; their terms pass the driver, bounded by QUERY_CHARS."""
    names = F.broadcast(terms.select("term").distinct())
    df = index.where(F.col("term").isNotNull()).join(names, "term", "left_semi").groupBy("term").agg(F.sum("count").alias("df"))
    queries: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for r in terms.join(F.broadcast(df), "term").collect():
        queries[r["query"]].append((r["term"], r["times"] * weight(n_docs, r["df"])))
    wanted = sorted({t for q in queries.values() for t, _ in q})

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows, n_docs, n_words)
        out = []
        for query, lists in queries.items():
            ids, scores = shard.search(lists, k)
            out.append(pd.DataFrame({"query": np.full(len(ids), query, np.int64), "doc_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "doc_id": [], "score": []}, dtype="int64")

    if not wanted:
        return index.sparkSession.createDataFrame([], HIT)
    needed = index.join(names, "term", "left_semi").unionByName(index.where(F.col("term").isNull()))
    return needed.groupBy("shard").applyInPandas(search, HIT)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of each of ``queries`` (query long, text).

    Score: the sum over a query's terms, repeats included, of w * (10^9 tf div (1000 tf + 12 m));
    only scores above 0 count, equal ones go by doc_id. NULL text has no term. Queries are
    taken in blocks, so neither the driver nor a task ever holds more than one block's terms.
    """
    spark = index.sparkSession
    corpus = index.where(F.col("term").isNull()).agg(F.sum("count").cast("long").alias("docs"), F.sum("words").alias("words")).first()
    if not corpus["docs"]:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    terms = keep(terms_of(queries), "query-terms")
    chars = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = -(-chars // QUERY_CHARS)
    part = F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1)))
    hits = [keep(_search_block(index, terms.where(part == b), k, corpus["docs"], corpus["words"]), "hits") for b in range(blocks)]
    if not hits:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    drop_kept(terms)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_items(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Rows of ``items`` alike in item_id and text are one item; rows alike in item_id only
    are items of their own, and both give rows under that item_id. A NULL item_id is kept.
    Empty tables, and items without a known term, give no rows. See ``build_index`` for rows
    of ``docs`` that take no part; other columns may have any name.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    numbered = keep(rows.withColumn("query", F.xxhash64(F.col("item_id").isNull(), "item_id", "text")), "items")
    index = build_index(docs)
    found = keep(search(index, numbered.select("query", "text"), k), "ranked")
    drop_kept(index)
    return found.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
