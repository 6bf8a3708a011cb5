"""Packing documents into sequences, bounded-space and online (operator 9).

Each partition keeps a fixed number of open windows. A document's tail goes into the open
window that it fills best; when none has room, the fullest window is topped up with the
tail's first ids, emitted, and replaced. Windows still open at the end are merged across
partitions, a bounded number from each, so that padding does not grow with partitions.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlure.llm.parts import library_encoder, slices
from flowlure.llm.simple8b import with_end_ids
from flowlure.llm.tables import keep

LENGTH = 1024
#: Open windows per partition.
OPEN_WINDOWS = 64
#: Partitions whose open windows are merged by one task: at most MERGED * OPEN_WINDOWS * LENGTH ids.
MERGED = 32
#: Parts of texts that a worker remembers, beside its open windows.
REMEMBERED_PARTS = 500_000
#: A window's gap smaller than this is padded rather than filled by cutting a piece.
LEAST_CUT = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class OpenWindows:
    """A fixed number of open windows; ``add`` returns the windows that it closes."""

    def __init__(self, length: int = LENGTH, limit: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT):
        self.length, self.limit, self.least_cut = length, limit, least_cut
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.windows: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> list[list[Piece]]:
        doc, start, ids, total = piece
        closed = []
        while len(ids) >= self.length:
            closed.append([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length:]
        if not len(ids):
            return closed
        ids = ids.copy()  # a tail must not hold its whole slice of the corpus in memory
        at = bisect.bisect_left(self.rooms, (len(ids), -1))
        if at == len(self.rooms) and len(self.rooms) >= self.limit:
            room, window = self.rooms.pop(0)  # the fullest
            if room >= self.least_cut:
                self.windows[window].append((doc, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            closed.append(self.windows.pop(window))
            at = bisect.bisect_left(self.rooms, (len(ids), -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            room, window = self.length, self.made
            self.windows[window] = []
            self.made += 1
        self.windows[window].append((doc, start, ids, total))
        if room == len(ids):
            closed.append(self.windows.pop(window))
        else:
            bisect.insort(self.rooms, (room - len(ids), window))
        return closed

    def rest(self) -> list[list[Piece]]:
        return [self.windows[w] for _, w in self.rooms]


def _rows(windows: list[list[Piece]], first: int, with_ids: bool) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            for name, x in zip(out, (doc, start, len(ids), zlib.crc32(raw), total, first + k, offset, raw if with_ids else None)):
                out[name].append(x)
            offset += len(ids)
    return out


KEPT = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("bunch", pa.int32())])


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, spaced: bool = True) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and gapless offset.

    Rows need doc_id and text; other columns are not read. Rows without doc_id take no part.
    NULL text counts as empty (its end id alone is packed). Rows with equal doc_id are packed each by itself; an empty
    table gives no rows. Each partition reads its rows once, in any order; only its open
    windows travel, to be merged with those of up to MERGED - 1 other partitions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, open_, made = TaskContext.get().partitionId(), library_encoder(vocabulary, spaced, REMEMBERED_PARTS), OpenWindows(length, open_windows), 0

        def batch_of(windows: list[list[Piece]], with_ids: bool) -> pa.RecordBatch:
            nonlocal made
            rows = _rows(windows, (shard << 32) + made, with_ids)
            made += len(windows)
            return pa.RecordBatch.from_pydict(rows | {"bunch": [shard // MERGED] * len(rows["doc_id"])}, schema=KEPT)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                ids, sizes = with_end_ids(*encoder(texts), end_id)
                ends, closed = np.cumsum(sizes).tolist(), []
                for k, (end, size) in enumerate(zip(ends, sizes.tolist())):
                    closed += open_.add((doc_ids[at + k], 0, ids[end - size: end], size))
                yield batch_of(closed, False)
        yield batch_of(open_.rest(), True)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Whole windows of one partition after another: small tails fill the gaps of full ones.
        open_, closed = OpenWindows(length, open_windows), []
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        for row in group.itertuples(index=False):
            closed += open_.add((row.doc_id, row.start, np.frombuffer(row.ids, "<u4"), row.doc_tokens))
        # At most OPEN_WINDOWS remain; cut freely, they leave one unfilled window.
        last = OpenWindows(length, 1, least_cut=1)
        for window in open_.rest():
            for piece in window:
                closed += last.add(piece)
        closed += last.rest()
        rows = _rows(closed, (1 << 62) + (int(key[0]) << 32), False)
        rows.pop("ids")
        return pd.DataFrame(rows).astype("int64")

    schema = SCHEMA + ", ids binary, bunch int"
    packed = keep(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "packed")
    final = packed.where(F.col("ids").isNull()).drop("ids", "bunch")
    # A bunch holds at most MERGED * OPEN_WINDOWS windows, whatever the input's size.
    merged = packed.where(F.col("ids").isNotNull()).groupBy("bunch").applyInPandas(merge, SCHEMA)
    return final.unionByName(merged)
