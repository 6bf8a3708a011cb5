"""Removing long repeated byte strings with a run-length index (operator 4).

Every window of ``length`` bytes picks one anchor: its least-hashed gram of ANCHOR bytes,
the leftmost of equals. Equal windows pick equal anchors at equal places, so a window can
only repeat if its anchor does, and all its copies meet under that anchor. Anchors that
occur once, nearly all, go after a count over packed blocks. For the rest, the stretch of
text whose windows picked the anchor is sent to the anchor's task. There a run-length index
(run-compressed Burrows-Wheeler transform, sampled run ends) of the distinct stretches
streams matching statistics, and windows matched in full length mark their bytes.

An anchor that occurs very often, as at the edge of a passage that a third of all texts
share, is split: its windows go by narrow classes of their place and by the hash of the
bytes that all of a class hold, so that different contexts part and copies fold into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlure.llm.parts import slices
from flowlure.llm.runindex import RunIndex
from flowlure.llm.tables import drop_kept, keep
from flowlure.llm.words import text_bytes

LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 48
#: Anchors in one bucket of the count (about), and the least number of buckets.
BUCKET_ANCHORS = 600_000
LEAST_BUCKETS = 24
#: Occurrences from which an anchor's windows are split, and the width of a class then.
OFTEN = 20_000
NARROW = 8
#: Bytes of distinct stretches in one index.
INDEX_BYTES = 1_000_000
#: Bytes of text whose grams are hashed at a time.
SLICE_BYTES = 1_500_000
LOW_BITS = 40
PLACE_BITS = 24

ANCHORS = "bucket int, uid long, directory boolean, low binary, many binary, ids binary, hashes binary, sizes binary, slots binary"
NAMES = [c.split()[0] for c in ANCHORS.split(", ")]
COUNTED = ["bucket", "uid", "directory", "data", "many", "ids", "hashes", "sizes", "slots"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place; doubles the gram, then joins powers of two."""
    level, have, out, covered = _mix(raw.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, None, 0
    while True:
        if size & have:
            if out is None:
                out = level
            else:
                n = len(level) - covered
                out = _mix(out[:n] * np.uint64(0x94D049BB133111EB) + level[covered: covered + n]) if n > 0 else out[:0]
            covered += have
        if covered == size or have * 2 > size:
            return out
        n = len(level) - have
        level = _mix(level[:n] * np.uint64(0xD6E8FEB86659FD93) + level[have: have + n]) if n > 0 else level[:0]
        have *= 2


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours, by running minima within blocks."""
    n = len(keys)
    if n < width:
        return keys[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def anchors_of(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, end of windows, document) of each anchor, in text order.

    Places and windows count from the slice's start; windows never cross documents.
    """
    gram = min(ANCHOR, length)
    h = gram_hashes(raw, gram)
    if len(raw) < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    keys = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    least = window_minima(keys, length - gram + 1)
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), inside)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(inside) - inside, inside) + np.repeat(offsets[:-1], inside)
    picked = place[start]
    if not len(picked):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    fresh = np.ones(len(picked), bool)
    fresh[1:] = (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])
    firsts = np.flatnonzero(fresh)
    lasts = np.concatenate([firsts[1:], [len(picked)]]) - 1
    return h[picked[firsts]], picked[firsts], start[firsts], start[lasts] + 1, doc[firsts]


def repeated_anchors(docs: DataFrame, length: int, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_hash, flags): per anchor of a document 0, 1 (repeated) or 2 (often); documents without any go.

    A task sends each distinct anchor of a slice of texts once, with its count, in packed
    blocks per bucket of the hash range.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_anchor = max((length - min(ANCHOR, length) + 2) // 2, 1)
    buckets = max(LEAST_BUCKETS, -(-total // (per_anchor * BUCKET_ANCHORS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                raw, offsets = text_bytes(texts)
                hashes, _, _, _, doc = _in_pieces(raw, offsets, length)
                low = (1 << LOW_BITS) - 1
                key = ((hashes >> np.uint64(LOW_BITS)) * np.uint64(buckets) >> np.uint64(64 - LOW_BITS) << np.uint64(LOW_BITS)) | (hashes & np.uint64(low))
                key, slots, many = np.unique(key, return_inverse=True, return_counts=True)
                cuts = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
                ids, text_hashes = (batch.column(k).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for k in (0, 1))
                sizes = np.bincount(doc, minlength=len(texts)).astype("<u4").tobytes()
                rows = [(int(uid % buckets), uid, True, b"", cuts.astype("<i8").tobytes(), ids, text_hashes, sizes, slots.astype("<u4").tobytes())]
                for b in range(buckets):
                    if cuts[b + 1] > cuts[b]:
                        some = slice(cuts[b], cuts[b + 1])
                        rows.append((b, uid, False, _planes(key[some] & np.uint64(low)), np.minimum(many[some], 65535).astype("<u2").tobytes(), b"", b"", b"", b""))
                types = (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)
                uid += 1

    def count(group: pd.DataFrame) -> pd.DataFrame:
        known, sent = group[group["directory"]], group[~group["directory"]]
        columns = {"bucket": known["bucket"], "uid": known["uid"], "directory": True, "data": b"", "many": known["many"], "ids": known["ids"], "hashes": known["hashes"], "sizes": known["sizes"], "slots": known["slots"]}
        out = [pd.DataFrame(columns)]
        if len(sent):
            many = [np.frombuffer(m, "<u2") for m in sent["many"]]
            low = np.concatenate([_unplanes(raw, len(m)) for raw, m in zip(sent["low"], many)])
            values, place = np.unique(low, return_inverse=True)
            total = np.bincount(place, np.concatenate(many).astype(np.int64), len(values))
            flag = ((total > 1).astype(np.uint8) + (total >= often))[place]
            cuts = np.cumsum([0, *map(len, many)])
            data = [flag[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            out.append(pd.DataFrame({"bucket": sent["bucket"], "uid": sent["uid"], "directory": False, "data": data}).assign(many=b"", ids=b"", hashes=b"", sizes=b"", slots=b""))
        return pd.concat(out)[COUNTED]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        home = group[group["directory"]].iloc[0]
        cuts, slots = np.frombuffer(home["many"], "<i8"), np.frombuffer(home["slots"], "<u4")
        flags = np.zeros(int(cuts[-1]), np.uint8)
        for r in group[~group["directory"]].itertuples():
            flags[cuts[r.bucket]: cuts[r.bucket + 1]] = np.frombuffer(r.data, np.uint8)
        mine = flags[slots]
        ends = np.cumsum(np.frombuffer(home["sizes"], "<u4").astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        some = np.concatenate([[0], np.cumsum(mine > 0)])
        keep_ = np.flatnonzero(some[ends] > some[starts])
        ids, text_hashes = np.frombuffer(home["ids"], "<i8"), np.frombuffer(home["hashes"], "<i8")
        return pd.DataFrame({"doc_id": ids[keep_], "text_hash": text_hashes[keep_], "flags": [mine[starts[i]: ends[i]].tobytes() for i in keep_]})

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    sent = keyed.mapInArrow(send, ANCHORS)
    counted = sent.groupBy("bucket").applyInPandas(count, "bucket int, uid long, directory boolean, data binary, many binary, ids binary, hashes binary, sizes binary, slots binary")
    return counted.groupBy("uid").applyInPandas(finish, "doc_id long, text_hash long, flags binary").distinct()


def _in_pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``anchors_of``, a very long text cut so that a place fits its bits; equal results."""
    most = 1 << PLACE_BITS
    if len(raw) < most:
        return anchors_of(raw, offsets, length)
    out = []
    for i in range(len(offsets) - 1):
        for a in range(int(offsets[i]), max(int(offsets[i + 1]) - length + 1, int(offsets[i]) + 1), most - length):
            b = min(a + most - 1, int(offsets[i + 1]))
            h, place, s, e, _ = anchors_of(raw[a:b], np.array([0, b - a]), length)
            out.append((h, place + a, s + a, e + a, np.full(len(h), i)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _planes(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - LOW_BITS // 8:].T).tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - LOW_BITS // 8:] = np.frombuffer(raw, np.uint8, n * LOW_BITS // 8).reshape(-1, n).T
    return out.view(">u8").ravel().astype(np.uint64)


STRETCHES = "anchor long, text_key long, text binary, at binary"


def stretches(docs: DataFrame, flagged: DataFrame, length: int) -> DataFrame:
    """(anchor, text_key, text, at): distinct stretches per slice of texts with where they occur.

    ``at``: doc_id, text_hash and first window of each occurrence. All occurrences of a
    window get the same ``anchor``.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    joined = keyed.join(flagged, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "flags")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                raw, offsets = text_bytes(texts)
                data = raw.tobytes()
                hashes, place, start, stop, doc = _in_pieces(raw, offsets, length)
                flags = np.frombuffer(b"".join(batch.column(3).slice(at, len(texts)).to_pylist()), np.uint8)
                ids, text_hashes = (batch.column(k).slice(at, len(texts)).to_numpy(zero_copy_only=False) for k in (0, 1))
                found: dict[tuple[int, int], list] = {}
                some = np.flatnonzero(flags)
                for h, p, s, e, d, f in zip(hashes[some].tolist(), place[some].tolist(), start[some].tolist(), stop[some].tolist(), doc[some].tolist(), flags[some].tolist()):
                    for key, a, b in _classes(data, h, p, s, e, length) if f == 2 else ((h, s, e),):
                        text = data[a: b + length - 1]
                        known = found.setdefault((key, xxhash.xxh3_64_intdigest(text)), [text, []])
                        known[1] += (int(ids[d]), int(text_hashes[d]), a - int(offsets[d]))
                if found:
                    keys = np.array([k for k in found], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([v[0] for v in found.values()], pa.binary()),
                        pa.array([np.array(v[1], "<i8").tobytes() for v in found.values()], pa.binary()),
                    ], ["anchor", "text_key", "text", "at"])

    return joined.mapInArrow(cut, STRETCHES)


def _classes(data: bytes, h: int, p: int, s: int, e: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Windows s to e of an anchor at p in classes of NARROW places, each under the bytes that the class shares."""
    a = s
    while a < e:
        k = (p - a) // NARROW
        b = min(e, p - k * NARROW + 1)  # windows of this class end here
        full = p - (k + 1) * NARROW + 1  # where the class would begin if the text allowed it
        last = p - k * NARROW
        yield xxhash.xxh3_64_intdigest(data[last: full + length], seed=(h + k) & 0xFFFFFFFFFFFFFFFF), a, b
        a = b


def repeated_windows(cut: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, a, b): byte spans covered by windows that occur elsewhere.

    A task gets its anchors in order and indexes some whole anchors at a time.
    """
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        places: list[list[bytes]] = []
        size, last = 0, (None, None)
        for batch in batches:
            for anchor, key, text, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if anchor != last[0] and size >= INDEX_BYTES:
                    yield _marked(texts, places, length)
                    texts, places, size = [], [], 0
                if (anchor, key) == last and places:
                    places[-1].append(at)
                else:
                    texts.append(text)
                    places.append([at])
                    size += len(text)
                last = (anchor, key)
        if texts:
            yield _marked(texts, places, length)

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor", "text_key")
    return dealt.mapInArrow(index, "doc_id long, text_hash long, a long, b long")


def _marked(texts: list[bytes], places: list[list[bytes]], length: int) -> pa.RecordBatch:
    longest = RunIndex(texts).matching_statistics() >= length
    ends = np.cumsum([len(t) for t in texts])
    out = []
    for text, where, end in zip(texts, places, ends.tolist()):
        windows = len(text) - length + 1
        at = np.frombuffer(b"".join(where), "<i8").reshape(-1, 3)
        if len(at) > 1:  # the stretch itself occurs again: every window does
            spans = np.array([[0, windows]])
        else:
            hit = np.flatnonzero(np.diff(np.concatenate([[0], longest[end - len(text): end - length + 1].astype(np.int8), [0]])))
            spans = hit.reshape(-1, 2)
        if len(spans):
            out.append(np.column_stack([np.repeat(at[:, :2], len(spans), axis=0), (at[:, 2:3] + spans[:, 0]).ravel(), (at[:, 2:3] + spans[:, 1] + length - 1).ravel()]))
    rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["doc_id", "text_hash", "a", "b"])


def dedup(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed byte ranges, maximal) and kept (remaining bytes) per row.

    Removes each byte covered by a ``length``-byte string that also starts anywhere else in
    the input, in the same text too; strings never cross texts and are judged on the input.
    Only doc_id and text are read; rows without doc_id take no part; NULL text counts as empty; repeated rows are texts of their
    own, so each is a copy of the other. An empty table gives no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    return apply_spans(docs, repeated_spans(docs, length, often))


def repeated_spans(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_hash, spans): covered byte ranges of each text that has any."""
    docs = docs.where(F.col("doc_id").isNotNull())
    flagged = keep(repeated_anchors(docs, length, often), "anchors")
    # One span per stretch and document at most a few: gathered per document.
    marked = repeated_windows(stretches(docs, flagged, length), length)
    spans = keep(marked.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop_kept(flagged)
    return spans


def apply_spans(docs: DataFrame, spans: DataFrame, columns: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, kept and the digest columns, with ``columns`` of the input kept.

    ``as_text``: kept is a string, from which a character that a cut left in part is dropped.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text", *columns)
    joined = keyed.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans", *columns)
    extra = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                whole: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in found or ()):
                    if whole and x[0] <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], x[1])
                    else:
                        whole.append([*x])
                cuts = [0, *(y for x in whole for y in x), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((len(data), [{"a": a, "b": b} for a, b in whole], kept.decode(errors="ignore") if as_text else kept, len(data) - len(kept), len(whole), hashlib.sha256(kept).hexdigest()))
            columns_ = list(zip(*out)) if out else [()] * 6
            types = (pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns_, types)), *batch.columns[3:]], ["doc_id", "n_bytes", "spans", "kept", "n_removed", "n_spans", "kept_sha256", *columns])

    kind = "string" if as_text else "binary"
    return joined.mapInArrow(remove, f"doc_id long, n_bytes long, spans array<struct<a: long, b: long>>, kept {kind}, n_removed long, n_spans long, kept_sha256 string" + extra)
