"""N-gram Jaccard join by vertical partitioning (operator 3).

The global n-gram order is cut into fragments; each counts a pair's partial overlap by
itself, and the sum per pair decides. Candidate pairs come from the sets' prefixes, rarest
n-grams first, bounded by sizes and by how much of a set any other set shares.

Before that, two exact reductions: documents with equal sets are one class, and a class of
which too few n-grams occur in any other class cannot be linked. Large groups of near
copies are not expanded into all pairs: in rounds, each class is held against one centre
that it shares many n-grams with, and the links found merge classes into components; then
all remaining candidate pairs between different components are checked, so no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.components import components
from flowlure.llm.parts import slices, split_parts
from flowlure.llm.tables import drop_kept, keep
from flowlure.llm.words import SEPARATORS, text_bytes

#: Fragments of the global n-gram order.
FRAGMENTS = 4
#: N-grams in one bucket of the occurrence count (about), and the least number of buckets.
BUCKET_NGRAMS = 1_500_000
LEAST_BUCKETS = 24
#: Rows of ids (16 bytes each) that may be broadcast instead of shuffling the texts they select.
BROADCAST_ROWS = 2_000_000
#: Longs in a set's sketch.
SKETCH_WORDS = 16
#: Rounds of proposals go on while more than one pair in so many is a link.
FRUITFUL = 10
#: Bits of an n-gram's hash kept inside a bucket; a chance meeting only adds a candidate.
LOW_BITS = 40
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SEPARATORS] = 0x20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash per text with a closing end): each text's distinct word n-grams, sorted.

    Words are runs of other than ASCII white space, A-Z lower-cased. A text with fewer words
    than ``n`` has its whole sequence as one n-gram; a text without words has none.
    """
    raw, ends = text_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(FOLD[raw].tobytes()))
    codes, offsets, parts = split_parts(plain)
    if "" in parts:
        real = codes != parts.index("")
        codes, offsets = codes[real], np.concatenate([[0], np.cumsum(real)])[offsets]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))[codes]
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    m = max(len(hashes) - n + 1, 0)
    inside = owner[:m] == owner[n - 1:] if m else np.zeros(0, bool)
    h = np.full(m, n, np.uint64)
    for k in range(n if m else 0):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[k: k + m])
    h, owner_h = h[inside], owner[:m][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = [xxhash.xxh3_64_intdigest(hashes[offsets[i]: offsets[i + 1]].tobytes()) for i in short]
        h, owner_h = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([owner_h, short])
    order = np.lexsort((h, owner_h))
    h, owner_h = h[order], owner_h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner_h[1:] != owner_h[:-1])
    h, owner_h = h[first], owner_h[first]
    return h, np.searchsorted(owner_h, np.arange(len(sizes) + 1))


def _digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, as two signed columns."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        ends = np.concatenate([[np.uint64(0)], np.cumsum(_mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((ends[offsets[1:]] - ends[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _planes(low: np.ndarray) -> bytes:
    """Sorted numbers as byte planes, most significant first: the sorted high bytes compress well."""
    return np.ascontiguousarray(low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - LOW_BITS // 8:].T).tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - LOW_BITS // 8:] = np.frombuffer(raw, np.uint8, n * LOW_BITS // 8).reshape(-1, n).T
    return out.view(">u8").ravel().astype(np.uint64)


SENT = "bucket int, uid long, directory boolean, n long, low binary, doc binary, tags binary"
SETS = "doc_id long, n_shingles long, d1 long, d2 long, shared long"


def sets_with_shared(docs: DataFrame, n: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, set digest, and how many of its n-grams occur in another set.

    Occurrences are counted in buckets of the hash range; sets are told apart by the first 64
    bits of their digest. A task sends each bucket one row of
    packed, sorted n-grams per slice of its texts, and gets back counts per document.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // (6 * BUCKET_NGRAMS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                h, offsets = ngram_sets(texts, n)
                d1, d2 = _digests(h, offsets)
                sizes = np.diff(offsets)
                table = np.column_stack([batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64), sizes, d1, d2])
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
                key = ((h >> np.uint64(LOW_BITS)) * np.uint64(buckets) >> np.uint64(64 - LOW_BITS) << np.uint64(LOW_BITS)) | (h & np.uint64((1 << LOW_BITS) - 1))
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                cuts = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
                rows = [(int(uid % buckets), uid, True, len(sizes), b"", table.astype("<i8").tobytes(), b"")]
                for b in range(buckets):
                    some = slice(cuts[b], cuts[b + 1])
                    if cuts[b + 1] > cuts[b]:
                        low = key[some] & np.uint64((1 << LOW_BITS) - 1)
                        mine, place = np.unique(owner[some], return_inverse=True)
                        rows.append((b, uid, False, len(low), _planes(low), place.astype("<u4" if len(mine) > 65535 else "<u2").tobytes(), mine.astype("<u4").tobytes() + d1[mine].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], SENT_NAMES)
                uid += 1

    def count(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["directory"]]
        sent = group[~group["directory"]]
        out = [pd.DataFrame({"uid": known["uid"], "directory": True, "data": known["doc"]})]
        if len(sent):
            low = np.concatenate([_unplanes(r.low, r.n) for r in sent.itertuples()])
            sizes = [len(t) // 12 for t in sent["tags"]]
            tables = [np.frombuffer(t, "<u4", k) for t, k in zip(sent["tags"], sizes)]
            digests = [np.frombuffer(t, "<i8", k, 4 * k) for t, k in zip(sent["tags"], sizes)]
            places = [np.frombuffer(r.doc, "<u4" if len(t) > 65535 else "<u2").astype(np.int64) for r, t in zip(sent.itertuples(), tables)]
            tag = np.concatenate([t[p] for t, p in zip(digests, places)])
            order = np.lexsort((tag, low))
            low, tag = low[order], tag[order]
            fresh = np.concatenate([[True], low[1:] != low[:-1]])
            kinds = np.add.reduceat(fresh | np.concatenate([[True], tag[1:] != tag[:-1]]), np.flatnonzero(fresh))
            shared = np.zeros(len(low), bool)
            shared[order] = (kinds > 1)[np.cumsum(fresh) - 1]
            at, data = 0, []
            for t, p in zip(tables, places):
                found = np.bincount(p, shared[at: at + len(p)], len(t))
                data.append(np.column_stack([t, found]).astype("<u4").tobytes())
                at += len(p)
            out.append(pd.DataFrame({"uid": sent["uid"], "directory": False, "data": data}))
        return pd.concat(out)[["uid", "directory", "data"]]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        table = np.frombuffer(group.loc[group["directory"], "data"].iloc[0], "<i8").reshape(-1, 4)
        shared = np.zeros(len(table), np.int64)
        for raw in group.loc[~group["directory"], "data"]:
            found = np.frombuffer(raw, "<u4").reshape(-1, 2)
            shared[found[:, 0]] += found[:, 1]
        return pd.DataFrame({"doc_id": table[:, 0], "n_shingles": table[:, 1], "d1": table[:, 2], "d2": table[:, 3], "shared": shared})

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, SENT)
    counted = sent.groupBy("bucket").applyInPandas(count, "uid long, directory boolean, data binary")
    return counted.groupBy("uid").applyInPandas(finish, SETS)


SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]


def segments_of(docs: DataFrame, nodes: DataFrame, n: int = 5, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc, f, n, sketch, grams): the part of each chosen document's set in each fragment.

    ``sketch``: bits of the whole set's hashes, SKETCH_WORDS longs.
    ``nodes`` are few against all documents; up to BROADCAST_ROWS they are broadcast, beyond
    that the texts are shuffled to them.
    """
    few = nodes.count() <= BROADCAST_ROWS
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                h, offsets = ngram_sets(texts, n)
                ids = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
                rows = []
                for i, doc in enumerate(ids.tolist()):
                    own = h[offsets[i]: offsets[i + 1]]
                    f = (own >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
                    cuts = np.searchsorted(f, np.arange(fragments + 1))
                    sketch = np.zeros(64 * SKETCH_WORDS, np.uint8)
                    sketch[(own % np.uint64(len(sketch))).astype(np.int64)] = 1
                    bits = np.packbits(sketch, bitorder="little").view("<i8").tolist()
                    rows += [(doc, k, len(own), bits, own[a:b].astype("<i8", copy=False).view("<i8").tolist()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["doc", "f", "n", "sketch", "grams"])

    return chosen.mapInArrow(cut, "doc long, f int, n long, sketch array<long>, grams array<long>")


def prefixes(segments: DataFrame, merged: DataFrame, percent: int) -> DataFrame:
    """(gram, doc, n, low, reach, place, sketch): each set's prefix, rarest first, of n-grams that other components have too.

    ``merged``: (a, b) of ``components`` so far; ``low`` is a document's component. Two sets
    of Jaccard ``percent`` or more share an n-gram among each one's first
    n - ceil(percent * n) + 1. N-grams of one component only come first and match nothing.
    ``reach``: how many n-grams other components have; ``place``: the n-gram's, from 1.
    """
    known = segments.join(merged.select(F.col("a").alias("doc"), F.col("b").alias("low")), "doc", "left").withColumn("low", F.coalesce("low", "doc"))
    grams = known.select("doc", "low", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("low").alias("x"), F.max("low").alias("y")).where("x < y").select("gram", "df")
    held = grams.join(common, "gram")
    own = held.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("own"))  # one set's n-grams
    # What belongs to a document joins once per document, not along with each of its n-grams.
    of = known.groupBy("doc").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    gathered = own.join(of, "doc")
    length = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1
    reach = F.size("own")
    room = length - (F.col("n") - reach)
    cut = gathered.where(room > 0).select("doc", "n", "low", reach.alias("reach"), "sketch", F.posexplode(F.slice("own", F.lit(1), room.cast("int"))).alias("at", "g"))
    return cut.select(F.col("g.gram").alias("gram"), "doc", "n", "low", "reach", (F.col("n") - F.col("reach") + F.col("at") + 1).alias("place"), "sketch")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, common): partial overlaps per fragment, summed per pair."""
    # What is joined is a segment of one fragment at a time; Spark orders the rows by itself.
    left = segments.select(F.col("doc").alias("a"), "f", F.col("grams").alias("left"))
    right = segments.select(F.col("doc").alias("b"), "f", F.col("grams").alias("right"))
    partial = pairs.join(right, "b").join(left, ["a", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("left", "right")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))


def links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union."""
    return overlaps(pairs, segments).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _enough(overlap: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (F.col("na") + F.col("nb"))


def _feasible(percent: int) -> Column:
    """Whether two sets can overlap enough by their sizes, reaches and sketches.

    Each bit that one sketch has alone is an n-gram at least that the other set lacks.
    """
    x, y = F.col("sa"), F.col("sb")
    alone = [sum((F.bit_count(p[i].bitwiseAND(F.bitwise_not(q[i]))) for i in range(1, SKETCH_WORDS)), F.bit_count(p[0].bitwiseAND(F.bitwise_not(q[0])))) for p, q in ((x, y), (y, x))]
    return _enough(F.least("ra", "rb"), percent) & _enough(F.least(F.col("na") - alone[0], F.col("nb") - alone[1]), percent)


_SIDE = {"doc": "", "n": "n", "reach": "r", "sketch": "s", "low": "l", "place": "p"}


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    """Columns renamed for one side of a pair: doc is the side itself."""
    return rows.select(*columns, *[F.col(c).alias(_SIDE[c] + side) for c in _SIDE])


def _proposals(rows: DataFrame, percent: int, salt: int) -> DataFrame:
    """(a, b, na, nb): for each document the partner that it shares most prefix n-grams with.

    By turns, an n-gram offers as partner one centre, the document with the largest part of
    itself in other components, or the next document by size; always of another component.
    A document proposes one partner, so a round's pairs are no more than its documents.
    """
    mixed = F.xxhash64(F.lit(salt), "doc")
    whole = F.struct(*_SIDE)
    if salt % 2:
        offered = rows.withColumn("c", F.lag(whole).over(Window.partitionBy("gram").orderBy("n", mixed, "doc")))
    else:
        best = rows.groupBy("gram").agg(F.min_by(whole, F.struct(F.col("n") - F.col("reach"), mixed)).alias("c"))
        offered = rows.join(best, "gram")
    met = _side(offered, "b", "c").select("*", *[F.col(f"c.{c}").alias(_SIDE[c] + "a") for c in _SIDE])
    met = met.where((F.col("la") != F.col("lb")) & _feasible(percent))
    votes = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("b", "nb").agg(F.max(F.struct("votes", "a", "na")).alias("m"))
    return chosen.select(F.col("m.a").alias("a"), "b", F.col("m.na").alias("na"), "nb")


def _remaining(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): all pairs of different components that may be linked.

    At the first n-gram that two sets share, what follows it in either bounds their overlap.
    """
    # The smaller set a needs 2 * percent / (100 + percent) of itself, so only a short prefix can be first.
    smaller = _side(rows.where((100 + percent) * (F.col("n") - F.col("place") + 1) >= 2 * percent * F.col("n")), "a", "gram")
    met = smaller.join(_side(rows, "b", "gram"), "gram")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    first = _enough(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1, percent)
    return met.where(ordered & (F.col("la") != F.col("lb")) & first & _feasible(percent)).select("a", "b", "na", "nb").distinct()


def linked_classes(segments: DataFrame, percent: int) -> DataFrame:
    """(a, b): each linked document that is not the least of its component, with that least one.

    Rounds of proposals, one pair per document, merge what is easily found; the prefixes are
    drawn anew for the components reached. When a round links few of the pairs that it
    tries, the exact rest checks every remaining pair of different components.
    """
    merged, salt, progress = components(segments.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)), 0, True
    while True:
        open_ = keep(prefixes(segments, merged, percent), "prefixes")
        pairs = keep(_proposals(open_, percent, salt) if progress else _remaining(open_, percent), "pairs")
        found = keep(links(pairs, segments, percent), "links")
        tried, new = pairs.count(), found.count()
        if new:
            before, merged = merged, components(merged.select("a", "b").unionByName(found))
            drop_kept(before)
        drop_kept(open_, pairs, found)
        if not progress:
            return merged
        progress, salt = FRUITFUL * new > tried, salt + 1


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for every row.

    Only doc_id and text are read; rows without doc_id take no part. A row without text or
    words has an empty set, is linked with nothing and is its own component. Rows with equal doc_id and different texts are
    the same document twice: each keeps its set size, their components are merged. An empty
    table gives no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    sets = keep(sets_with_shared(docs, n), "sets")
    filled = sets.where("n_shingles > 0")
    classes = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.max("shared").alias("shared"))
    classes = keep(classes, "classes")
    active = classes.where(100 * F.col("shared") >= percent * F.col("n_shingles")).select(F.col("doc").alias("doc_id"))
    segments = keep(segments_of(docs, active, n), "segments")
    linked = linked_classes(segments, percent)
    # A class goes by its least document; copies join it through their digest.
    copies = filled.join(classes.where("doc < last"), ["n_shingles", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).where("a <> b")
    found = linked.select("a", F.col("b").alias("component")).join(copies.select(F.col("a").alias("copy"), F.col("b").alias("a")), "a", "right")
    direct = linked.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    through = found.select(F.col("copy").alias("doc_id"), F.coalesce("component", "a").alias("component"))
    labels = direct.unionByName(through).groupBy("doc_id").agg(F.min("component").alias("component"))
    return sets.join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
