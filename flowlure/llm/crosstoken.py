"""Alignment of the tokens of two vocabularies by pointer jumping (operator 13).

Vocabulary A is byte-level BPE over a space and the text, B is sentencepiece BPE over the
text, to which it adds that space. Every token points to the token that overlaps it and
reaches farthest to the right, where two end together to B's. Doubling these successors
(``succ = succ[succ]``, on whole arrays) leads every token to the last one of its component,
whose number labels the group; groups are what common token ends cut the bytes into.

Linked tokens end together, so the bytes of one are a suffix of the other's: the pairs that
can ever be linked are bounded by the vocabularies alone (``Vocabularies.slots``), whatever
the corpus holds. Their corpus-wide counts are thus safe to broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlure.llm.parts import ODD_SPACE, PretokenEncoder, _byte_letters, once, slices, split_parts
from flowlure.llm.tables import drop_kept, keep
from flowlure.llm.words import sums

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are worked on at once.
SLICE_BYTES = 2_000_000
#: Parts, and bytes of their groups, that a worker remembers; beyond either it starts anew (same results).
REMEMBERED, REMEMBERED_BYTES = 250_000, 24_000_000
#: Documents whose links are added up at once.
ROWS = 2000
#: A space that parts texts: both tokenizers begin anew at one that follows no white space and ends no text.
PARTING = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary"
COUNTED = "slot int, a_id int, b_id int, count long"
RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Vocabularies:
    """Both vocabularies' token bytes, and a number (slot) for every pair of ids that can be linked."""

    def __init__(self, file_a: str, file_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(public_tokenizers.path(file_a))
        a.encode_special_tokens = True  # their strings inside texts are plain text
        self.encode_a = PretokenEncoder(a, True, REMEMBERED // 2)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file_b))
        letters = {c: b for b, c in _byte_letters().items()}
        special = set(a.get_added_tokens_decoder())
        self.bytes_a = [b"" if i in special else bytes(letters[c] for c in a.id_to_token(i)) for i in range(a.get_vocab_size())]
        self.bytes_b, fallback = [], np.zeros(self.b.get_piece_size(), bool)
        for i in range(self.b.get_piece_size()):
            fallback[i] = self.b.is_byte(i)
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if fallback[i] else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.fallback = fallback
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b))):
            raise ValueError("pieces of B that hold a space after its first letters join parts of texts")
        self.len_a, self.begin_a = _sizes(self.bytes_a)
        self.len_b, self.begin_b = _sizes(self.bytes_b)
        self.pool_a, self.pool_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        digits = [b"%d" % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.len_d, self.begin_d = _sizes(digits)
        self.pool_d = np.frombuffer(b"".join(digits), np.uint8)
        #: Pairs (a, suffix of a), (b, suffix of b), (a, its last byte's fallback token).
        self.total_a, self.total_b = int(self.len_a.sum()), int(self.len_b.sum())
        self.slots = self.total_a + self.total_b + len(self.bytes_a)

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each linked pair of ids: the longer token and the length of the shorter one tell both."""
        la, lb = self.len_a[a], self.len_b[b]
        plain = np.where(la >= lb, self.begin_a[a] + lb - 1, self.total_a + self.begin_b[b] + la - 1)
        return np.where(self.fallback[b], self.total_a + self.total_b + a, plain)

    def ids_of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pairs that occur."""
        by_a = {x: i for i, x in enumerate(self.bytes_a) if x}
        by_b = {x: i for i, x in enumerate(self.bytes_b) if x and not self.fallback[i]}
        last = {self.bytes_b[i][0]: i for i in np.flatnonzero(self.fallback)}
        a, b = np.zeros(len(slot), np.int32), np.zeros(len(slot), np.int32)
        for k, s in enumerate(slot.tolist()):
            if s < self.total_a:
                i = int(np.searchsorted(self.begin_a, s, "right")) - 1
                a[k], b[k] = i, by_b[self.bytes_a[i][-(s - int(self.begin_a[i]) + 1):]]
            elif s < self.total_a + self.total_b:
                s -= self.total_a
                i = int(np.searchsorted(self.begin_b, s, "right")) - 1
                a[k], b[k] = by_a[self.bytes_b[i][-(s - int(self.begin_b[i]) + 1):]], i
            else:
                a[k] = s - self.total_a - self.total_b
                b[k] = last[self.bytes_a[a[k]][-1]]
        return a, b


def _sizes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return size, np.cumsum(size) - size


def _spread(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``pool``, one after another."""
    shift = begin - (np.cumsum(size) - size)
    return pool[np.repeat(shift, size) + np.arange(int(size.sum()))]


def _ends(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place among B's tokens of the terminal that each token of A, and of B, converges to.

    ``end_a`` and ``end_b`` rise, and both cover the same bytes. The token that overlaps a
    token and reaches farthest is the other side's over its last byte.
    """
    over_a, over_b = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    at_b = len(end_a) + np.arange(len(end_b))
    succ = np.concatenate([len(end_a) + over_a, np.where(end_a[over_b] > end_b, over_b, at_b)])
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            break
        succ = jumped
    return succ[: len(end_a)] - len(end_a), succ[len(end_a):] - len(end_a)


class Aligner:
    """Groups and links of texts' parts, each part aligned when the worker first meets it."""

    def __init__(self, vocabularies: Vocabularies, limit: int = REMEMBERED, limit_bytes: int = REMEMBERED_BYTES):
        self.v, self.limit, self.limit_bytes = vocabularies, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []  # "a1,a2|b1;a3|b2,b3;" of a part, empty where its bytes do not agree
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, 1 if the bytes agree
        self.begin = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.held = 0

    def places(self, parts: list[str]) -> np.ndarray:
        """Where each part is held; call once per slice, as a full memory starts anew here."""
        if len(self.known) > self.limit or self.held > self.limit_bytes:
            self.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        if new:
            self._add(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _add(self, parts: list[str]) -> None:
        v = self.v
        ids_a, n_a = _flat(v.encode_a([" " + p for p in parts]))
        ids_b, n_b = _flat(v.b.encode(parts, num_threads=1))
        told = [b" " + p.encode() for p in parts]
        agrees = self._same(told, ids_a, n_a, v.pool_a, v.begin_a, v.len_a) & self._same(told, ids_b, n_b, v.pool_b, v.begin_b, v.len_b)
        ids_a, ids_b = ids_a[np.repeat(agrees, n_a)], ids_b[np.repeat(agrees, n_b)]
        n_a, n_b = np.where(agrees, n_a, 0), np.where(agrees, n_b, 0)
        end_a, end_b = np.cumsum(v.len_a[ids_a]), np.cumsum(v.len_b[ids_b])
        of_a, of_b = terminals(end_a, end_b)
        last_b = of_b == np.arange(len(of_b))
        number = np.cumsum(last_b) - 1  # of the group that a terminal closes
        group_a, group_b = number[of_a], number[of_b]
        linked = np.flatnonzero(end_b[of_a] == end_a) if len(of_a) else np.zeros(0, np.int64)
        pairs = v.slot(ids_a[linked], ids_b[of_a[linked]]).astype(np.uint32)
        n_groups = sums(last_b.astype(np.int64), _ends(n_b))
        written, width = self._written(ids_a, ids_b, group_a, group_b)
        cut = _ends(width)[_ends(n_a + n_b)]
        blob = written.tobytes()
        base = len(self.groups)
        self.known.update(zip(parts, range(base, base + len(parts))))
        self.groups += [blob[i:j] for i, j in zip(cut.tolist(), cut[1:].tolist())]
        self.begin = np.concatenate([self.begin, len(self.pool) + _ends(n_groups)[:-1]])
        self.pool = np.concatenate([self.pool, pairs])
        self.numbers = np.concatenate([self.numbers, np.column_stack([n_a, n_b, n_groups, agrees])])
        self.held += len(blob) + sum(map(len, told))

    @staticmethod
    def _same(told: list[bytes], ids: np.ndarray, n: np.ndarray, pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each part's tokens join to its bytes."""
        mine, want = sums(size[ids], _ends(n)), np.fromiter(map(len, told), np.int64, len(told))
        fits = mine == want
        ids = ids[np.repeat(fits, n)]
        joined = _spread(pool, begin[ids], size[ids])
        equal = joined == np.frombuffer(b"".join(t for t, f in zip(told, fits) if f), np.uint8)
        fits[fits] = sums(~equal, _ends(want[fits])) == 0
        return fits

    def _written(self, ids_a, ids_b, group_a, group_b) -> tuple[np.ndarray, np.ndarray]:
        """The groups in decimal, and the bytes of each token with its sign, in their order there."""
        v, groups = self.v, int(group_b[-1]) + 1 if len(group_b) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(ids_a)) + _ends(in_b)[group_a]
        place_b = np.arange(len(ids_b)) + _ends(in_a)[group_b + 1]
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        if groups:
            sign[place_a[np.append(np.flatnonzero(np.diff(group_a)), len(group_a) - 1)]] = ord("|")
            sign[place_b[np.append(np.flatnonzero(np.diff(group_b)), len(group_b) - 1)]] = ord(";")
        width = v.len_d[ids] + 1
        out = np.empty(int(width.sum()), np.uint8)
        ends = np.cumsum(width) - 1
        digits = np.ones(len(out), bool)
        digits[ends] = False
        out[ends] = sign
        out[digits] = _spread(v.pool_d, v.begin_d[ids], v.len_d[ids])
        return out, width

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """(tokens of A, of B, groups per text; groups as text; slots of the links) of a slice of texts."""
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        codes, offsets, parts = split_parts(texts)
        rows = np.flatnonzero(odd)
        cut = [PARTING.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
        plain = set(np.unique(codes[np.repeat(~odd, np.diff(offsets))]).tolist())
        # Parts that only odd texts have are not asked for; an empty text is one empty part and has no tokens.
        wanted = [c for c in range(len(parts)) if c in plain and parts[c]]
        found = self.places([parts[c] for c in wanted] + [p for c in cut for p in c])
        place = np.full(len(parts), -1, np.int64)
        place[wanted] = found[: len(wanted)]
        mine = [place[codes[i:j]] for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
        at = len(wanted)
        for row, c in zip(rows.tolist(), cut):
            mine[row] = found[at: at + len(c)]
            at += len(c)
        numbers, groups, links = np.zeros((len(texts), 3), np.int64), [b""] * len(texts), [b""] * len(texts)
        known = self.groups
        for row, m in enumerate(mine):
            if not len(m) or m[0] < 0 or not (of := self.numbers[m])[:, 3].all():
                continue
            numbers[row] = of[:, :3].sum(axis=0)
            groups[row] = b"".join([known[k] for k in m.tolist()])[:-1]
            links[row] = _spread(self.pool, self.begin[m], of[:, 2]).tobytes()
        return numbers, groups, links


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n


def align(docs: DataFrame, file_a: str = VOCABULARY_A, file_b: str = VOCABULARY_B, with_groups: bool = True) -> DataFrame:
    """See ALIGNED: per row of ``docs`` its tokens, groups as ``a1,a2|b1;a3|b2,b3`` and links.

    ``groups`` is left out (NULL) without ``with_groups``; its digest always comes. ``links``
    holds the slot of each link, little-endian unsigned 32-bit integers. Texts that are NULL
    or empty, or whose joined bytes differ from a space and the text, have no tokens, and the
    digest is then the empty string. Rows alike are aligned each by itself, rows without
    doc_id too; only doc_id and text are read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(("aligner", file_a, file_b), lambda: Aligner(Vocabularies(file_a, file_b)))
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                numbers, groups, links = aligner.align(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), *(pa.array(numbers[:, k]) for k in range(3)),
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                    pa.array([g.decode() for g in groups]) if with_groups else pa.nulls(len(groups), pa.string()),
                    pa.array(links, pa.binary()),
                ], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, file_a: str = VOCABULARY_A, file_b: str = VOCABULARY_B) -> DataFrame:
    """(slot, a_id, b_id, count): how many links of the corpus hold each pair.

    A task adds its links up before anything is shuffled: at most one row per pair and task.
    """
    slots = Vocabularies(file_a, file_b).slots

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.column(0).slice(at, ROWS).to_pylist()
                counts += np.bincount(np.frombuffer(b"".join(x for x in some if x), "<u4"), minlength=slots)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], ["slot", "count"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(("vocabularies", file_a, file_b), lambda: Vocabularies(file_a, file_b))
        for batch in batches:
            a, b = known.ids_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), batch.column(1)], ["slot", "a_id", "b_id", "count"])

    summed = aligned.select("links").mapInArrow(add, "slot int, count long").groupBy("slot").agg(F.sum("count").alias("count"))
    return summed.mapInArrow(name, COUNTED)


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: whether no pair of the same B id has a higher count."""
    most = counts.groupBy(F.col("b_id").alias("of")).agg(F.max("count").alias("most"))
    return counts.join(most, counts["b_id"] == most["of"]).select(*counts.columns, (F.col("count") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, file_a: str = VOCABULARY_A, file_b: str = VOCABULARY_B) -> DataFrame:
    """Per row of ``aligned`` its links, those that are their B id's best, and their counts' sum.

    ``counts`` passes the driver: at most ``Vocabularies.slots`` rows (some 600,000 for the
    two vocabularies), however large the corpus.
    """
    slots = Vocabularies(file_a, file_b).slots
    table = with_best(counts).select("slot", "count", "best").toArrow()
    value, best = np.zeros(slots, np.int64), np.zeros(slots, bool)
    at = table.column("slot").to_numpy()
    value[at], best[at] = table.column("count").to_numpy(), table.column("best").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column(batch.schema.get_field_index("links"))
            n = pc.fill_null(pc.divide(pc.binary_length(links), 4), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = np.frombuffer(b"".join(x for x in links.to_pylist() if x), "<u4")
            ends = _ends(n)
            sums_of = [pa.array(x) for x in (n, sums(best[slot], ends), sums(value[slot], ends))]
            rest = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*rest[:4], *sums_of, rest[4]], list(RESULT))

    rows = aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, file_a: str = VOCABULARY_A, file_b: str = VOCABULARY_B) -> DataFrame:
    """``align``, ``pair_counts`` and ``scored`` in turn, over tables written once: see RESULT."""
    aligned = keep(align(docs, file_a, file_b, with_groups=False), "aligned")
    counts = keep(pair_counts(aligned, file_a, file_b), "pair-counts")
    out = scored(aligned, counts, file_a, file_b)
    drop_kept(counts)
    return out
