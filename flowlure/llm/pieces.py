"""SentencePiece encoding by backtracking and decoding (operator 8).

Encoding finds the one sequence of pieces in which every two neighbours stay apart when
their joint text is merged anew. Aho-Corasick gives the pieces that start at each place;
the longest is tried first, a place from which no piece leads on is marked in a bitfield
and never entered again. Neighbour checks run the merges on the pair's text and are
remembered. A character outside the vocabulary becomes its UTF-8 bytes' pieces.
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

from flowlure.llm.parts import PartMemory, gather, once, per_text, slices, split_parts

SPACE = "▁"  # what the vocabulary writes for a space


class PieceModel:
    """Pieces of a sentencepiece BPE model with byte fallback, a dummy prefix and no normalisation."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if model.is_control(i) or model.is_unknown(i)}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if i not in special and not model.is_byte(i)]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        #: With pieces that hold the space sign in front only, texts fall apart before each run of it.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        raw = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for value, i in self.byte.items():
            raw[i] = bytes([value])
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_pool = np.frombuffer(b"".join(raw), np.uint8)
        digits = [b"%d " % i for i in range(len(raw))]
        self.digit_size = np.array([len(x) for x in digits], np.int64)
        self.digit_start = np.cumsum(self.digit_size) - self.digit_size
        self.digit_pool = np.frombuffer(b"".join(digits), np.uint8)

    def merge(self, text: str) -> list[str]:
        """Pieces by the merges themselves: best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_whole(self, piece: int) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(self.merge(self.pieces[piece])) == 1
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            known = self.apart[left, right] = self.merge(a + b) == [a, b]
        return known

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already written as the space sign."""
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            starts[end - found[0] + 1].append(found)  # by rising length
        out: list[int] = []
        at = 0
        while at < n:
            if not starts[at]:  # no piece, not even of one character: bytes
                out.extend(self.byte[b] for b in text[at].encode())
                at += 1
                continue
            stop = at
            while stop < n and starts[stop]:
                stop += 1
            out.extend(self._backtrack(starts, at, stop))
            at = stop
        return out

    def _backtrack(self, starts: list[list[tuple[int, int]]], first: int, stop: int) -> list[int]:
        open_places = (1 << (stop - first + 1)) - 1
        ids: list[int] = []
        tried: list[int] = []  # rank of the piece chosen at each step
        places: list[int] = [first]
        rank = len(starts[first]) - 1
        while places[-1] < stop:
            at = places[-1]
            options = starts[at]
            while rank >= 0:
                size, piece = options[rank]
                if (
                    at + size <= stop
                    and open_places >> (at + size - first) & 1
                    and self.stays_whole(piece)
                    and (not ids or self.stay_apart(ids[-1], piece))
                ):
                    break
                rank -= 1
            if rank >= 0:
                ids.append(piece)
                tried.append(rank)
                places.append(at + size)
                rank = len(starts[at + size]) - 1 if at + size < stop else -1
            else:
                open_places &= ~(1 << (at - first))
                places.pop()
                ids.pop()
                rank = tried.pop() - 1
        return ids

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        return [self.encode_part(p) for p in parts]

    def decode_bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined bytes of several sequences, as the encoder makes them, and their sizes; each loses its dummy space."""
        size = self.raw_size[ids]
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        begins = self.raw_start[ids]
        spaced = firsts[(size[firsts] > 0) & (self.raw_pool[np.minimum(begins[firsts], len(self.raw_pool) - 1)] == 32)]
        size[spaced] -= 1
        begins[spaced] += 1
        shift = begins - (np.cumsum(size) - size)
        pool = self.raw_pool[np.repeat(shift, size) + np.arange(int(size.sum()))]
        return pool, per_text(size, np.concatenate([[0], ends]))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes of a run of byte pieces that are no UTF-8 each read as U+FFFD."""
        values, out, run, begun = {i: b for b, i in self.byte.items()}, [], bytearray(), False
        for i in [*ids, None]:
            if i in values:
                run.append(values[i])
                begun = True
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i is not None and self.raw_size[i]:
                text = self.pieces[i].replace(SPACE, " ")
                out.append(text[1:] if not begun and text[0] == " " else text)
                begun = True
        return "".join(out)

    def decimal(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids in decimal, a space after each, and their sizes per sequence."""
        size = self.digit_size[ids]
        shift = self.digit_start[ids] - (np.cumsum(size) - size)
        pool = self.digit_pool[np.repeat(shift, size) + np.arange(int(size.sum()))]
        return pool, per_text(size, np.concatenate([[0], np.cumsum(sizes)]))


def _lenient(raw: bytes) -> str:
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "\ufffd")
            raw = raw[e.start + 1:]
    return "".join(out)


class PieceEncoder:
    """Ids of whole texts through their distinct parts."""

    def __init__(self, model_file: str):
        self.model = PieceModel(model_file)
        self.memory = PartMemory(self.model.encode_parts)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, "  |^ | $|^$|" + SPACE).to_numpy(zero_copy_only=False)
        codes, offsets, parts = split_parts(texts)
        rows = np.flatnonzero(odd)
        runs = [self._runs(t) for t in texts.take(pa.array(rows)).to_pylist()]
        slots = self.memory.slots([SPACE + p for p in parts] + [x for r in runs for x in r])
        mine, tail = slots[: len(parts)][codes], slots[len(parts):]
        if len(rows):
            sizes = np.diff(offsets)
            pieces = np.split(mine, offsets[1:-1])
            at = 0
            for row, run in zip(rows, runs):
                pieces[row], sizes[row] = tail[at: at + len(run)], len(run)
                at += len(run)
            mine, offsets = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.memory, mine).astype(np.int64), per_text(self.memory.size[mine], offsets)

    def _runs(self, text: str) -> list[str]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}]*", whole) if self.model.splits else [whole]


def piece_encoder(file: str) -> PieceEncoder:
    def make() -> PieceEncoder:
        import public_tokenizers

        return PieceEncoder(public_tokenizers.path(file))

    return once(("pieces", file), make)


def encode_documents(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", end_id: int | None = 2) -> DataFrame:
    """doc_id, ids (array of int, with the end id) and decoded text of every whole text.

    NULL text counts as empty and gives the end id alone. Other columns are not read; rows
    with equal doc_id are encoded each by itself; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, sizes, model in _encoded(batches, vocabulary, end_id):
            pool, raw_sizes = model.decode_bytes(ids, sizes)
            yield pa.RecordBatch.from_arrays([
                doc_ids,
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32())),
                pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(raw_sizes)]).astype(np.int64)), pa.py_buffer(pool.tobytes())).cast(pa.string()),
            ], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None):
    encoder = piece_encoder(vocabulary)
    for batch in batches:
        for at, texts in slices(batch.column(1), 4_000_000):
            ids, sizes = encoder(texts)
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            yield batch.column(0).slice(at, len(texts)), ids, sizes, encoder.model


def digest_documents(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", end_id: int | None = 2) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids in decimal and of the decoded text.

    The same encoding as ``encode_documents``, digested where it is made, so that ids and
    texts need not leave the task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, sizes, model in _encoded(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_arrays([
                doc_ids, pa.array(sizes, pa.int64()),
                pa.array(_digests(*model.decimal(ids, sizes), trim=1)), pa.array(_digests(*model.decode_bytes(ids, sizes))),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(pool: np.ndarray, sizes: np.ndarray, trim: int = 0) -> list[str]:
    view, ends = memoryview(np.ascontiguousarray(pool)), np.cumsum(sizes)
    return [hashlib.sha256(view[e - s: max(e - s, e - trim)]).hexdigest() for e, s in zip(ends.tolist(), sizes.tolist())]
