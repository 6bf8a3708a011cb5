"""Encoding whole texts through the distinct parts between their spaces.

A tokenizer that never merges across a space gives a text the concatenation of its
parts' ids. An Arrow batch is split and dictionary-encoded in C++, so Python only sees
the batch's distinct parts, and the tokenizer only those that the worker has not met.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 6_000_000
#: Parts that a worker remembers; beyond it only parts seen again are kept (same results).
REMEMBERED = 700_000
#: Two white-space characters in a row, or one at an end: parts are then no longer independent.
ODD_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][\s\x0b\x1c-\x1f\x{85}\p{Z}]|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$"


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, sub-array) runs of rows of about ``limit`` bytes; NULL reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, column.slice(at, stop - at)
        at = stop


def split_parts(texts: pa.Array, sep: str = " ") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code per part, first part per text with a closing end, distinct parts)."""
    lists = pc.split_pattern(texts, sep)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets - offsets[0], coded.dictionary.to_pylist()


class PartMemory:
    """Ids of parts met by this worker; ``encode_many`` is asked only for new ones."""

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def slots(self, parts: list[str]) -> np.ndarray:
        """Slot of each part; call once per slice, as a full memory is renewed here."""
        if len(self.slot) > self.limit:
            again = [p for p in dict.fromkeys(parts) if p in self.slot]
            old = np.fromiter(map(self.slot.__getitem__, again), np.int64, len(again))
            self.pool = gather(self, old)
            self.size = self.size[old]
            self.start = np.cumsum(self.size) - self.size
            self.slot = dict(zip(again, range(len(again))))
        new = [p for p in dict.fromkeys(parts) if p not in self.slot]
        if new:
            ids = self.encode_many(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            base = len(self.slot)
            self.slot.update(zip(new, range(base, base + len(new))))
            self.start = np.concatenate([self.start[:base], len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size[:base], sizes])
            self.pool = np.concatenate([self.pool, fresh])
        return np.fromiter(map(self.slot.__getitem__, parts), np.int64, len(parts))


def gather(memory: PartMemory, slots: np.ndarray) -> np.ndarray:
    """Ids of the parts in ``slots``, concatenated."""
    size = memory.size[slots]
    total = int(size.sum())
    shift = memory.start[slots] - (np.cumsum(size) - size)
    return memory.pool[np.repeat(shift, size) + np.arange(total)]


def per_text(sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``sizes`` over each text's parts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


class TextEncoder:
    """ids of whole texts. ``spaced``: a part's ids depend on the space before it.

    ``spaced=False``: white space is dropped by the tokenizer, any single space splits.
    ``spaced=True``: byte-level pre-tokens may start with a space. A text with two white
    spaces in a row, or one at an end, is split before each run of white space instead.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], spaced: bool, limit: int = REMEMBERED):
        self.memory, self.spaced = PartMemory(encode_many, limit), spaced

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text)."""
        codes, offsets, parts = split_parts(texts)
        if not self.spaced:
            slots = self.memory.slots(parts)[codes]
            return gather(self.memory, slots), per_text(self.memory.size[slots], offsets)
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(odd)
        runs = [re.findall(r"\s*\S+|\s+", t) if t else [] for t in texts.take(pa.array(rows)).to_pylist()]
        plain = np.flatnonzero(~odd & (np.diff(offsets) > 0))
        heads = [parts[c] for c in codes[offsets[plain]]]
        names = [" " + p for p in parts] + heads + [x for r in runs for x in r]
        slots = self.memory.slots(names)
        mine = slots[: len(parts)][codes]
        mine[offsets[plain]] = slots[len(parts): len(parts) + len(heads)]
        if not len(rows):
            return gather(self.memory, mine), per_text(self.memory.size[mine], offsets)
        pieces, tail, at = [], slots[len(parts) + len(heads):], 0
        by_row = {}
        for row, run in zip(rows, runs):
            by_row[int(row)] = tail[at: at + len(run)]
            at += len(run)
        for row in range(len(texts)):
            pieces.append(by_row[row] if row in by_row else mine[offsets[row]: offsets[row + 1]])
        flat = np.concatenate(pieces)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return gather(self.memory, flat), per_text(self.memory.size[flat], bounds)


_LOADED: dict = {}


def once(key, make: Callable):
    """An object of this Python worker process that outlives a task; the last one asked for only.

    Workers serve one operator after another; what an earlier one remembered must not stay.
    """
    if key not in _LOADED:
        _LOADED.clear()
        made = make()
        _LOADED.clear()
        _LOADED[key] = made
    return _LOADED[key]


def library_encoder(file: str, spaced: bool, limit: int = REMEMBERED) -> TextEncoder:
    """Encoder over the tokenizers library and a public vocabulary file."""
    def make() -> TextEncoder:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        return TextEncoder(PretokenEncoder(tokenizer, spaced, limit // 2), spaced, limit)

    return once(("library", file, spaced, limit), make)


class PretokenEncoder:
    """Ids of many parts by the tokenizers library.

    Runs of letters, runs of a few signs and single line feeds between them are pre-tokens of
    their own in the byte-level and the lower-casing word vocabularies alike; their ids come
    straight from the library's model and are remembered, as the same word stands with and
    without them. Any other part goes through the library's whole chain.
    """

    WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
    LINES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!#$%&*]*(?:\n[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!#$%&*]*)*")
    PRETOKEN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,!#$%&*]+|\n")

    def __init__(self, tokenizer, spaced: bool, limit: int = REMEMBERED // 2):
        self.tokenizer, self.spaced, self.limit = tokenizer, spaced, limit
        self.known: dict[str, tuple[int, ...]] = {}
        self.table = _byte_letters()

    def _letters(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            text = word if word.isascii() and word[0] not in " \n" else word.encode().decode("latin-1").translate(self.table)
            if len(self.known) >= self.limit:
                self.known.clear()
            found = self.known[word] = tuple(t.id for t in self.tokenizer.model.tokenize(text))
        return found

    def __call__(self, parts: list[str]) -> list:
        out: list = [None] * len(parts)
        rest = []
        spaced, known, letters = self.spaced, self.known.get, self._letters
        match, lines, cut = self.WORD.fullmatch, self.LINES.fullmatch, self.PRETOKEN.findall
        for i, part in enumerate(parts):
            m = match(part)
            if m is None:
                if lines(part):  # white space is no token of the word vocabulary
                    found = cut(part) if spaced else [p for p in cut(part.lower()) if p != "\n"]
                    out[i] = tuple(x for p in found for x in known(p) or letters(p))
                else:
                    rest.append(i)
                continue
            space, word, stop = m.groups()
            word = space + word if spaced else word.lower()
            ids = known(word) or letters(word)
            out[i] = ids + (known(stop) or letters(stop)) if stop else ids
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    stays = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in stays}
    table.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in table)})
    return table
