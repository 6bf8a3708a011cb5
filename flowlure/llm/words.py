"""Words of Arrow text batches and what is known of them in a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from flowlure.llm.parts import REMEMBERED, split_parts

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a large_string array and where each begins, with a closing end."""
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code per word, first word per text with a closing end, distinct words)."""
    raw, ends = text_bytes(texts)
    spaced = np.where(SEPARATORS[raw], np.uint8(0x20), raw)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(spaced.tobytes()))
    codes, offsets, parts = split_parts(plain)
    if "" not in parts:
        return codes, offsets, parts
    real = codes != parts.index("")
    return codes[real], np.concatenate([[0], np.cumsum(real)])[offsets], parts


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows of numbers too) between neighbouring offsets."""
    ends = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype if values.dtype != bool else np.int64), np.cumsum(values, axis=0)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


class VectorMemory:
    """A row of numbers per word met by this worker; beyond the limit only words seen again stay."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = REMEMBERED):
        self.compute, self.limit, self.slot, self.rows = compute, limit, {}, np.zeros((0, width))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > self.limit:
            again = [w for w in words if w in self.slot]
            self.rows = self.rows[[self.slot[w] for w in again]]
            self.slot = dict(zip(again, range(len(again))))
        new = [w for w in words if w not in self.slot]
        if new:
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new))))
            self.rows = np.concatenate([self.rows, self.compute(new)])
        return self.rows[np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))]
