"""Run-length index of many strings: a run-compressed Burrows-Wheeler transform with samples
at both ends of each run, and matching statistics streamed from the samples."""

from __future__ import annotations

import numpy as np

#: Characters that the first sorting key holds: nine bits each, 0 past a string's end.
FIRST = 7


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes; a suffix stops at its string's end, ties go by position.

    ``ends[i]``: where the string of position i ends. Prefix doubling; positions whose rank
    is settled leave the sort.
    """
    n = len(text)
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    for k in range(FIRST):
        key = key << np.uint64(9) | np.where(place + k < ends, padded[k: k + n] + np.uint64(1), np.uint64(0))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    span, longest = FIRST, int((ends - place).max(initial=0))
    while span < longest:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied)  # ranks whose order is open
        if not len(slots):
            break
        at = order[slots]
        later = at + span
        second = np.where(later < ends[at], rank[np.minimum(later, n - 1)] + 1, 0)
        keys = rank[at].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        inner = np.argsort(keys, kind="stable")
        at, keys = at[inner], keys[inner]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = keys[1:] != keys[:-1]
        fresh[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        span *= 2
    return order


def common_prefix(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, each within its string."""
    room = np.minimum(ends[a] - a, ends[b] - b)
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    while len(live):
        x = eight[a[live] + out[live]].copy().view("<u8").ravel() ^ eight[b[live] + out[live]].copy().view("<u8").ravel()
        low = x & (~x + np.uint64(1))  # lowest differing bit
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live] += same
        live = live[(same == 8) & (out[live] < room[live])]
    return np.minimum(out, room)


class RunIndex:
    """Runs of the transform of some strings, and samples at the first and last place of each.

    ``heads`` and ``tails``: text positions of run ends. ``head_lcp``: common prefix of a run's
    first suffix with the one before it in suffix order; ``tail_lcp``: of its last one with
    the one after it. A string's first character stands for a run of its own, as its end mark does.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.stops = np.cumsum(sizes)
        n = len(self.text)
        ends = np.repeat(self.stops, sizes)
        order = suffix_order(self.text, ends)
        before = np.full(n, -1, np.int64)  # the transform: the character in front of each suffix
        before[1:] = self.text[:-1]
        begins = (self.stops - sizes)[sizes > 0]
        before[begins] = -1 - np.arange(len(begins))
        last = before[order]
        breaks = np.flatnonzero(last[1:] != last[:-1]) + 1 if n else np.zeros(0, np.int64)
        starts = np.concatenate([[0], breaks]) if n else breaks
        finals = np.concatenate([breaks, [n]]) - 1 if n else breaks
        self.characters, self.lengths = last[starts], finals - starts + 1
        self.heads, self.tails = order[starts], order[finals]
        self.head_lcp, self.tail_lcp = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(starts) > 1:
            # Neighbouring runs share one comparison: a run's tail and the next run's head.
            shared = common_prefix(self.text, ends, self.tails[:-1], self.heads[1:])
            self.head_lcp[1:], self.tail_lcp[:-1] = shared, shared

    def matching_statistics(self) -> np.ndarray:
        """Per text position, the longest match of its suffix that starts at any other position.

        Inside a run, moving one character on shortens the match by one, so each position
        follows from the nearest sample at or before it in the text.
        """
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for samples, lengths in ((self.heads, self.head_lcp), (self.tails, self.tail_lcp)):
            known = np.full(n, -1, np.int64)
            known[samples] = samples
            value = np.zeros(n, np.int64)
            value[samples] = lengths
            source = np.maximum.accumulate(known)
            best = np.maximum(best, value[source] - (np.arange(n) - source))
        return best
