"""Merging shard Burrows-Wheeler transforms by interleave refinement.

A shard is a run of strings, each followed by END. It is sorted on its own and keeps,
in suffix order, the two symbols before each suffix (its transform, two at a time) and
the rank of the suffix two symbols earlier (the LF mapping). The merge never compares
suffixes: it holds an interleave of the shards' ranks that is sorted by the first h
symbols, and one stable sort by the preceding symbols makes it sorted by h + 2. Where
symbols or blocks differ, the common prefix of neighbours ends, which gives the
intervals of equal prefixes. A place whose prefix is unique can never share a longer one
and leaves the interleave; a place too near its string's start to grow to the full depth
never enters it.
"""

from __future__ import annotations

import numpy as np

#: Ends a string; no UTF-8 text holds this byte.
END = 0xFF
STEP = 2


class Shard:
    """Suffix order of ``text`` (bytes, cyclic) by its first ``depth`` symbols or more."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.text = text
        wide = text.astype(np.int64)
        rank = ((wide << 24) | (np.roll(wide, -1) << 16) | (np.roll(wide, -2) << 8) | np.roll(wide, -3))
        rank = np.unique(rank, return_inverse=True)[1]
        span = 4
        while span < depth and rank.max() + 1 < n:
            rank = np.unique(rank * n + np.roll(rank, -span), return_inverse=True)[1]
            span *= 2
        #: The suffix array, and each position's place in it.
        self.suffixes = np.argsort(rank, kind="stable")
        place = np.empty(n, np.int64)
        place[self.suffixes] = np.arange(n)
        before = (self.suffixes - STEP) % n
        self.mapping = place[before]
        self.transform = (text[before].astype(np.uint16) << 8) | text[(self.suffixes - 1) % n]
        lengths = np.diff(np.flatnonzero(text == END), prepend=-1)
        offset = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: Ranks of the suffixes that have ``depth`` symbols of their string before them.
        self.grown = np.flatnonzero(offset[self.suffixes] >= depth)


def repeated_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share their first ``depth`` symbols (even) with another, and their interval.

    A place is an index into the shards' suffix orders, one after the other.
    """
    if depth % STEP:
        raise ValueError(f"depth {depth} is no multiple of {STEP}")
    offsets = np.cumsum([0, *[len(s.text) for s in shards]])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"{offsets[-1]} places in one merge: take smaller groups")
    mapping = np.concatenate([s.mapping + o for s, o in zip(shards, offsets)]).astype(np.int32)
    symbols = np.concatenate([s.transform for s in shards])
    places = np.concatenate([s.grown + o for s, o in zip(shards, offsets)]).astype(np.int32)
    block = np.zeros(len(places), np.int32)
    for _ in range(0, depth, STEP):
        before = symbols[places]
        order = np.argsort(before, kind="stable").astype(np.int32)
        before, places, block = before[order], mapping[places[order]], block[order]
        # a block begins where symbols or blocks differ; one that the next begins at once is unique
        new = np.ones(len(places) + 1, bool)
        new[1:-1] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[:-1] & new[1:])
        places, block = places[shared], np.cumsum(new[:-1][shared], dtype=np.int32)
    return places.astype(np.int64), block


def shared_windows(strings: list[bytes], depth: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``string, offset, interval`` of all ``depth``-byte windows that occur more than once in ``strings``."""
    shards, pending, size, first = [], [], 0, [0]
    for k, s in enumerate(strings):
        pending.append(s)
        size += len(s) + 1
        if size >= shard_bytes or k == len(strings) - 1:
            text = np.frombuffer(b"\xff".join([*pending, b""]), np.uint8)
            shards.append(Shard(text, depth))
            first.append(first[-1] + size)
            pending, size = [], 0
    places, interval = repeated_intervals(shards, depth)
    at = np.concatenate([s.suffixes + o for s, o in zip(shards, first)])[places]
    starts = np.cumsum([0, *[len(s) + 1 for s in strings]])
    string = np.searchsorted(starts, at, side="right") - 1
    return string, at - starts[string], interval
