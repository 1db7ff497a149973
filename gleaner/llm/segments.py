"""Windows of a text, dealt out by their minimizers.

Every window of ``length`` bytes has a minimizer: of its runs of MER bytes the one with
the least hash, the leftmost if equal. Equal windows have equal minimizers, so windows
can only be equal within one minimizer value. Neighbouring windows with the same
minimizer make one segment: the bytes from the first window's start to the last one's
end, at most ``2 * length - MER``.
"""

from __future__ import annotations

import numpy as np

MER = 32
#: Bits of a position within one call; the others order the minimizers.
POSITION_BITS = 27
C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mer_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the MER bytes from every position."""
    n = len(data) - MER + 1
    words = np.ndarray((n + MER - 8,), np.dtype("<u8"), data, 0, (1,))
    h = words[:n] * C[0]
    for k in range(1, MER // 8):
        h = _mix(h)
        h += words[8 * k : 8 * k + n] * C[k]
    return _mix(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Segments of the pieces ``data[starts[i]:ends[i]]``, which follow each other.

    Returns the hash of each segment's minimizer, its first window's start and its number
    of windows, in order. Windows that cross pieces are left out.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) > 1 << POSITION_BITS:
        raise ValueError(f"{len(data)} bytes in one call, {1 << POSITION_BITS} at most: take smaller buffers")
    h = mer_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    chosen = (sliding_least(ranked, length - MER + 1) & low).astype(np.int64)
    n = len(chosen)
    valid = np.zeros(n + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, np.minimum(ends[whole] - length + 1, n), -1)
    valid = np.cumsum(valid[:n]) > 0
    new = np.r_[True, chosen[1:] != chosen[:-1]]
    new[starts[whole]] = True
    at = np.flatnonzero(valid)
    first = at[new[at] | np.r_[True, ~valid[:-1]][at]]
    # a segment ends before the next one, or where its piece has no further window
    run = np.cumsum(np.r_[0, valid])
    last = np.r_[first[1:], n]
    # minima crowd near zero: mixed once more, they spread over all hash ranges
    return _mix(h[chosen[first]]), first, run[last] - run[first]
