"""Banded bit-parallel edit distance of many string pairs at once.

Column by column, the differences between vertical neighbours of the dynamic programming
matrix are kept as bits of one word per pair, for the 2 * limit + 1 rows around the
diagonal only (Myers' recurrences in Hyyro's banded form). numpy runs the same column of
all pairs together.
"""

from __future__ import annotations

import numpy as np

#: Characters of padded matrices per batch of pairs.
BATCH_CHARS = 1_000_000


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.full((len(strings), width), -1, np.int32)
    for row, s in zip(out, strings):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _batch(a: list[str], b: list[str], limit: int) -> np.ndarray:
    m, n = (np.array([len(s) for s in x]) for x in (a, b))
    band = 2 * limit + 1
    all_rows = np.uint64((1 << band) - 1)
    one, zero = np.uint64(1), np.uint64(0)
    # rows before the first and after the last match nothing
    left = np.full((len(a), limit), -2, np.int32)
    pattern = np.hstack([left, _codes(a, int(max(m.max(), n.max())) + limit + 1)]).T.copy()
    text = _codes(b, int(n.max())).T.copy()
    vp = np.full(len(a), (((1 << band) - 1) >> limit) << limit, np.uint64)
    vn = np.zeros(len(a), np.uint64)
    score = np.full(len(a), limit, np.int64)
    for j in range(1, int(n.max()) + 1):
        match = np.zeros(len(a), np.uint64)
        char = text[j - 1]
        for k in range(band):
            match |= (pattern[j - 1 + k] == char).astype(np.uint64) << np.uint64(k)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & all_rows
        hp = (vn | ~(d0 | vp)) & all_rows
        hn = d0 & vp
        down = j + limit <= m
        row = np.clip(m - j + limit, 0, band - 1).astype(np.uint64)
        diagonal = ((d0 >> np.uint64(band - 1)) & one) == zero
        across = ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64)
        score += np.where(j <= n, np.where(down, diagonal, across), 0)
        vp = (hn | ~((d0 >> one) | hp)) & all_rows
        vn = (d0 >> one) & hp
    return np.where(np.abs(m - n) <= limit, np.minimum(score, limit + 1), limit + 1)


def within(a: list[str], b: list[str], limit: int) -> np.ndarray:
    """Edit distances of the pairs, ``limit + 1`` standing for anything greater.

    Strings have at least ``limit`` characters; ``limit`` is at most 31.
    """
    out = np.empty(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda k: len(b[k]))
    at = 0
    while at < len(order):
        to, width = at, 0
        while to < len(order) and (to == at or (to - at + 1) * max(width, len(b[order[to]])) <= BATCH_CHARS):
            width = max(width, len(b[order[to]]))
            to += 1
        rows = order[at:to]
        out[rows] = _batch([a[k] for k in rows], [b[k] for k in rows], limit)
        at = to
    return out
