"""A run-length index of a text: its Burrows-Wheeler transform as runs, with samples at run ends.

Rows of the transform are the sorted suffixes. Where the transform changes from one run to the
next, the two neighbouring rows are sampled, with the length that their suffixes have in common.
Inside a run, a suffix and its neighbour both grow by the same character to the left: how far the
longest match of a position reaches cannot fall from one position to the next, and rises at
samples only. So the matching statistics of the whole text against itself stream from the samples
in the order of the text, as a running maximum.
"""

from __future__ import annotations

import numpy as np

# Fixed value: a byte that UTF-8 never has, after each piece of text.
SEPARATOR = 0xFF


def _packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number, zeros past the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k:k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sorted_suffixes(packed: np.ndarray) -> np.ndarray:
    """All suffixes in order: ranks by eight bytes, doubled for those that still tie."""
    n = len(packed)
    order = np.argsort(packed, kind="stable").astype(np.int32)
    start = np.append(True, packed[order[1:]] != packed[order[:-1]])
    places = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(start, places, 0))
    tied = ~(start & np.append(start[1:], True))
    active, length = places[tied], 8
    while len(active):
        at = order[active]
        on = at.astype(np.int64) + length
        then = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) << 32 | then
        turn = np.argsort(key, kind="stable")
        key, at = key[turn], at[turn]
        order[active] = at
        start = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(start, active, 0))
        active = active[~(start & np.append(start[1:], True))]
        length *= 2
    return order


def _common(packed: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common; 0 for less than least."""
    n = len(packed)
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    length = 0
    while len(going):
        x, y = a[going] + length, b[going] + length
        inside = (x < n) & (y < n)
        same = inside & (packed[np.minimum(x, n - 1)] == packed[np.minimum(y, n - 1)])
        ended = going[~same]
        if length + 8 > least and len(ended):
            x, y = a[ended] + length, b[ended] + length
            inside = (x < n) & (y < n)
            differ = np.where(inside, packed[np.minimum(x, n - 1)] ^ packed[np.minimum(y, n - 1)],
                              np.uint64(1 << 63))
            more = np.zeros(len(ended), np.int64)
            for k in range(1, 8):
                more += (differ >> np.uint64(64 - 8 * k)) == 0
            out[ended] = length + more
        going = going[same]
        length += 8
    return np.where(out >= least, out, 0)


def match_ends(data: np.ndarray, least: int) -> np.ndarray:
    """For each position, where the longest string that starts there and elsewhere ends.

    Matches shorter than least may be missed; without one, a position's own place.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    packed = _packed(data)
    order = sorted_suffixes(packed).astype(np.int64)
    before = np.where(order > 0, data[order - 1].astype(np.int16), -1)
    ends = np.flatnonzero(before[1:] != before[:-1])  # rows that end a run; the next begins one
    a, b = order[ends], order[ends + 1]
    length = _common(packed, a, b, least)
    told = length > 0
    a, b, length = a[told], b[told], length[told]
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, a, a + length)
    np.maximum.at(reach, b, b + length)
    return np.maximum(np.maximum.accumulate(reach), np.arange(n))


def repeated_windows(pieces: list[bytes], size: int) -> list[tuple[int, int, int]]:
    """(piece, start, end) of maximal runs of window starts whose windows start elsewhere too.

    end is the last start, included; windows lie inside pieces.
    """
    if not pieces:
        return []
    mark = bytes([SEPARATOR])
    data = np.frombuffer(mark.join(pieces) + mark, np.uint8)
    lengths = np.array([len(p) + 1 for p in pieces])
    stops = np.cumsum(lengths) - 1
    reach = np.minimum(match_ends(data, size), np.repeat(stops, lengths))
    hit = np.flatnonzero(reach - np.arange(len(data)) >= size)
    if not len(hit):
        return []
    first = np.append(True, hit[1:] != hit[:-1] + 1)
    starts, ends = hit[first], hit[np.append(first[1:], True)]
    of = np.searchsorted(stops, starts)
    begin = stops - lengths + 1
    return list(zip(of.tolist(), (starts - begin[of]).tolist(), (ends - begin[of]).tolist()))
