"""Word shingles of many texts at once, as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONGEST = 1 << 16

# Random values for the bytes of a word, A-Z like a-z.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
    + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLY, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the text it is in, and its first byte in that text.

    Words are runs of bytes outside ASCII white space, A-Z lower-cased if fold.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = ~space
    start = np.flatnonzero(inside & np.append(True, space[:-1]))
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.flatnonzero(space & np.append(False, inside[:-1]))
    sizes = end - start
    # Each byte's value times a power for its place in the word; the powers of very long words
    # begin anew, with other values.
    place = np.zeros(len(data), np.int64)
    place[start[0]:] = np.arange(start[0], len(data)) - np.repeat(
        start, np.append(start[1:], len(data)) - start)
    values = (_FOLDED if fold else _BYTES)[data]
    over = place >= _LONGEST
    if over.any():
        values[over] = mixed(values[over] + (place[over] // _LONGEST).astype(np.uint64))
        place %= _LONGEST
    powers = _powers(int(min(sizes.max(), _LONGEST)))
    terms = values * powers[np.minimum(place, len(powers) - 1)]
    terms[space] = 0
    hashes = mixed(np.add.reduceat(terms, start) + sizes.astype(np.uint64))
    begins = np.append(0, np.cumsum(lengths + 1))[:-1]
    of = np.searchsorted(begins, start, side="right") - 1
    return hashes, of, start - begins[of]


def joined(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of so many words."""
    h = words[:len(words) - size + 1].copy()
    for k in range(1, size):
        h = mixed(h * _MULTIPLY + np.uint64(k)) + words[k:len(words) - size + 1 + k]
    return mixed(h + np.uint64(size))


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than a shingle has one shingle, all of its words; without words none.
    """
    words, of, _ = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    runs = joined(words, size) if len(words) >= size else np.empty(0, np.uint64)
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= size:
            h = np.sort(runs[end - n:end - size + 1])
            yield h[np.append(True, h[1:] != h[:-1])]
        else:
            yield joined(words[end - n:end], n) if n else np.empty(0, np.uint64)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers for a set of hashes; equal for equal sets."""
    if not len(hashes):
        return 0, 0
    a = np.add.reduce(mixed(hashes + _MIX_A))
    b = np.add.reduce(mixed(hashes * _MIX_B + _MULTIPLY))
    pair = mixed(np.array([a, b], np.uint64) + np.uint64(len(hashes))).view(np.int64)
    return int(pair[0]), int(pair[1])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
