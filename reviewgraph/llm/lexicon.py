"""A minimal acyclic transducer: a word list with shared suffixes, whose output is a word's rank.

Words are sorted byte strings. Each arc carries how many accepted words sort before those that go
through it; the sum along a word's path is its rank, under which a table lists its token ids. The
arrays lie one after another in one block of integers, which a worker maps into memory.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

# Words longer than this are not compiled; they are merged like other unseen words.
MAX_BYTES = 64


def _minimal_states(words: list[bytes]) -> tuple[list, list[bool]]:
    """Arcs (byte, target) and finality of the smallest automaton's states, for sorted words.

    States of the last word have their arcs in a dictionary, settled ones in a tuple; states that
    turned out like others have none.
    """
    arcs: list = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states of the last word, root first

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state, parent = path.pop(), path[-1]
            own = tuple(arcs[state].items())
            same = known.setdefault((final[state], own), state)
            arcs[state] = own if same == state else None
            if same != state:
                byte = next(reversed(arcs[parent]))
                arcs[parent][byte] = same

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        for byte in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    arcs[0] = tuple(arcs[0].items())
    return arcs, final


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of these words as one block of 64-bit integers."""
    words = sorted(w for w in entries if 0 < len(w) <= MAX_BYTES)
    arcs, final = _minimal_states(words)
    order, seen = [], {0: 0}
    todo = [0]
    while todo:  # number the states that are left
        state = todo.pop()
        order.append(state)
        for _, target in arcs[state]:
            if target not in seen:
                seen[target] = len(seen)
                todo.append(target)
    counts: dict[int, int] = {}

    def count(root: int) -> None:
        stack = [root]
        while stack:
            s = stack[-1]
            open_ = [t for _, t in arcs[s] if t not in counts]
            if open_:
                stack.extend(open_)
            else:
                counts[s] = final[s] + sum(counts[t] for _, t in arcs[s])
                stack.pop()

    count(0)
    rows = []
    for state in order:
        before = int(final[state])
        for byte, target in arcs[state]:
            rows.append((seen[state] * 256 + byte, seen[target], before))
            before += counts[target]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    ends = np.zeros(len(seen), np.int64)
    for state, number in seen.items():
        ends[number] = final[state]
    ids = [entries[w] for w in words]
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    flat = np.array([t for x in ids for t in x], np.int64)
    head = np.array([len(table), len(ends), len(starts), len(flat)], np.int64)
    return np.concatenate([head, table.T.ravel(), ends, starts, flat]).tobytes()


class Lexicon:
    """A compiled transducer, mapped from a file that has no name any more."""

    def __init__(self, block: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, prot=mmap.PROT_READ), np.int64)
        n_arcs, n_states, n_starts, n_ids = data[:4]
        parts = np.split(data[4:], np.cumsum([n_arcs] * 3 + [n_states, n_starts]))
        self.keys, self.targets, self.before, self.final, self.starts, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words outside; all words walk on together."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = np.flatnonzero((lengths > 0) & (lengths <= MAX_BYTES)) if len(self.keys) else []
        if not len(at):
            return out
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        first = np.cumsum(lengths) - lengths
        state = np.zeros(len(at), np.int64)
        total = np.zeros(len(at), np.int64)
        for step in range(MAX_BYTES + 1):
            ended = lengths[at] == step
            accepted = ended & (self.final[state] == 1)
            out[at[accepted]] = total[accepted]
            at, state, total = at[~ended], state[~ended], total[~ended]
            if not len(at):
                break
            key = state * 256 + text[first[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            at, arc = at[there], arc[there]
            state, total = self.targets[arc], total[there] + self.before[arc]
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.starts[rank]:self.starts[rank + 1]]
