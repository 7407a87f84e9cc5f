"""Byte-level BPE encoding and decoding with a transducer of frequent words.

A text is cut at single spaces and line feeds, where its tokens always end, into pieces. Pieces
counted over the whole corpus give the lexicon: the most frequent ones, with their token ids, are
compiled into a minimal transducer. Encoding looks pieces up in it; unseen ones are split by the
tokenizer's pattern and merged exactly, all new pieces of a batch together in numpy. The size of
the lexicon changes the speed only, never an id.

Defined results: a null text is empty and has no ids. Strings of special tokens in a text become
their ids, as in the tokenizers library. Further columns are left out but for the id, which is
passed on as it is, null or repeated too.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.lexicon import MAX_BYTES, Lexicon, compile_words
from reviewgraph.llm.store import stored

# Fixed value: the pattern of byte-level pre-tokenisation.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# How many of the corpus's most frequent pieces are compiled.
LEXICON_WORDS = 65_536
# Bounds of memory: pieces counted or remembered by one worker, and bytes encoded together.
COUNTED_PIECES = 250_000
KNOWN_PIECES = 400_000
SLICE_BYTES = 1_000_000
NEW_PIECES = 32_768
SLICE_TOKENS = 500_000

_DENSE_SPACE = re.compile(r"\s\s")


def byte_symbols() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, special strings and a hash table of merges, read from a tokenizer's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        symbols = byte_symbols()
        ids = told["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.token_bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.array([ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])],
                                np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.slot_keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_ranks = np.zeros(len(self.slot_keys), np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.slot_keys[slot] not in (-1, key):
                slot = (slot + 1) % len(self.slot_keys)
            if self.slot_keys[slot] == -1:
                self.slot_keys[slot], self.slot_ranks[slot] = key, rank
        self.no_rank = len(keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(
            np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair in the merges; no_rank for others."""
        out = np.full(len(keys), self.no_rank, np.int64)
        at, slots = np.arange(len(keys)), self._slots(keys)
        while len(at):
            found = self.slot_keys[slots]
            hit = found == keys[at]
            out[at[hit]] = self.slot_ranks[slots[hit]]
            on = ~hit & (found != -1)
            at, slots = at[on], (slots[on] + 1) % len(self.slot_keys)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has.

        The lowest-ranked pair of a word is merged wherever it stands, and so on.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_words = [], []
        # The rank of each pair with the next symbol, kept up as symbols merge.
        rank = np.full(len(ids), self.no_rank, np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair] = self.ranks(ids[pair] << 32 | ids[pair + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(ids))))
            going = best < self.no_rank
            if not going.all():
                done_ids.append(ids[~going])
                done_words.append(word[~going])
                ids, word, rank, best = ids[going], word[going], rank[going], best[going]
                if not len(ids):
                    break
            chosen = rank == best
            start = chosen & ~np.append(False, chosen[:-1])
            if start.sum() < chosen.sum():  # of overlapping pairs, as in "aaa", every other one
                place = np.arange(len(ids))
                run = np.maximum.accumulate(np.where(start, place, 0))
                chosen &= (place - run) % 2 == 0
            ids[chosen] = self.merged[rank[chosen]]
            stays = np.append(True, ~chosen[:-1])
            ids, word, rank, chosen = ids[stays], word[stays], rank[stays], chosen[stays]
            near = np.flatnonzero(chosen | np.append(chosen[1:], False))
            rank[near] = self.no_rank
            near = near[near < len(ids) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.ranks(ids[near] << 32 | ids[near + 1])
        flat = np.concatenate([*done_ids, np.empty(0, np.int64)])
        owner = np.concatenate([*done_words, np.empty(0, np.int64)])
        return (flat[np.argsort(owner, kind="stable")],
                np.bincount(owner, minlength=len(words)))


def pieces(text: str, pattern: regex.Pattern) -> list[str]:
    """Parts that can be encoded one by one; single spaces go with the word that follows."""
    if not text:
        return []
    if "\0" in text or text[0].isspace() or text[-1].isspace() or _DENSE_SPACE.search(text):
        return pattern.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, run after run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a larger one that begins with it."""
    if n <= len(x):
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[:len(x)] = x
    return out


class Encoder:
    """Encodes texts; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, block: bytes) -> None:
        self.vocabulary, self.lexicon = vocabulary, Lexicon(block)
        self.pattern = regex.compile(PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(
            vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens stay known."""
        ids = list(self.vocabulary.special.values())
        self.known: dict[str | int, int] = {x: i for i, x in enumerate(ids)}
        self.ids = np.array(ids, np.int32)
        self.sizes = np.ones(len(ids), np.int32)
        self.starts = np.arange(len(ids), dtype=np.int32)
        self.n_ids = self.n_known = len(ids)

    def _merged(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces outside the lexicon, and how many each has."""
        tokens: dict[str, int] = {}
        place, counts = [], []
        for piece in new:
            own = self.pattern.findall(piece)
            counts.append(len(own))
            for t in own:
                place.append(tokens.setdefault(t, len(tokens)))
        flat, sizes = self.vocabulary.merge(
            [t.encode("utf-8", "surrogatepass") for t in tokens])
        starts = np.cumsum(sizes) - sizes
        at = np.array(place, np.int64)
        owner = np.repeat(np.arange(len(new)), counts)
        return (flat[_spread(starts[at], sizes[at])],
                np.bincount(owner, sizes[at], minlength=len(new)).astype(np.int64))

    def learn(self, new: list[str]) -> None:
        """Takes in unseen pieces: from the lexicon, or merged."""
        lexicon = self.lexicon
        ranks = lexicon.ranks([x.encode("utf-8", "surrogatepass") for x in new])
        found, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        flat, merged_sizes = self._merged([new[i] for i in unseen.tolist()])
        own = ranks[found]
        sizes = np.zeros(len(new), np.int64)
        sizes[found] = lexicon.starts[own + 1] - lexicon.starts[own]
        sizes[unseen] = merged_sizes
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(sizes.sum(), np.int32)
        ids[_spread(starts[found], sizes[found])] = lexicon.ids[
            _spread(lexicon.starts[own], sizes[found])]
        ids[_spread(starts[unseen], merged_sizes)] = flat
        first, n = self.n_ids, self.n_known
        self.known.update(zip(new, range(n, n + len(new))))
        self.ids = _room(self.ids, first + len(ids))
        self.starts, self.sizes = (_room(x, n + len(new)) for x in (self.starts, self.sizes))
        self.ids[first:first + len(ids)] = ids
        self.starts[n:n + len(new)] = starts + first
        self.sizes[n:n + len(new)] = sizes
        self.n_ids, self.n_known = first + len(ids), n + len(new)

    def ids_of(self, piece: str) -> list[int]:
        slot = self.known[piece]
        return self.ids[self.starts[slot]:self.starts[slot] + self.sizes[slot]].tolist()

    def _cut(self, text: str) -> list[str | int]:
        """The pieces of a text; special tokens as their ids."""
        if not any(x in text for x in self.vocabulary.special):
            return pieces(text, self.pattern)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += pieces(text[at:m.start()], self.pattern)
            out.append(self.vocabulary.special[m.group()])
            at = m.end()
        return out + pieces(text[at:], self.pattern)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids start."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        cut = [self._cut(x) for x in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = list(chain.from_iterable(cut))
        slots = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = [flat[i] for i in np.flatnonzero(slots < 0).tolist()]
        if missed:
            new = list(dict.fromkeys(missed))
            for at in range(0, len(new), NEW_PIECES):
                self.learn(new[at:at + NEW_PIECES])
            slots[slots < 0] = list(map(self.known.__getitem__, missed))
        sizes = self.sizes[slots].astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        return (self.ids[_spread(self.starts[slots], sizes)],
                ends[np.append(0, np.cumsum(counts))])


class Decoder:
    """Turns ids into the bytes of their tokens."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The texts of the ids between starts; unsound UTF-8 is replaced."""
        sizes = self.sizes[ids]
        data = self.flat[_spread(self.starts[ids], sizes)]
        ends = np.append(0, np.cumsum(sizes))[starts].astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(starts) - 1,
                                    [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def frequent_pieces(docs: DataFrame, text_col: str = "text",
                    words: int = LEXICON_WORDS) -> DataFrame:
    """piece: the most frequent pieces of all texts, at most as many as the lexicon takes.

    Lossy counting: a worker passes on what it counted after every COUNTED_PIECES distinct pieces,
    without pieces seen once in that time. Pieces that tie with the first one left out stay out.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = regex.compile(PATTERN), Counter()

        def out() -> pa.RecordBatch:
            told = [(p, n) for p, n in seen.items() if n > 1]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in told], pa.string()),
                 pa.array([n for _, n in told], pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in _texts(batch.column(0)):
                seen.update(pieces(text, pattern))
                if len(seen) > COUNTED_PIECES:
                    yield out()
        yield out()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece string, n long")
    counts = stored(counts.groupBy("piece").agg(F.sum("n").alias("n"))
                    .where(F.length("piece").between(1, MAX_BYTES)))
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("pieces"))
    above = sizes.orderBy(F.desc("n")).limit(words + 1).collect()
    least, total = 0, 0
    for row in above:
        total += row["pieces"]
        if total > words:
            break
        least = row["n"]
    return counts.where(F.col("n") >= least if least else F.lit(False)).select("piece")


def compiled(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text",
             words: int = LEXICON_WORDS) -> bytes:
    """The transducer of a corpus's frequent pieces; one task compiles it, of at most ``words``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sorted(p for batch in batches for p in batch.column(0).to_pylist())
        encoder = Encoder(vocabulary.value, compile_words({}))
        for at in range(0, len(frequent), NEW_PIECES):
            encoder.learn(frequent[at:at + NEW_PIECES])
        block = compile_words({p.encode(): encoder.ids_of(p) for p in frequent})
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    frequent = frequent_pieces(docs, text_col, words)
    made = frequent.repartition(1).mapInArrow(run, "block binary").collect()
    return bytes(made[0]["block"]) if made else compile_words({})


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           words: int = LEXICON_WORDS) -> DataFrame:
    """id_col and ids, the token ids of each text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(tokenizer))
    block = spark.sparkContext.broadcast(compiled(docs, vocabulary, text_col, words))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, block.value)  # and its memory end with the task
        for batch in batches:
            texts = _texts(batch.column(1))
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                ids, starts = encoder.encode(texts[done:done + part.num_rows])
                done += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(
                        pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))],
                    names=[id_col, "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """id_col, ids and text: the bytes of the ids as UTF-8, unsound ones replaced."""
    spark = tokens.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(tokenizer).token_bytes)
    rows = tokens.select(F.col(id_col), F.col(ids_col).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            n = np.diff(batch.column(1).offsets.to_numpy()).tolist()
            for part in slices(batch, n, SLICE_TOKENS):
                lists = part.column(1)
                own = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0)))
                texts = decoder.decode(lists.flatten().to_numpy(), own)
                if lists.null_count:
                    texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts],
                                                 names=[id_col, "ids", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")
