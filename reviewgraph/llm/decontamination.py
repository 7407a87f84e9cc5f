"""Benchmark passages in documents, found by latent semantic retrieval and proved word by word.

Benchmark texts are cut into passages. Words are hashed features, weighted by their inverse
document frequency over the whole corpus. A randomised singular value decomposition of the TF-IDF
rows of the passages, whose products are summed over Spark's partitions, gives a latent space with
a vector for each feature. Documents are read in overlapping windows of the passages' lengths; a
window's latent vector is the sum over its words. Passages at a cosine over a threshold are
candidates, and so are those of whose own squared weight the window holds that share: rare words
around a passage of common ones do not hide it, and of the two windows that share a whole copy
one always holds half of it. Then the longest common subsequence of words decides: nearly all of a passage is a
leak, and a good part of it is a paraphrase if the answer is there too.

The benchmark is the query set, searched in blocks of bounded size against all rows; several
blocks share one scan. A block's space has as many directions as its passages need, so that the
cosine of a copy does not depend on how many passages there are.

Items of fewer than MIN_WORDS words are no passages for the space: they are searched as exact
sequences of words, with a share and a cosine of 1.

Defined results: null or empty texts match nothing.
Rows with equal ids are searched each, and one row comes back for an id and item: the best match.
A null document id or item id is kept as null. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.shingles import joined, word_hashes
from reviewgraph.llm.store import stored

BITS = 17
# Passages in one space, about, and spaces in one scan; a passage has at most PASSAGE_WORDS words.
BLOCK_ITEMS = 256
SCAN_BLOCKS = 4
PASSAGE_WORDS = 128
MIN_WORDS = 8
SMALLEST_WINDOW = 16
MIN_COSINE = 0.35
LEAK, PARAPHRASE = 0.8, 0.6
ANSWER_WORDS, ANSWER_SHARE = 8, 0.8
# Features in more documents than this share (and this number) carry no weight.
COMMON_SHARE, COMMON_DOCS = 0.05, 50
SLICE_BYTES = 1_000_000
SKETCH_ROWS = 4096


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            texts = _encoded(batch.column(0).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                words, of, _ = word_hashes(texts[done:done + part.num_rows])
                done += part.num_rows
                key = np.sort(of << BITS | _features(words))
                if len(key):
                    key = key[np.append(True, key[1:] != key[:-1])]
                counts += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
            n += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()),
             pa.array(np.append(counts[at], n), pa.int64())], names=["feature", "df"])

    told = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "feature long, df long")
            .groupBy("feature").agg(F.sum("df").alias("df")).toPandas())
    counts = np.zeros((1 << BITS) + 1, np.int64)  # the last place, -1, has the documents
    counts[told["feature"].to_numpy(np.int64)] = told["df"].to_numpy(np.int64)
    return counts[:-1], int(counts[-1])


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    """Weights of features; none for the most common ones."""
    weight = np.log((n + 1) / (counts + 1)) + 0.01
    weight[(counts > COMMON_DOCS) & (counts > COMMON_SHARE * n)] = 0
    return weight.astype(np.float32)


PASSAGES = "item_id long, part int, words array<long>, answer array<long>"


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
             answer_col: str | None = None) -> DataFrame:
    """The passages of benchmark items as word hashes, and the words of the answer.

    Without a column of answers, a passage's last words stand for it.
    """
    bounded_batches(items.sparkSession)
    answer = F.lit(None).cast("string") if answer_col is None else F.col(answer_col)
    rows = items.select(F.col(id_col).cast("long").alias("item_id"),
                        F.col(text_col).alias("text"), answer.alias("answer"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text, answer in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = word_hashes(_encoded([text]))[0].view(np.int64)
                told = word_hashes(_encoded([answer]))[0].view(np.int64)
                n = max(1, -(-len(words) // PASSAGE_WORDS))
                for k, own in enumerate(np.array_split(words, n)):
                    if len(own):
                        out.append({"item_id": item, "part": k, "words": own,
                                    "answer": told if len(told) else own[-ANSWER_WORDS:]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("item_id", pa.int64()), ("part", pa.int32()), ("words", pa.list_(pa.int64())),
                ("answer", pa.list_(pa.int64()))]))

    return rows.mapInArrow(run, PASSAGES)


def _rows(lists: list[list[int]], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of normalised TF-IDF rows."""
    sizes = [len(x) for x in lists]
    words = np.concatenate([np.array(x, np.int64) for x in lists]).view(np.uint64)
    feature, row = _features(words), np.repeat(np.arange(len(lists)), sizes)
    value = weight[feature].astype(np.float64)
    norm = np.sqrt(np.bincount(row, value ** 2, minlength=len(lists)))
    return row, feature, value / np.maximum(norm, 1e-12)[row]


def _norm(words: np.ndarray, weight: np.ndarray) -> float:
    """The length of a passage's vector of weights."""
    feature, counts = np.unique(_features(words.view(np.uint64)), return_counts=True)
    return float(np.linalg.norm(weight[feature] * counts))


def gram_product(found: DataFrame, weight: np.ndarray, right: np.ndarray,
                 used: np.ndarray) -> np.ndarray:
    """A'(A right) of the passages' TF-IDF rows A, over the used features, summed over partitions.

    The matrix has a fixed number of columns and at most one row for each feature.
    """
    shared = found.sparkSession.sparkContext.broadcast((weight, right, used))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, right, used = shared.value
        total = np.zeros_like(right)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, feature, value = _rows(batch.column(0).to_pylist(), weight)
            at = np.searchsorted(used, feature)
            left = np.zeros((batch.num_rows, right.shape[1]))
            np.add.at(left, row, value[:, None] * right[at])
            np.add.at(total, at, value[:, None] * left[row])
        blocks = range(0, len(total), SKETCH_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // SKETCH_ROWS for b in blocks], pa.int32()),
             pa.array([total[b:b + SKETCH_ROWS].tobytes() for b in blocks], pa.binary())],
            names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("part").to_pylist())
        return pa.table({"block": table.column("block")[:1], "part": [total.tobytes()]})

    parts = (found.select("words").mapInArrow(run, "block int, part binary")
             .groupBy("block").applyInArrow(add, "block int, part binary").collect())
    parts.sort(key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["part"]) for r in parts]).reshape(right.shape)


@dataclass
class Space:
    """A block of passages in the latent space."""

    weight: np.ndarray
    place: np.ndarray  # of each feature in vectors, -1 for features of no passage
    vectors: np.ndarray
    items: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    latent: np.ndarray  # one unit vector for each passage
    window: np.ndarray  # the window length of each passage
    norm: np.ndarray  # the length of each passage's weights


def short_items(found: DataFrame) -> dict[int, dict[int, list[int | None]]]:
    """Items of fewer than MIN_WORDS words: number of words, hash of all of them, item ids."""
    out: dict[int, dict[int, list[int | None]]] = {}
    for r in found.orderBy("item_id").collect():
        words = np.array(r["words"], np.int64).view(np.uint64)
        key = int(joined(words, len(words))[0])
        out.setdefault(len(words), {}).setdefault(key, []).append(r["item_id"])
    return out


def search_short(short: dict[int, dict[int, list[int | None]]], words: np.ndarray,
                 of: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
    """Text, item and first word of each short item in each text."""
    begins = np.searchsorted(of, np.arange(of[-1] + 2)) if len(of) else of
    for size, items in short.items():
        if len(words) < size:
            continue
        runs = joined(words, size)
        at = np.flatnonzero((of[:len(runs)] == of[size - 1:])
                            & np.isin(runs, np.array(list(items), np.uint64)))
        seen = set()
        for k in at.tolist():
            text, key = int(of[k]), int(runs[k])
            if (text, key) not in seen:
                seen.add((text, key))
                for item in items[key]:
                    yield text, item, k - int(begins[text])


def latent_space(found: DataFrame, weight: np.ndarray, seed: int = 11) -> Space | None:
    """Randomised SVD of the passages: a range finder with power steps, then the small problem."""
    rows = found.orderBy("item_id", "part").collect()
    if not rows:
        return None
    weight = weight.copy()
    words = [np.array(r["words"], np.int64) for r in rows]
    for own in words:  # passages of common words alone are searched by these words
        feature = _features(own.view(np.uint64))
        if (weight[feature] > 0).sum() < MIN_WORDS // 2:
            weight[feature] = np.maximum(weight[feature], 0.5)
    row, feature, value = _rows([x.tolist() for x in words], weight)
    used = np.unique(feature)
    # Equal passages need one direction together.
    k = min(len(used), len({own.tobytes() for own in words}))
    basis = np.random.default_rng(seed).normal(size=(len(used), k))
    for _ in range(2):
        basis, _ = np.linalg.qr(gram_product(found, weight, basis, used))
    product = gram_product(found, weight, basis, used)
    _, turn = np.linalg.eigh(basis.T @ product)
    vectors = basis @ turn[:, ::-1]
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    latent = np.zeros((len(rows), k))
    np.add.at(latent, row, value[:, None] * vectors[place[feature]])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    window = np.array([max(SMALLEST_WINDOW, 1 << (len(x) - 1).bit_length()) for x in words])
    return Space(weight, place, vectors.astype(np.float32), [r["item_id"] for r in rows], words,
                 [np.array(r["answer"], np.int64) for r in rows], latent.astype(np.float32),
                 window, np.array([_norm(x, weight) for x in words], np.float32))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by bits of one whole number."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        mask = masks.get(x)
        if mask:
            met = row & mask
            row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _windows(space: Space, feature: np.ndarray, of: np.ndarray, place: np.ndarray,
             size: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, latent vector and length of windows that can reach the threshold.

    of and place are a word's text and its place there. A window is two blocks of half its size,
    or a text's last block; least is the length of the shortest passage's weights.
    """
    half = size // 2
    new = np.append(True, (of[1:] != of[:-1]) | (place[1:] // half != place[:-1] // half))
    first = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    text, start = of[first], place[first]
    n = len(first)
    joined = np.append(text[1:] == text[:-1], False)  # blocks that go on in the next one
    weight = space.weight[feature]
    vector = space.place[feature]
    hit = np.flatnonzero((vector >= 0) & (weight > 0))

    def paired(x: np.ndarray) -> np.ndarray:
        return x + np.where(joined, np.append(x[1:], 0), 0)

    power = paired(np.bincount(block, weight ** 2, minlength=n))
    own = paired(np.bincount(block[hit], weight[hit] ** 2, minlength=n))
    bound = (MIN_COSINE * 0.999) ** 2 * np.minimum(power, least ** 2)
    chosen = np.flatnonzero((own > 0) & (own >= bound))
    if not len(chosen):
        return chosen, chosen, np.empty((0, space.vectors.shape[1]), np.float32), power[chosen]
    needed = np.zeros(n + 1, bool)
    needed[chosen] = True
    needed[chosen[joined[chosen]] + 1] = True
    row = np.cumsum(needed) - 1
    hit = hit[needed[block[hit]]]
    at = row[block[hit]]
    sums = np.zeros((row[-1] + 1, space.vectors.shape[1]), np.float32)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    if len(at):
        sums[at[begin]] = np.add.reduceat(weight[hit, None] * space.vectors[vector[hit]], begin,
                                          axis=0)
    vectors = sums[row[chosen]]
    going = np.flatnonzero(joined[chosen])
    vectors[going] += sums[row[chosen[going] + 1]]
    return text[chosen], start[chosen], vectors, np.sqrt(power[chosen]).astype(np.float32)


def search_texts(space: Space, words: np.ndarray,
                 of: np.ndarray) -> dict[tuple[int, int], tuple[float, int, float]]:
    """For each (text, passage) found: its common share, first word and cosine.

    of is the text of each word, rising.
    """
    out: dict[tuple[int, int], tuple[float, int, float]] = {}
    if not len(words):
        return out
    feature, signed = _features(words), words.view(np.int64)
    begins = np.searchsorted(of, np.arange(of[-1] + 2))
    place = np.arange(len(of)) - begins[of]
    for size in np.unique(space.window).tolist():
        group = np.flatnonzero(space.window == size)
        norm = space.norm[group]
        texts, starts, vectors, length = _windows(space, feature, of, place, size, norm.min())
        for low in range(0, len(starts), 4096):
            product = vectors[low:low + 4096] @ space.latent[group].T
            own = length[low:low + 4096, None]
            cosine = product / own
            for w, g in zip(*np.nonzero(product >= MIN_COSINE * np.minimum(own, norm))):
                p, text, start = int(group[g]), int(texts[low + w]), int(starts[low + w])
                told = space.words[p]
                best = out.get((text, p), (0.0, 0, 0.0))
                if best[0] == 1:
                    continue
                begin = max(0, start - size // 2)
                stop = min(begins[text] + start + size + size // 2, begins[text + 1])
                region = signed[begins[text] + begin:stop]
                share = common_subsequence(told, region) / len(told)
                if share < LEAK:
                    answer = space.answers[p]
                    if share < PARAPHRASE or common_subsequence(
                            answer, region) < ANSWER_SHARE * len(answer):
                        continue
                out[text, p] = max(best, (share, begin, float(cosine[w, g])))
    return out


LEAKS = "item_id long, common_share double, first_word long, cosine double"


def _search(docs: DataFrame, spaces: list[Space], short: dict[int, dict[int, list[int | None]]],
            id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((spaces, short))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, short = shared.value
        for batch in batches:
            texts = _encoded(batch.column(1).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                words, of, _ = word_hashes(texts[done:done + part.num_rows])
                done += part.num_rows
                at, found = [], []
                for space in spaces:
                    for (i, p), hit in sorted(search_texts(space, words, of).items()):
                        at.append(i)
                        found.append((space.items[p], *hit))
                for i, item, first in search_short(short, words, of):
                    at.append(i)
                    found.append((item, 1.0, first, 1.0))
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())),
                     pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()),
                     pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())],
                    names=[id_col, "item_id", "common_share", "first_word", "cosine"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {LEAKS}")


def benchmark_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """id_col, item_id, common_share, first_word and cosine of each document with an item in it.

    common_share is the part of a passage's words found in order; first_word is where the region
    begins in the document.
    """
    told = stored(passages(items, item_col, item_text_col, answer_col))
    found = told.where(F.size("words") >= MIN_WORDS)
    short = short_items(told.where(F.size("words") < MIN_WORDS))
    counts, n = document_frequencies(docs, text_col)
    weight = idf(counts, n)
    blocks = -(-found.count() // BLOCK_ITEMS)
    hits = docs.select(F.col(id_col)).limit(0).selectExpr(
        f"`{id_col}`", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}"
                         for x in LEAKS.split(", ")])
    if short and not blocks:
        hits = hits.unionByName(_search(docs, [], short, id_col, text_col))
    for first in range(0, blocks, SCAN_BLOCKS):
        spaces = []
        for b in range(first, min(first + SCAN_BLOCKS, blocks)):
            of = F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(blocks))
            space = latent_space(found.where(of == b), weight)
            if space is not None:
                spaces.append(space)
        # Short items are searched in the first scan.
        if spaces or (short and not first):
            hits = hits.unionByName(_search(docs, spaces, {} if first else short, id_col, text_col))
    best = W.partitionBy(id_col, "item_id").orderBy(F.desc("common_share"), "first_word",
                                                    F.desc("cosine"))
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
