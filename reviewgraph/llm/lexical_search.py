"""Ranked lexical search in an index of strata: documents with one normaliser lie together.

All documents of a stratum have the same normaliser m, so that a term's impact there depends on
its occurrences tf alone and is computed once for each tf. Postings of a stratum are ordered by
term and falling tf; the first of a term gives the largest impact it has in the stratum. The sum of
these over an item's terms bounds every score in the stratum. Strata are visited by falling bound
and left out once an item's k-th score is above it. A first pass over the index looks into the best
stratum of each part for every item, which gives the floors that the second, exact pass starts with.

Strata with many postings are cut into slices by a hash of the document; every slice is a row of
the index, every task holds a bounded number of them. An index can be made for the terms of given
items only; where these are too many to hand to every task, all terms are indexed.

Defined results: null or empty texts, and those without a term, are in no stratum and count for
nothing. Rows without an id are left out; of documents with one id, the text sorted last counts;
items with one id are one item. An item without terms, or without documents that hold any, has no
rows. Equal scores are ranked by ascending id. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches
from reviewgraph.llm.store import one_text_per_id, stored

# Bytes that stand between terms; all bytes beyond ASCII belong to terms.
_BETWEEN = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
# Bounds of memory: postings of an index row, postings held by a search task, products summed
# at once, terms of items that are searched together, bytes of terms and number of large strata
# handed to every task.
SLICE_POSTINGS = 65_536
HELD_POSTINGS = 2_000_000
SUMMED = 1_000_000
BLOCK_TERMS = 200_000
VOCABULARY_BYTES = 8_000_000
LARGE_STRATA = 100_000


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for b in _BETWEEN:
        table[b] = 0x20
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return bytes(table)


def _terms(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split(b" ")


@dataclass
class Index:
    """strata (m, slice, docs, terms, starts, places, tfs), df of terms, documents and terms."""

    strata: DataFrame
    df: DataFrame
    n_docs: int
    n_terms: int


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and term, each pair once."""
    bounded_batches(items.sparkSession)
    table = _byte_table()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [sorted({*_terms(x or b"", table)} - {b""}) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, f in enumerate(found) for _ in f],
                                               pa.int64())),
                 pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())],
                names=["item_id", "term"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), text_col)
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


def _forward(docs: DataFrame, asked: set[bytes] | None) -> DataFrame:
    """doc_id, n (all its terms), terms and tfs of those asked for."""
    table = _byte_table()
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                counts = Counter(_terms(text or b"", table))
                counts.pop(b"", None)
                n.append(counts.total())
                own = counts if asked is None else [t for t in counts if t in asked]
                terms.extend(own)
                tfs.extend(counts[t] for t in own)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<int>")


def _stratum(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of the index: the postings of a slice, by term, falling tf and document."""
    rows = rows.sort_by("doc_id").combine_chunks()
    docs, terms = rows["doc_id"], rows["terms"].combine_chunks()
    counts = np.diff(terms.offsets.to_numpy())
    coded = terms.flatten().dictionary_encode()
    order = np.argsort(np.array(coded.dictionary.cast(pa.binary()).to_pylist(), object))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    tfs = rows["tfs"].combine_chunks().flatten().to_numpy()
    places = np.repeat(np.arange(len(counts)), counts)
    sorted_ = np.lexsort((places, -tfs, codes))
    starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(order))))
    return pa.table({
        "m": pa.array([key[0].as_py()], pa.int64()), "slice": pa.array([key[1].as_py()], pa.int64()),
        "docs": pa.array([docs.to_numpy()], pa.list_(pa.int64())),
        "terms": pa.array([coded.dictionary.take(pa.array(order)).to_pylist()],
                          pa.list_(pa.string())),
        "starts": pa.array([starts], pa.list_(pa.int32())),
        "places": pa.array([places[sorted_]], pa.list_(pa.int32())),
        "tfs": pa.array([tfs[sorted_]], pa.list_(pa.int32()))})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                asked: DataFrame | None = None) -> Index:
    """The index of all documents, for all terms or for those asked for (term)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = None
    if asked is not None:
        terms = asked.select("term").distinct()
        size = terms.agg(F.sum(F.octet_length("term") + 50)).first()[0] or 0
        if size <= VOCABULARY_BYTES:
            known = {r["term"].encode() for r in terms.collect()}
    forward = stored(_forward(one_text_per_id(docs, id_col, text_col), known))
    n_docs, n_terms = forward.where(F.col("n") > 0).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = stored(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")))
    m = F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    held = forward.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"))
    # Only strata that need more than one slice are looked up: where they are few, by every task,
    # so that a stratum of very many documents is never dealt to one.
    large = stored(held.groupBy("m").agg(F.sum(F.size("terms").cast("long")).alias("postings"))
                   .withColumn("slices", F.ceil(F.col("postings") / SLICE_POSTINGS))
                   .where(F.col("slices") > 1).select("m", "slices"))
    if large.count() <= LARGE_STRATA:
        large = F.broadcast(large)
    cut = held.join(large, "m", "left").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1).cast("long"))))
    strata = cut.drop("slices").groupBy("m", "slice").applyInArrow(
        _stratum, "m long, slice long, docs array<long>, terms array<string>,"
                  " starts array<int>, places array<int>, tfs array<int>")
    return Index(stored(strata), df, n_docs, n_terms)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Items:
    """Items that are searched together: for each term, which items hold it and its weight."""

    def __init__(self, rows: list[Row], n_docs: int) -> None:
        self.ids = [r["item_id"] for r in rows]
        pairs = sorted((t["term"], i, weight(t["df"], n_docs))
                       for i, r in enumerate(rows) for t in r["terms"])
        self.places: dict[str, int] = {}
        starts = []
        for at, (term, _, _) in enumerate(pairs):
            if term not in self.places:
                self.places[term] = len(starts)
                starts.append(at)
        self.starts = np.array([*starts, len(pairs)], np.int64)
        self.items = np.array([p[1] for p in pairs], np.int64)
        self.weights = np.array([p[2] for p in pairs], np.int64)


class _Stratum:
    """An index row beside the items searched: who asks for which postings."""

    def __init__(self, row: dict, items: _Items) -> None:
        self.docs, self.places = np.asarray(row["docs"]), np.asarray(row["places"])
        tfs, starts = np.asarray(row["tfs"], np.int64), np.asarray(row["starts"], np.int64)
        known, which = np.unique(tfs, return_inverse=True)
        self.impacts = (1_000_000_000 * known // (1000 * known + 20 * row["m"]))[which]
        term = np.fromiter((items.places.get(t, -1) for t in row["terms"]), np.int64,
                           len(row["terms"]))
        own = np.flatnonzero(term >= 0)
        asking = items.starts[term[own] + 1] - items.starts[term[own]]
        pair = _spread(items.starts[term[own]], asking)
        order = np.argsort(items.items[pair], kind="stable")
        self.item, self.weight = items.items[pair][order], items.weights[pair][order]
        at = np.repeat(own, asking)[order]
        self.first, self.count = starts[at], starts[at + 1] - starts[at]
        self.bounds = np.zeros(len(items.ids), np.int64)
        np.add.at(self.bounds, self.item, self.weight * self.impacts[self.first])

    def scores(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and their scores of all documents, for a part of the wanted items at a time."""
        chosen = np.flatnonzero(wanted[self.item])
        work = np.cumsum(self.count[chosen] + 1)
        while len(chosen):
            # Whole items, as many as the bound takes, one at least.
            n = np.searchsorted(work, SUMMED, "right")
            items = self.item[chosen]
            if n < len(chosen):
                n = np.searchsorted(items, items[n])
                n = n or np.searchsorted(items, items[0], "right")
            most = max(1, SUMMED // len(self.docs))
            own, row = np.unique(items[:n], return_inverse=True)
            if len(own) > most:
                n, own = np.searchsorted(items, own[most]), own[:most]
                row = row[:n]
            part = chosen[:n]
            out = np.zeros((len(own), len(self.docs)), np.int64)
            for a in range(0, n, SUMMED):  # one, unless an item has very many terms
                p, r = part[a:a + SUMMED], row[a:a + SUMMED]
                at = _spread(self.first[p], self.count[p])
                np.add.at(out.reshape(-1), np.repeat(r * len(self.docs), self.count[p])
                          + self.places[at],
                          np.repeat(self.weight[p], self.count[p]) * self.impacts[at])
            yield own, out
            chosen, work = chosen[n:], work[n:] - work[n - 1]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, run after run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Best:
    """The k best documents of each item so far, and the score that a document has to reach."""

    def __init__(self, floors: list[int], k: int) -> None:
        self.floors, self.k = np.array(floors, np.int64), k
        self.scores = [np.empty(0, np.int64)] * len(floors)
        self.docs = [np.empty(0, np.int64)] * len(floors)

    def take(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        for row in np.flatnonzero(scores.max(axis=1) >= self.floors[items]).tolist():
            i = items[row]
            found = np.flatnonzero(scores[row] >= self.floors[i])
            score = np.concatenate([self.scores[i], scores[row][found]])
            doc = np.concatenate([self.docs[i], docs[found]])
            best = np.lexsort((doc, -score))[:self.k]
            self.scores[i], self.docs[i] = score[best], doc[best]
            if len(best) == self.k:
                self.floors[i] = max(self.floors[i], self.scores[i][-1])


def _scan(index: Index, items: _Items, floors: list[int], k: int, first_look: bool) -> DataFrame:
    """item (its number) and doc_id and score of documents that can be among the k best."""
    shared = index.strata.sparkSession.sparkContext.broadcast((items, floors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = shared.value
        best = _Best(floors, k)

        def visit(held: list[_Stratum]) -> None:
            bounds = np.array([s.bounds for s in held])
            if first_look:
                top = bounds.argmax(axis=0)
                for i in np.unique(top).tolist():
                    for own, scores in held[i].scores((top == i) & (bounds[i] > 0)):
                        best.take(own, held[i].docs, scores)
                return
            for i in np.argsort(-bounds.sum(axis=1), kind="stable").tolist():
                for own, scores in held[i].scores(bounds[i] >= best.floors):
                    best.take(own, held[i].docs, scores)

        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: v.as_py() if c in ("m", "slice", "terms") else v.values.to_numpy()
                       for c, v in row.items()}
                held.append(_Stratum(row, items))
                n += len(row["tfs"])
                if n >= HELD_POSTINGS:
                    visit(held)
                    held, n = [], 0
        if held:
            visit(held)
        counts = [len(x) for x in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(counts)), counts), pa.int32()),
             pa.array(np.concatenate([*best.docs, np.empty(0, np.int64)])),
             pa.array(np.concatenate([*best.scores, np.empty(0, np.int64)]))],
            names=["item", "doc_id", "score"])

    return index.strata.mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search_block(index: Index, items: _Items, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of items that are searched together."""
    bounded_batches(index.strata.sparkSession)
    floors = [1] * len(items.ids)
    for row in _ranked(_scan(index, items, floors, k, True), k).where(F.col("rank") == k).collect():
        floors[row["item"]] = max(1, row["score"])
    names = index.strata.sparkSession.createDataFrame(
        list(enumerate(items.ids)), "item int, item_id long")
    found = _ranked(_scan(index, items, floors, k, False), k)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(index: Index, asked: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item (item_id, term)."""
    items = asked.join(index.df, "term").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(
        F.collect_list(F.struct("term", "df")).alias("terms"))
    results, block, n = [], [], 0

    def done() -> None:
        results.append(stored(_search_block(index, _Items(block, index.n_docs), k)))

    for item in items.orderBy("item_id").toLocalIterator():
        if block and n + len(item["terms"]) > BLOCK_TERMS:
            done()
            block, n = [], 0
        block.append(item)
        n += len(item["terms"])
    if block or not results:
        done()
    return reduce(DataFrame.unionByName, results)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each item, from an index of all documents for the items' terms."""
    asked = stored(item_terms(items))
    return search(build_index(docs, asked=asked), asked, k)
