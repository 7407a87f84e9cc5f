"""Exact Jaccard self-join of shingle sets around pivots, and its connected components.

Jaccard distance is a metric. Documents with the same set are one point. Points meet in regions:

* Neighbourhoods. The hash space is cut into more pieces than a pair within the distance can
  differ in, so that such a pair agrees on some whole pieces. A point has a key for each piece.
  Under an order of keys with the rarest first, two near points share a key among the first few
  (as many as they may differ in, and one). A point with more pieces of its own than that is near
  nothing and leaves at once; this empties large groups of loosely alike documents.
* Pivots. Of the points with a key, the one with the fewest pieces of its own, the most central,
  is the pivot. All points that share a key with a pivot are its region; a point between pivots is
  replicated to each of their regions.
* Distances to pivots are computed exactly, members streaming past their pivot, large regions in
  slices. Who is within the distance is linked, and all such points are one component.
* Recursion. The others of a region are joined again: sorted by their distance to the pivot, each
  bin of them is a smaller region; by the triangle inequality only members whose distance to the
  pivot differs by no more than the join distance can be near, and these windows are replicated to
  the bin, in slices of bounded numbers. There every pair is decided exactly.

Two near points that share a key are either both within the distance of its pivot, or one of them
is among the others of that region: no link between components is lost, though links inside one
need not all be listed.

Defined results: a null or empty text, or one without words, has the empty set, size 0, and is
linked with nothing. Of rows with the same id, the text that sorts last counts, and one row comes
back. A null id takes no part and gives no row. Extra columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.components import components
from reviewgraph.llm.shingles import digest, mixed, shared, shingle_sets
from reviewgraph.llm.store import one_text_per_id, stored

SLICE_BYTES = 1_000_000
# Sizes fall into classes that grow by this factor.
CLASS_GROWTH = 5 / 3
LARGEST_CLASS = 40
# One piece in so many is more than a pair can differ in.
SPARE = 4
# Keys are made and counted in so many parts, one after another, which bounds the room they take.
KEY_PARTS = 2
# Members that stream past one copy of a pivot, and undecided points that one task holds.
SLICE_MEMBERS = 2_000
SLICE_OTHERS = 256
# Slack for distances computed in floating point.
SLACK = 1e-9


class Classes:
    """Size classes, and the pieces of the hash space in each, for a similarity in percent."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        if not 60 < percent <= 100:
            raise ValueError("percent has to be over 60: classes must not skip one another")

    def number(self, n: int) -> int:
        """The class of a size."""
        c = int(math.log(n) / math.log(CLASS_GROWTH))
        while self.first(c + 1) <= n:
            c += 1
        while self.first(c) > n:
            c -= 1
        return c

    @staticmethod
    def first(c: int) -> int:
        """The smallest size of a class."""
        return math.ceil(CLASS_GROWTH ** c)

    def differing(self, c: int) -> int:
        """In how many elements two sets of this class at most differ, being similar enough."""
        most = self.first(c + 1) - 1
        return 2 * most * (100 - self.percent) // (100 + self.percent)

    def pieces(self, c: int) -> int:
        t = self.differing(c)
        return t + 1 + t // SPARE

    def of(self, n: int) -> list[int]:
        """The own class, and the next if a similar set can be in it."""
        c = self.number(n)
        return [c, c + 1] if 100 * n >= self.percent * self.first(c + 1) else [c]


@functools.cache
def _edges(pieces: int) -> np.ndarray:
    """Where the hash space is cut."""
    return np.array([k * (1 << 64) // pieces for k in range(1, pieces)], np.uint64)


def piece_keys(hashes: np.ndarray, c: int, pieces: int) -> np.ndarray:
    """A key for each piece of the hash space, of the sorted hashes in it."""
    cut = np.searchsorted(hashes, _edges(pieces))
    sums = np.append(np.uint64(0), np.cumsum(mixed(hashes + np.uint64(12345)), dtype=np.uint64))
    at = np.concatenate([[0], cut, [len(hashes)]]).astype(np.int64)
    tag = (np.uint64(c) << np.uint64(40)) + np.arange(pieces, dtype=np.uint64)
    return mixed((sums[at[1:]] - sums[at[:-1]]) + mixed(tag)).view(np.int64)


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


POINTS = "doc_id long, n int, d1 long, d2 long"
KEYS = "doc_id long, class int, keys array<long>"


def _sets(docs: DataFrame, size: int, schema: str,
          told: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """What is told of the ids and shingle sets of documents (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _encoded(batch.column(1).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                yield told(part.column(0),
                           list(shingle_sets(texts[done:done + part.num_rows], size)))
                done += part.num_rows

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def points(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, and the size and digest of its set."""
    def told(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        digests = [digest(h) for h in sets]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(h) for h in sets], pa.int32()),
             pa.array([d[0] for d in digests], pa.int64()),
             pa.array([d[1] for d in digests], pa.int64())], names=["doc_id", "n", "d1", "d2"])

    return _sets(docs, size, POINTS, told)


def piece_rows(docs: DataFrame, size: int, percent: int, part: int, parts: int) -> DataFrame:
    """doc_id, class and key: a part of the keys of each document in each of its classes."""
    def told(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        classes = Classes(percent)
        at, of, ends, flat = [], [], [0], []
        for i, h in enumerate(sets):
            for c in classes.of(len(h)) if len(h) else []:
                keys = piece_keys(h, c, classes.pieces(c))
                keys = keys[keys % parts == part]
                at.append(i)
                of.append(c)
                ends.append(ends[-1] + len(keys))
                flat.append(keys)
        keys = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()),
            pa.array(np.concatenate([*flat, np.empty(0, np.int64)]), pa.int64()))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at, pa.int64())), pa.array(of, pa.int32()), keys],
            names=["doc_id", "class", "keys"])

    return _sets(docs, size, KEYS, told).select("doc_id", "class", F.explode("keys").alias("key"))


def _shared_keys(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of points (first) whose key stands in other rows too.

    Keys are made and moved once; most are found once and end where they meet.
    """
    found = F.count(F.lit(1)).over(W.partitionBy("key"))
    repeated = rows.withColumn("found", found).where(F.col("found") > 1).drop("found")
    return stored(repeated.join(first.select("doc_id"), "doc_id", "left_semi"))


def neighbourhoods(docs: DataFrame, first: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id and own of each point's first keys in the order of keys.

    own counts the pieces that no other point shares. first has the points to join.
    """
    common = _shared_keys(piece_rows(docs, size, percent, 0, KEY_PARTS), first)
    for part in range(1, KEY_PARTS):
        common = common.unionByName(
            _shared_keys(piece_rows(docs, size, percent, part, KEY_PARTS), first))
    # Those of copies alone end here, in the count of points.
    counts = common.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    classes = Classes(percent)
    need, pieces = (F.element_at(F.array(*[F.lit(f(c)) for c in range(LARGEST_CLASS + 1)]),
                                 F.col("class") + 1)
                    for f in (lambda c: classes.differing(c) + 1, classes.pieces))
    own_class = W.partitionBy("doc_id", "class")
    ranked = (common.join(counts, "key")
              .withColumn("own", pieces - F.count(F.lit(1)).over(own_class))
              .withColumn("rank", F.row_number().over(own_class.orderBy("df", "key"))))
    return ranked.where(F.col("rank") <= need - F.col("own")).select("key", "doc_id", "own")


def regions(near: DataFrame) -> DataFrame:
    """pivot and doc_id: the members of each pivot's region, without itself."""
    pivots = (near.groupBy("key").agg(F.min(F.struct("own", "doc_id")).alias("p"),
                                      F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1).select("key", F.col("p.doc_id").alias("pivot")))
    return (near.join(pivots, "key").where(F.col("doc_id") != F.col("pivot"))
            .select("pivot", "doc_id").distinct())


def _sliced(members: DataFrame, by: list[str], most: int) -> DataFrame:
    """The members with a slice number, and how many slices their group has."""
    sizes = members.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("slices"))
    return (members.join(sizes, by)
            .withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int")))


DISTANCES = "pivot long, doc_id long, both int, either int"


def pivot_distances(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """pivot, doc_id and the sizes of intersection (both) and union (either)."""
    sliced = _sliced(members, ["pivot"], SLICE_MEMBERS)
    heads = (sliced.select("pivot", "slices").distinct()
             .select("pivot", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                     F.col("pivot").alias("doc_id"), F.lit(0).alias("role")))
    rows = heads.unionByName(sliced.select("pivot", "slice", "doc_id", F.lit(1).alias("role")))
    rows = (rows.join(docs, "doc_id").repartition("pivot", "slice")
            .sortWithinPartitions("pivot", "slice", "role")
            .select("pivot", "role", "doc_id", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            texts = _encoded(batch.column(3).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                role = part.column(1).to_pylist()
                pivots, ids, both, either = [], [], [], []
                own = shingle_sets(texts[done:done + part.num_rows], size)
                for p, r, d, h in zip(part.column(0).to_pylist(), role,
                                      part.column(2).to_pylist(), own):
                    if r == 0:
                        head = h
                        continue
                    n = shared(head, h)
                    pivots.append(p)
                    ids.append(d)
                    both.append(n)
                    either.append(len(head) + len(h) - n)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivots, pa.int64()), pa.array(ids, pa.int64()),
                     pa.array(both, pa.int32()), pa.array(either, pa.int32())],
                    names=["pivot", "doc_id", "both", "either"])

    return rows.mapInArrow(run, DISTANCES)


def remaining_links(docs: DataFrame, distances: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links of the points that are not within the distance of their region's pivot.

    Regions with few such points are one bin. In larger ones bins are half the join distance wide,
    and a member goes to all bins that its window touches.
    """
    reach = 1 - percent / 100 + SLACK
    width = reach / 2
    far = distances.withColumn("d", 1 - F.col("both") / F.col("either")).withColumn(
        "linked", 100 * F.col("both") >= percent * F.col("either"))
    others = far.where(~F.col("linked"))
    spans = others.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"),
                                        F.max("d").alias("high"))
    far = far.join(spans, "pivot")
    binned = F.col("n") > SLICE_OTHERS
    others = far.where(~F.col("linked")).withColumn(
        "bin", F.when(binned, F.floor(F.col("d") / width)).otherwise(F.lit(0)))
    sliced = _sliced(others.select("pivot", "bin", "doc_id"), ["pivot", "bin"], SLICE_OTHERS)
    sizes = sliced.select("pivot", "bin", "slices").distinct()
    touched = F.when(binned, F.sequence(F.floor((F.col("d") - reach) / width),
                                        F.floor((F.col("d") + reach) / width))).otherwise(
        F.array(F.lit(0).cast("bigint")))
    window = (far.where(F.col("d").between(F.col("low") - reach, F.col("high") + reach))
              .withColumn("bin", F.explode(touched)).join(sizes, ["pivot", "bin"])
              .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .select("pivot", "bin", "slice", "doc_id", F.lit(1).alias("role")))
    rows = sliced.select("pivot", "bin", "slice", "doc_id", F.lit(0).alias("role")) \
        .unionByName(window)
    rows = (rows.join(docs, "doc_id").repartition("pivot", "bin", "slice")
            .sortWithinPartitions("pivot", "bin", "slice", "role")
            .select("pivot", "bin", "slice", "role", "doc_id", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, packed = None, [], None
        for batch in batches:
            texts = _encoded(batch.column(5).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                a, b = [], []
                keys = zip(*(part.column(i).to_pylist() for i in range(5)))
                for (*now, role, d), h in zip(
                        keys, shingle_sets(texts[done:done + part.num_rows], size)):
                    if now != group:
                        group, held, packed = now, [], None
                    if role == 0:
                        held.append((d, h))
                        packed = None
                        continue
                    if not held:
                        continue
                    if packed is None:
                        packed = _packed(held)
                    for x in _near(packed, d, h, percent):
                        a.append(d)
                        b.append(x)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _packed(held: list[tuple[int, np.ndarray]]) -> tuple:
    """Sets laid out by element: sorted elements, and the set each belongs to."""
    ids = np.array([d for d, _ in held], np.int64)
    sizes = np.array([len(h) for _, h in held], np.int64)
    flat = np.concatenate([h for _, h in held])
    order = np.argsort(flat, kind="stable")
    return ids, sizes, flat[order], np.repeat(np.arange(len(held)), sizes)[order]


def _near(packed: tuple, doc: int, h: np.ndarray, percent: int) -> list[int]:
    """The held documents that are similar enough to one more set."""
    ids, sizes, flat, of = packed
    low, high = np.searchsorted(flat, h), np.searchsorted(flat, h, side="right")
    n = high - low
    at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    both = np.bincount(of[at], minlength=len(ids))
    near = (100 * both >= percent * (sizes + len(h) - both)) & (ids != doc)
    return ids[near].tolist()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest document reachable by links."""
    docs = one_text_per_id(docs, id_col, text_col)
    sets = stored(points(docs, size))
    same = (sets.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("doc_id").alias("first")))
    first = stored(same)
    ids = first.select(F.col("first").alias("doc_id"))
    members = stored(regions(neighbourhoods(docs, ids, size, percent)))
    # Texts of all documents move once; the steps that compare read these few.
    both = members.select(F.explode(F.array("pivot", "doc_id")).alias("doc_id")).distinct()
    docs = stored(docs.join(both, "doc_id", "left_semi"))
    distances = stored(pivot_distances(docs, members, size))
    near = distances.where(100 * F.col("both") >= percent * F.col("either")).select(
        F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    rest = remaining_links(docs, distances, size, percent)
    groups = components(near.unionByName(rest))
    return (sets.join(first, ["d1", "d2"], "left")
            .join(groups, F.col("first") == F.col("node"), "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component", "first", "doc_id").alias("component_id")))
