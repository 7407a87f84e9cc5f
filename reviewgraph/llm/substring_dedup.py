"""Byte strings that start twice or more in a corpus, marked with run-length indexes.

Where windows of the asked length are equal, they hold the same anchor: the window's smallest hash
of a shorter string, the leftmost of ties. Each window belongs to one anchor; an anchor found once
belongs to windows found once, and most text ends there. Documents equal to the last byte go on as
one. The others meet at a pivot, the smallest document with an anchor, so that all windows of an
anchor are in one region, and text goes to few regions. A task packs regions into run-length
indexes and marks what their matching statistics say; equal windows of one text are matches too.

A region too large for an index is cut finer, exactly: the windows of an anchor are dealt out in
short runs by the string that all windows of a run have in common, and runs found once end there.
A run that is still too large is cut into single windows, which are counted instead.

Defined results: a null or empty text has no bytes and nothing removed. Of rows with one id, the
text that sorts last counts, and one row comes back. A null id takes no part and gives no row.
Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.run_index import repeated_windows
from reviewgraph.llm.shingles import mixed
from reviewgraph.llm.store import bucketed, one_text_per_id, stored

SIZE = 400
# Anchors are strings of this part of a window.
ANCHOR_PART = 0.4
# A region of more bytes is cut finer; an index holds about this many, or one region.
REGION_BYTES = 3_000_000
INDEX_BYTES = 1_500_000
# Window starts that are dealt out together when a region is cut.
RUN = 16
CHUNK = 1 << 20
SLICE_BYTES = 1_000_000

_MULTIPLY = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(424242).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) \
    + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = (_powers(_MULTIPLY, size), _powers(pow(_MULTIPLY, -1, 1 << 64), size))
    return _TABLES[size]


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the string of this size at each position."""
    up, down = _tables(len(data))
    sums = np.append(np.uint64(0), np.cumsum(_VALUES[data] * up[:len(data)], dtype=np.uint64))
    return mixed((sums[size:] - sums[:-size]) * down[:len(data) - size + 1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of so many."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:len(keys)] = keys
    grid = padded.reshape(blocks, width)
    on = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], on[width - 1:width - 1 + n])


def anchors(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order: hash, position, and first window start; the next one's start ends it."""
    part = max(1, int(size * ANCHOR_PART))
    width = size - part + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(text) - size + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + size - 1, len(text) - low), low)
        hashes = string_hashes(data, part)
        keys = (hashes >> np.uint64(22) << np.uint64(22)) | np.arange(len(hashes),
                                                                      dtype=np.uint64)
        owner = (_least(keys, width) & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        found.append((hashes[owner[first]], owner[first] + low, first + low))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    a, p, f = (np.concatenate(x) for x in zip(*found))
    new = np.append(True, p[1:] != p[:-1])  # an anchor over the border of chunks
    return a[new], p[new], f[new]


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


DOCUMENTS = ("doc_id long, n_bytes long, digest binary,"
             " anchors array<struct<anchor:long,first:int,last:int,times:int>>")


def anchored(docs: DataFrame, size: int) -> DataFrame:
    """Length, digest and anchors of each document; equal neighbours are one anchor.

    An anchor has its first and last window start, and how often it stands there.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(1).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                own = texts[done:done + part.num_rows]
                done += part.num_rows
                columns: list[list[np.ndarray]] = [[], [], [], []]
                ends = [0]
                for text in own:
                    a, _, first = anchors(text, size) if len(text) >= size else (
                        np.empty(0, np.uint64),) * 3
                    if len(a):
                        at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                        last = np.append(first[1:] - 1, len(text) - size)
                        until = np.append(at[1:], len(a))
                        for c, x in zip(columns, (a[at].view(np.int64), first[at],
                                                  last[until - 1], until - at)):
                            c.append(x)
                        ends.append(ends[-1] + len(at))
                    else:
                        ends.append(ends[-1])
                flat = [np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64)
                        for c in columns]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), (
                    pa.StructArray.from_arrays(
                        [pa.array(flat[0], pa.int64()),
                         *(pa.array(x, pa.int32()) for x in flat[1:])],
                        ["anchor", "first", "last", "times"])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in own], pa.int64()),
                     pa.array([hashlib.sha256(x).digest()[:16] for x in own], pa.binary()), lists],
                    names=["doc_id", "n_bytes", "digest", "anchors"])

    return docs.mapInArrow(run, DOCUMENTS)


def region_spans(firsts: DataFrame, size: int) -> DataFrame:
    """region, doc_id, begin and stop of text with anchors found again (firsts: with anchors)."""
    rows = (firsts.select("doc_id", F.explode("anchors").alias("x"))
            .select("doc_id", "x.anchor", "x.first", "x.last", "x.times"))
    again = (rows.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("doc_id").alias("region"))
             .where(F.col("n") > 1).drop("n"))
    return (rows.join(again, "anchor")
            .select("region", "doc_id", "anchor", F.col("first").alias("begin"),
                    (F.col("last") + size).alias("stop")))


MARKED = "doc_id long, begin int, stop int"


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, stop in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([begin, stop])
    return out


def indexed(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Marked spans: text in windows that start twice or more within a region.

    spans has region, doc_id, begin and stop. Regions are packed into indexes; of overlapping
    text of one document in an index, each byte is there once, so that no byte matches itself.
    """
    wanted = spans.groupBy("region", "doc_id").agg(
        F.collect_list(F.struct("begin", "stop")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions, ids, begins, pieces = [], [], [], []
            for region, doc, spans, text in zip(*(batch.column(i) for i in range(4))):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for begin, stop in _merged([(s["begin"], s["stop"]) for s in spans.as_py()]):
                    regions.append(region.as_py())
                    ids.append(doc.as_py())
                    begins.append(begin)
                    pieces.append(raw[begin:stop])
            yield pa.RecordBatch.from_arrays(
                [pa.array(regions, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(begins, pa.int32()), pa.array(pieces, pa.binary())],
                names=["region", "doc_id", "begin", "piece"])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        bytes_held, region = 0, None

        def out() -> pa.RecordBatch:
            ids, begins, stops = [], [], []
            pieces, places = [], []
            for doc, begin, piece in sorted(held):
                if places and places[-1][0] == doc and begin <= places[-1][1] + len(pieces[-1]):
                    pieces[-1] += piece[places[-1][1] + len(pieces[-1]) - begin:]
                else:
                    places.append((doc, begin))
                    pieces.append(piece)
            for k, first, last in repeated_windows(pieces, size):
                doc, begin = places[k]
                ids.append(doc)
                begins.append(begin + first)
                stops.append(begin + last + size)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(begins, pa.int32()),
                 pa.array(stops, pa.int32())], names=["doc_id", "begin", "stop"])

        for batch in batches:
            for now, doc, begin, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != region and bytes_held > INDEX_BYTES:
                    yield out()
                    held, bytes_held = [], 0
                region = now
                held.append((doc, begin, piece))
                bytes_held += len(piece)
        if held:
            yield out()

    pieces = (wanted.join(docs, "doc_id").select("region", "doc_id", "spans", "text")
              .mapInArrow(cut, "region long, doc_id long, begin int, piece binary"))
    return (pieces.repartition("region").sortWithinPartitions("region", "doc_id", "begin")
            .mapInArrow(mark, MARKED))


def _of_anchors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text and wanted anchors of documents (wanted: doc_id, anchor)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    return lists.join(docs, "doc_id").select("doc_id", "anchors", "text")


def window_runs(docs: DataFrame, wanted: DataFrame, size: int, run: int) -> DataFrame:
    """k1, k2, doc_id, begin and stop: runs of windows around wanted anchors.

    k1 and k2 are a digest of the string that all windows of a run have in common, and of the
    run's place around the anchor: equal windows are in runs of equal digests.
    """
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2, begins, stops = [], [], [], [], []
            for doc, own, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own = set(own)
                a, places, first = anchors(raw, size)
                last = np.append(first[1:] - 1, len(raw) - size)
                for x, p, f, e in zip(a.view(np.int64).tolist(), places.tolist(), first.tolist(),
                                      last.tolist()):
                    if x not in own:
                        continue
                    for j in range((p - e) // run, (p - f) // run + 1):
                        low, high = max(f, p - run * j - run + 1), min(e, p - run * j)
                        top = p - run * j
                        core = raw[top:top + size - run + 1]
                        d = hashlib.sha256(b"%d:%b" % (j, core)).digest()
                        ids.append(doc)
                        k1.append(int.from_bytes(d[:8], "big", signed=True))
                        k2.append(int.from_bytes(d[8:16], "big", signed=True))
                        begins.append(low)
                        stops.append(high + size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(begins, pa.int32()), pa.array(stops, pa.int32())],
                names=["k1", "k2", "doc_id", "begin", "stop"])

    return _of_anchors(docs, wanted).mapInArrow(
        cut, "k1 long, k2 long, doc_id long, begin int, stop int")


def cut_finer(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Marked spans of regions that are too large for one index."""
    runs = stored(window_runs(docs, spans.select("doc_id", "anchor").distinct(), size, RUN))
    sizes = (runs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum(F.col("stop") - F.col("begin")).alias("bytes"))
             .where(F.col("n") > 1))
    found = runs.join(sizes, ["k1", "k2"])
    small = found.where(F.col("bytes") <= REGION_BYTES).select(
        F.xxhash64("k1", "k2").alias("region"), "doc_id", "begin", "stop")
    large = found.where(F.col("bytes") > REGION_BYTES).select("doc_id", "begin", "stop")
    return indexed(docs, small, size).unionByName(counted_windows(docs, large, size))


def counted_windows(docs: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Marked spans among single windows: those whose digest is counted more than once."""
    wanted = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2, begins = [], [], [], []
            for doc, spans, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for begin, stop in _merged([(s["begin"], s["stop"]) for s in spans]):
                    for s in range(begin, stop - size + 1):
                        d = hashlib.sha256(raw[s:s + size]).digest()
                        ids.append(doc)
                        k1.append(int.from_bytes(d[:8], "big", signed=True))
                        k2.append(int.from_bytes(d[8:16], "big", signed=True))
                        begins.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(begins, pa.int32())], names=["k1", "k2", "doc_id", "begin"])

    rows = (wanted.join(docs, "doc_id").select("doc_id", "spans", "text")
            .mapInArrow(cut, "k1 long, k2 long, doc_id long, begin int"))
    again = rows.groupBy("k1", "k2").count().where(F.col("count") > 1).drop("count")
    return rows.join(again, ["k1", "k2"]).select(
        "doc_id", "begin", (F.col("begin") + size).cast("int").alias("stop"))


RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long,"
          " spans array<struct<begin:int,stop:int>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin, stop) and the bytes that are kept.

    Each byte in a string of this size that starts anywhere else too is removed.
    """
    # Several steps fetch texts by id: in buckets of the id they move once.
    docs = bucketed(one_text_per_id(docs, id_col, text_col), "doc_id")
    found = stored(anchored(docs, size))
    groups = (found.where(F.col("n_bytes") >= size).groupBy("digest", "n_bytes")
              .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    groups = stored(groups)
    firsts = found.select("doc_id", "anchors").join(groups.select("doc_id"), "doc_id", "left_semi")
    spans = stored(region_spans(firsts, size))
    large = stored(spans.groupBy("region").agg(F.sum(F.col("stop") - F.col("begin")).alias("b"))
                   .where(F.col("b") > REGION_BYTES).select("region"))
    if large.isEmpty():
        marked = indexed(docs, spans.drop("anchor"), size)
    else:
        marked = indexed(docs, spans.join(large, "region", "left_anti").drop("anchor"), size) \
            .unionByName(cut_finer(docs, spans.join(large, "region", "left_semi"), size))
    copies = (found.join(groups.where(F.col("n") > 1).select("digest", "n_bytes"),
                         ["digest", "n_bytes"], "left_semi")
              .select("doc_id", F.lit(0).alias("begin"), F.col("n_bytes").cast("int").alias("stop")))
    marked = stored(marked.unionByName(copies))
    lists = marked.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    rows = docs.join(lists, "doc_id", "left").select("doc_id", "text", "spans")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(1).to_pylist())
            done = 0
            for part in slices(batch, [len(x) for x in texts], SLICE_BYTES):
                out = []
                for raw, spans in zip(texts[done:done + part.num_rows],
                                      part.column(2).to_pylist()):
                    own = _merged([(s["begin"], s["stop"]) for s in spans or []])
                    edges = [0, *(x for span in own for x in span), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(raw), len(raw) - len(kept), len(own),
                                [{"begin": a, "stop": b} for a, b in own], kept))
                done += part.num_rows
                n, removed, runs, spans, kept = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()),
                                                         ("stop", pa.int32())]))),
                     pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(keep, RESULT)
