"""Documents packed into token sequences of one length by hierarchical residual packing.

Each task packs its items best-fit, largest first, and lets go of the bins that are nearly full.
The underfull ones are items of the next round, dealt out anew to as many tasks as their number
asks for, so that any task holds a bounded number of lengths. Rounds end with a single task, or
when bins no longer fit together. Only lengths move between rounds; texts are encoded once.

Documents longer than a sequence are cut into whole sequences; what is left over is the first
piece. Every other document is one piece.

Defined results: a null or empty text is the closing id alone. Repeated rows, or rows without an id,
are documents of their own. Strings of special tokens in a text become their ids. Further columns
are left out, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches, slices
from reviewgraph.llm.bpe import PATTERN, byte_symbols
from reviewgraph.llm.store import stored

CAPACITY = 2048
CLOSING_ID = 0
# Bins with at most this share of their capacity left are done.
NEARLY_FULL = 1 / 128
# How many items one task packs.
TASK_ITEMS = 50_000
# Rounds go on while they leave at most this share of their items as underfull bins.
PROGRESS = 0.95
# Bounds the texts encoded between two batches of results.
SLICE_BYTES = 1_000_000


def _encoding(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes by rank and special tokens of a byte-level tokenizer whose ids are in the
    order of its merges."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    symbols, ids = byte_symbols(), told["model"]["vocab"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
    made = [ids[a + b] for a, b in pairs]
    if any(b <= a for a, b in zip(made, made[1:])):
        raise ValueError(f"{path}: ids don't follow the merges")
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    return ({bytes(symbols[c] for c in t): i for t, i in ids.items() if t not in special}, special)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids, ids_crc32 and item, a number of the piece's own.

    Items are numbered by task: write the rows before using the numbers twice.
    """
    bounded_batches(docs.sparkSession)
    ranks, special = _encoding(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, special))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, special = shared.value
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                                     special_tokens=special)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = [len(x or "") for x in batch.column(1).to_pylist()]
            for part in slices(batch, sizes, SLICE_BYTES):
                out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "crc")}
                tokens = []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encoding.encode_to_numpy(text or "", allowed_special="all"),
                                    CLOSING_ID).astype("<u4")
                    cuts = range(len(ids) % capacity or capacity, len(ids), capacity)
                    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)])):
                        for c, v in zip(out, (row, k, a, b - a, zlib.crc32(ids[a:b]))):
                            out[c].append(v)
                    tokens.append(ids)
                ends = np.append(0, np.cumsum(out["length"]))
                n = len(out["row"])
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(out["row"], pa.int64())),
                    pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                    pa.array(out["length"], pa.int64()),
                    pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()),
                        pa.array(np.concatenate(tokens).astype(np.int32))),
                    pa.array(out["crc"], pa.int64()),
                    pa.array(np.arange(item, item + n), pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids", "ids_crc32", "item"])
                item += n

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long,"
                                f" ids array<int>, ids_crc32 long, item long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Each size's bin and place in it, and the fill of each bin.

    A size goes to the bin with the least room that takes it, among equals the last used.
    """
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room for r
    bins, places, fills = [], [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, len(fills)
            fills.append(0)
        bins.append(own)
        places.append(fills[own])
        fills[own] += size
        if room > size:
            if not with_room[room - size]:
                rooms |= 1 << (room - size)
            with_room[room - size].append(own)
    return bins, places, fills


def _round(level: DataFrame, tasks: int, capacity: int, most: int) -> DataFrame:
    """bin, into, place, fill and underfull: where each bin of a level went.

    A bin is named after its first item.
    """
    slack = int(capacity * NEARLY_FULL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            names = np.concatenate([x.column(0).to_numpy() for x in held])
            sizes = np.concatenate([x.column(1).to_numpy() for x in held])
            order = np.lexsort((names, -sizes))
            names, sizes = names[order], sizes[order]
            if len(sizes) and (sizes[0] > capacity or sizes[-1] < 0):
                raise ValueError(f"a length is not between 0 and {capacity}")
            bins, places, fills = best_fit(sizes.tolist(), capacity)
            bins = np.array(bins, np.int64)
            first = np.unique(bins, return_index=True)[1]
            fill = np.array(fills, np.int64)[bins]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(names[first][bins]), pa.array(places, pa.int64()),
                 pa.array(fill), pa.array(fill < capacity - slack)],
                names=["bin", "into", "place", "fill", "underfull"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:  # only if rows were dealt out unevenly
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return level.repartition(tasks).mapInArrow(
        run, "bin long, into long, place long, fill long, underfull boolean")


def placement(items: DataFrame, capacity: int = CAPACITY,
              task_items: int = TASK_ITEMS) -> DataFrame:
    """item, sequence_id and offset of items (item, length) whose numbers are unique."""
    bounded_batches(items.sparkSession)
    level = items.select(F.col("item").alias("bin"), F.col("length").cast("long").alias("fill"))
    n, rounds = level.count(), []
    while True:
        tasks = max(1, -(-n // task_items))
        rounds.append(stored(_round(level, tasks, capacity, 2 * task_items)))
        level = (rounds[-1].where(F.col("underfull") & (F.col("bin") == F.col("into")))
                 .select("bin", "fill"))
        left = level.count()
        if tasks == 1 or left > PROGRESS * n:
            break
        n = left
    # Back from the last round: where the underfull bins of the rounds before it came to lie.
    out = rounds.pop().select("bin", "into", "place")
    while rounds:
        later = out.select(F.col("bin").alias("into"), F.col("into").alias("_final"),
                           F.col("place").alias("_at"))
        here = rounds.pop()
        moved = (here.where("underfull").join(later, "into")
                 .select("bin", F.col("_final").alias("into"), (F.col("place") + F.col("_at"))
                         .alias("place")))
        out = here.where(~F.col("underfull")).select("bin", "into", "place").unionByName(moved)
    return out.select(F.col("bin").alias("item"), F.col("into").alias("sequence_id"),
                      F.col("place").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = True,
         task_items: int = TASK_ITEMS) -> DataFrame:
    """id_col, piece, start, length, ids (if kept), ids_crc32, sequence_id and offset."""
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col)
    pieces = stored(pieces if keep_ids else pieces.drop("ids"))
    whole = F.col("length") == capacity
    placed = placement(pieces.where(~whole).select("item", "length"), capacity, task_items)
    alone = pieces.where(whole).withColumns({"sequence_id": F.col("item"),
                                             "offset": F.lit(0).cast("long")})
    return pieces.where(~whole).join(placed, "item").unionByName(alone).drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the pieces of each sequence, at most its capacity, one after another."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
