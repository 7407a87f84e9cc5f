"""The trie of conversation prefixes, rolled up in bands of depth.

Turns get their places by running numbers over the whole table. A conversation is cut into bands
of a fixed height; a node's key covers its band and the digest of the bands before, which is made
the same way from bands of bands, so that no conversation of any length is gathered in one row or
task. A node hands its values to its ancestors within its band only. The roots of the bands then
form a tree that is as many times lower as bands are high; their totals are completed along its
pointers, whose reach doubles each round, and are handed to the ancestors in the band above.

Defined results: null roles and texts are empty. Turns of one conversation that tie in their number
are ordered by the SHA-256 of role length, a colon, role and text; equal rows are turns of their
own. Rows without a conversation's id are left out. An empty table has no conversation and no node.
Further columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.functions.numbering import numbered
from reviewgraph.llm.batches import bounded_batches
from reviewgraph.llm.store import stored

# How many depths a band has: the most ancestors a node hands its values to at once.
HEIGHT = 8
# Conversations borrow their first turns from the first of this many ids, at most MOST - 1 turns.
FAMILY, MOST = 100, 6
# Ids of one conversation after another that are handed on as one row.
CHUNK_IDS = 8192


def _short(text: Column) -> Column:
    """128 bits of the SHA-256 in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv, place (from 1 over the whole table), digest and chars of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
        .alias("_sha"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("_sha")]
    return numbered(rows, order, "place").select(
        "conv", "place", F.substring("_sha", 1, 32).alias("digest"), "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST) -> DataFrame:
    """conv, depth, digest, chars and last (the conversation's depth), a root row of depth 0 too.

    The first h turns are those of conversation c - c % family, h = crc32(c) % most.
    """
    own = turns_in_order(turns)
    convs = own.groupBy("conv").agg(F.min("place").alias("first"),
                                    F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("conv").cast("string")) % most
    convs = convs.withColumns({"h": head, "donor": F.col("conv") - F.col("conv") % family})
    donors = convs.where(F.col("conv") % family == 0).select(
        F.col("conv").alias("donor"), F.col("n").alias("_n"))
    taken = F.least(F.col("h"), F.coalesce(F.col("_n"), F.lit(0)))
    convs = stored(convs.join(donors, "donor", "left").withColumn("m", taken).withColumn(
        "last", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("_n"))
    seen = own.join(convs, "conv").withColumn("at", F.col("place") - F.col("first"))
    kept = seen.where(F.col("at") >= F.col("h")).select(
        "conv", (F.col("at") - F.col("h") + F.col("m") + 1).alias("depth"), "digest", "chars",
        "last")
    lent = (seen.where((F.col("conv") % family == 0) & (F.col("at") < most - 1))
            .select("donor", "at", "digest", "chars"))
    borrowed = (convs.where(F.col("m") > 0).select("conv", "donor", "m", "last")
                .join(lent, "donor").where(F.col("at") < F.col("m"))
                .select("conv", (F.col("at") + 1).alias("depth"), "digest", "chars", "last"))
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"),
                         F.lit(0).cast("long").alias("chars"), "last")
    return kept.unionByName(borrowed).unionByName(roots)


def prefix_keys(rows: DataFrame, deepest: int, height: int, *more: str) -> DataFrame:
    """conv, at, key, parent, band_keys and more of rows (conv, at, digest, *more).

    A key stands for all digests of a conversation up to at, counted from 0 without gaps; parent
    is the key before it, band_keys the keys from the start of its band on.
    """
    bands = rows.groupBy("conv", F.floor(F.col("at") / height).alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("at", "digest", *more))).alias("steps"))
    before = through = F.lit(None).cast("string")
    if deepest >= height:
        bands = stored(bands)
        sums = bands.select("conv", F.col("band").alias("at"),
                            _short(F.array_join("steps.digest", ",")).alias("digest"))
        above = prefix_keys(sums, deepest // height, height).select(
            "conv", F.col("at").alias("band"), F.col("key").alias("_through"),
            F.col("parent").alias("_before"))
        bands = bands.join(above, ["conv", "band"])
        before, through = F.col("_before"), F.col("_through")

    def key(step: Column, j: Column) -> Column:
        own = _short(F.concat(F.coalesce(before, F.lit("")), F.lit(":"), F.array_join(
            F.slice(F.col("steps.digest"), F.lit(1), j + 1), ",")))
        return F.when((j == height - 1) & through.isNotNull(), through).otherwise(own)

    keyed = bands.select("conv", "steps", before.alias("_start"),
                         F.transform("steps", key).alias("keys"))
    return (keyed.select("conv", "_start", "keys", F.posexplode("steps").alias("j", "step"))
            .select("conv", "step.at", F.get("keys", F.col("j")).alias("key"),
                    F.coalesce(F.get("keys", F.col("j") - 1), F.col("_start")).alias("parent"),
                    F.slice("keys", F.lit(1), F.col("j") + 1).alias("band_keys"),
                    *[f"step.{c}" for c in more]))


def id_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: the ids (conv) of each key, ascending, joined by commas, as SHA-256.

    Ids are dealt out by range; runs of one key travel in chunks, and what a digest needs in order
    streams through one task without being held.
    """
    bounded_batches(ends.sparkSession)
    in_order = (ends.select("key", "conv").repartitionByRange("key", "conv")
                .sortWithinPartitions("key", "conv"))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == CHUNK_IDS:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(),
                                                                pa.string()))],
                    names=["key", "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    running.update(b",")
                else:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256()
                running.update(ids.encode())
            yield pa.RecordBatch.from_pylist(
                [{"key": k, "ends_sha256": x} for k, x in done],
                pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
        if running:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": running.hexdigest()}])

    parts = in_order.mapInArrow(chunks, "key string, first long, ids string")
    return (parts.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(digests, "key string, ends_sha256 string"))


def band_root_totals(roots: DataFrame, bands: int, values: list[str]) -> DataFrame:
    """key and completed values of band roots (key, band, above, *values).

    above is the root of the band before. Each round adds what descendants within reach have
    summed up, and doubles the reach.
    """
    rows, reach = roots, 1
    while reach < bands:
        rows = stored(rows)
        moved = rows.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("key")).agg(
            *[F.sum(v).alias(f"_{v}") for v in values])
        sums = rows.join(moved, "key", "left")
        sums = sums.select("key", "band", *[
            (F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])
        # Rows with an ancestor at twice the reach point there now.
        steps = rows.select(F.col("key").alias("above"), F.col("above").alias("_next"))
        further = (rows.where(F.col("band") >= 2 * reach).select("key", "above")
                   .join(steps, "above").select("key", F.col("_next").alias("above")))
        rows = sums.join(further, "key", "left")
        reach *= 2
    return rows.select("key", *values)


def trie_nodes(paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of paths (conv, depth, digest, chars, last), with subtree totals.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, and key and parent, digests of the nodes' prefixes.
    """
    paths = stored(paths)
    deepest = paths.agg(F.max("depth")).first()[0] or 0
    keyed = stored(prefix_keys(
        paths.select("conv", F.col("depth").alias("at"), "digest", "chars", "last"),
        deepest, height, "chars", "last").withColumnRenamed("at", "depth"))
    ended = F.col("last") == F.col("depth")
    # All but the counted columns follow from the key; as such they are grouped by hash.
    nodes = stored(keyed.groupBy("key", "parent", "depth", "chars", "band_keys").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(ended.cast("long")).alias("n_ends")))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                         F.col("band_keys").alias("_above"))
    first_of_band = F.col("depth") % height == 0
    nodes = stored(nodes.join(above, "parent", "left").withColumn(
        "above_keys", F.when(first_of_band, F.col("_above"))).drop("_above"))

    values = ["n_leaves", "saved_tokens"]
    own = nodes.select(
        "parent", F.explode("band_keys").alias("key"),
        (F.col("n_convs") == F.col("n_ends")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    child = (F.col("key") == F.col("parent")).cast("long")
    totals = own.groupBy("key").agg(F.sum(child).alias("n_children"),
                                    *[F.sum(v).alias(v) for v in values])
    if deepest >= height:
        totals = stored(totals)
        roots = nodes.where(first_of_band).join(totals, "key").select(
            "key", F.floor(F.col("depth") / height).alias("band"),
            F.get("above_keys", F.lit(0)).alias("above"), *values)
        complete = band_root_totals(roots, deepest // height + 1, values)
        handed = (nodes.where(first_of_band & (F.col("depth") > 0)).join(complete, "key")
                  .select("parent", F.explode("above_keys").alias("key"), *values)
                  .withColumn("n_children", child).drop("parent"))
        totals = totals.unionByName(handed).groupBy("key").agg(
            *[F.sum(v).alias(v) for v in ["n_children", *values]])
    digests = id_digests(keyed.where(ended))
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(totals, "key").join(digests, "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce(
                "n_children", F.lit(0)).alias("n_children"), *values,
                F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "key", "parent"))


def conversation_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of all rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt(turns), height)
