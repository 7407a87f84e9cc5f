"""Lines repeated across documents, found by their hashes; decisions travel as bitmaps, not text.

Line hashes are dealt out by range, together with a slice of their documents, so that a line found
in a third of all documents spreads over many tasks. Each task sorts its range by hash, document
(largest first) and position, and streams it: a line is a document's first of its kind if the row
before it belongs to another document, and the first row of a slice names its keeper. A task passes
on one row for each hash and slice, and these few rows meet by hash. What comes back to a document
is a run-length compressed bitmap of the lines it loses, which becomes that of the lines it keeps.

Defined results: a null or empty text is one empty line, which stays. Rows with one id are one
document. A null id is a document of its own, smaller than all others. Further columns stay on the
input; names beginning with `_ld_` are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewgraph.llm.words import SPACE, ascii_lower, lines_of

MIN_CHARS = 20
MIN_DOCS = 3
_NO_ID = -(2 ** 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_ld_id and _ld_text_hash tell rows apart; rows equal in both have equal lines."""
    return docs.withColumns({
        "_ld_id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)),
        "_ld_text_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def _long_lines(rows: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that is long enough: its two hashes, document, its slice and position."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    return (rows.select("_ld_id", "_ld_text_hash", F.posexplode(keys).alias("pos", "key"))
            .where(F.length("key") >= min_chars)
            .select("_ld_id", "_ld_text_hash", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(1), "key").alias("h2"),
                    F.pmod(F.xxhash64("_ld_id"), F.lit(slices)).cast("int").alias("slice")))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, slice and keeper, the largest document, of each line found in enough documents.

    A row for each slice of documents that the line stands in.
    """
    by = ["h1", "h2", "slice"]
    in_order = Window.partitionBy(*by).orderBy(F.desc("_ld_id"), "pos")
    first = ~F.lag("_ld_id").over(in_order).eqNullSafe(F.col("_ld_id"))
    streamed = (lines.select(*by, "_ld_id", "pos").repartitionByRange(*by)
                .withColumn("first", first))
    heads = streamed.where("first").groupBy(*by).agg(
        F.max("_ld_id").alias("largest"), F.count(F.lit(1)).alias("n_docs"))
    return (heads.groupBy("h1", "h2").agg(F.max("largest").alias("keeper"),
                                          F.sum("n_docs").alias("n_docs"),
                                          F.collect_list("slice").alias("slices"))
            .where(F.col("n_docs") >= min_docs)
            .select("h1", "h2", F.explode("slices").alias("slice"), "keeper"))


def runs_of(positions: Column) -> Column:
    """Runs (start, length) of sorted distinct positions."""
    starts = F.filter(positions, lambda p, i: ~F.get(positions, i - 1).eqNullSafe(p - 1))
    ends = F.filter(positions, lambda p, i: ~F.get(positions, i + 1).eqNullSafe(p + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(
        s.alias("start"), (e - s + 1).alias("length")))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs (start, length) of kept lines between sorted runs of dropped ones."""
    starts = F.concat(F.array(F.lit(0)),
                      F.transform(dropped, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(
        s.alias("start"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_ld_id, _ld_text_hash and _ld_dropped, runs of lines, of documents that lose any line.

    A line whose key has at least min_chars code points and stands in at least min_docs documents
    stays only in the largest document that holds it (there, in all its places).
    """
    lines = _long_lines(_with_row_key(docs, id_col, text_col), text_col, min_chars)
    out = (lines.join(repeated_lines(lines, min_docs), ["h1", "h2", "slice"])
           .where(F.col("_ld_id") != F.col("keeper")))
    positions = out.groupBy("_ld_id", "_ld_text_hash").agg(
        F.array_sort(F.collect_set("pos")).alias("_ld_positions"))
    return positions.select("_ld_id", "_ld_text_hash",
                            runs_of(F.col("_ld_positions")).alias("_ld_dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All input rows and columns, with n_lines, n_dropped, keep_runs and kept_text added."""
    rows = _with_row_key(docs, id_col, text_col)
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    dropped = F.coalesce(F.col("_ld_dropped"),
                         F.array().cast("array<struct<start:int,length:int>>"))
    n_dropped = F.aggregate(dropped, F.lit(0).cast("long"), lambda n, r: n + r["length"])
    lines = lines_of(F.col(text_col))
    kept = F.array_join(F.flatten(F.transform(
        F.col("keep_runs"), lambda r: F.slice(F.col("_ld_lines"), r["start"] + 1, r["length"]))),
        "\n")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (rows.join(bitmaps, ["_ld_id", "_ld_text_hash"], "left")
            .withColumn("_ld_lines", lines)
            .withColumn("n_lines", F.size("_ld_lines").cast("long"))
            .withColumn("n_dropped", n_dropped)
            .withColumn("keep_runs", keep_runs(dropped, F.col("n_lines").cast("int")))
            .withColumn("kept_text", F.when(F.col("n_dropped") == 0, text).otherwise(kept))
            .drop("_ld_id", "_ld_text_hash", "_ld_dropped", "_ld_lines"))
