"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage reads all rows that its predecessor kept. All but the last return the columns of
documents, further ones included, whatever their names.

Defined results: a null text, or one without a letter, has no language and goes in the first
stage. Stages that decide about documents by their id keep rows without one. Repeated rows with one
id are one document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgraph.llm import bpe, language_id
from reviewgraph.llm.decontamination import benchmark_leaks
from reviewgraph.llm.jaccard_join import jaccard_components
from reviewgraph.llm.line_dedup import drop_repeated_lines
from reviewgraph.llm.queries import table, tokenizer_path
from reviewgraph.llm.store import stored

# Near-duplicates share this much of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def _column(name: str, of: str = "") -> Column:
    """The column of this very name, dots and backticks included; or the field of a struct."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def _all_columns(docs: DataFrame) -> list[Column]:
    return [_column(c) for c in docs.columns]


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, whose names cannot clash with those of results."""
    return docs.select("doc_id", "text", F.struct(*_all_columns(docs)).alias("_row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identification does not reject."""
    model = language_id.train_on(docs)
    told = language_id.predict(_packed(docs), model, keep=("_row",))
    return told.where(~F.col("rejected")).select("_row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated across documents; n_chars follows the text."""
    out = drop_repeated_lines(_packed(docs))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.length("kept_text").cast("long"))
           .otherwise(F.col("_row.n_chars"))}
    return out.select(*[new.get(c, _column(c, "_row")).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates; rows without an id stay."""
    groups = jaccard_components(docs, size=SHINGLE, percent=PERCENT)
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*_all_columns(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no benchmark item in them."""
    leaks = benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*_all_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left."""
    tokens = bpe.encode(docs, tokenizer_path())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

# Language identification and subword merging are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
