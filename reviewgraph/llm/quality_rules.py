"""Rules on words and lines, and the divergence of a document from its language's habits.

Each document becomes two histograms: character classes, and its language's most common words
against all other words. The references are the same histograms summed over all documents of the
language. A document fails if the Jensen-Shannon distance (base 2, 0 to 1) to either reference is
too large; short documents hold too little for the comparison and pass it.

All of it is built-in column functions. Windows of five words are hashed and sorted inside the
row; the only words that are shuffled are counts of a language's words, summed before that.

Defined results: a null text counts as empty and fails the base rules. A null language, or one
whose documents have no words, has no reference: the base rules decide alone. Rows are judged one
by one, so that repeated rows give repeated results. Only id, text and language are read; other
columns do not go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewgraph.llm.store import stored
from reviewgraph.llm.words import SPACE, lines_of, words_of

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
COMMON_WORDS = 16
# Documents with fewer words are not compared with the references.
COMPARED_WORDS = 50
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
# The symbols of the base rules, and sentence marks; what is in no class but letters.
PLAIN = "[a-z ]+"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[.,;:!?'\"()-]"


def _count(text: Column, of_class: str) -> Column:
    """How many characters of a class a text has."""
    return (F.length(text) - F.length(F.regexp_replace(text, of_class, ""))).cast("long")


def _window_hashes(words: Column) -> Column:
    """A hash for each window of five words, in order (words: hashes of single words)."""
    last = F.size(words) - WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _hash_places(hashes: Column) -> Column:
    """(hash, place), sorted: equal windows are neighbours."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_starts(places: Column) -> Column:
    """Sorted starts of windows that occur twice or more."""
    def like(p: Column, k: Column) -> Column:
        return F.coalesce(F.get(places, k)["h"] == p["h"], F.lit(False))

    again = F.filter(places, lambda p, k: ((k > 0) & like(p, F.greatest(k - 1, F.lit(0))))
                     | like(p, k + 1))
    return F.array_sort(F.transform(again, lambda p: p["i"]))


def _covered_words(starts: Column) -> Column:
    """How many words the windows at these sorted starts cover together."""
    own = F.transform(starts, lambda s, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))).cast("long"))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, base 2, of two arrays of shares."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 n: int = COMMON_WORDS) -> DataFrame:
    """lang, common_words and word_ref of every language: its n commonest words and their shares.

    word_ref has one more share, for all other words. Ties go to the word that sorts first.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.explode(words_of(F.col(text_col))).alias("word"))
    # Words are summed in the map tasks before they move.
    counts = stored(rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    first = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(
        F.struct("rank", "word", "n"))).alias("top"))
    own = F.transform("top", lambda x: x["n"])
    rest = F.col("total") - F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)
    return (lists.join(totals, "lang")
            .select("lang", F.transform("top", lambda x: x["word"]).alias("common_words"),
                    _shares(F.concat(own, F.array(rest))).alias("word_ref")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", words: DataFrame | None = None) -> DataFrame:
    """Counts and histograms of each row, without its text."""
    # A small stored table: Spark broadcasts it by its size, or else shuffles.
    words = stored(common_words(docs, text_col, lang_col)) if words is None else words
    words = words.withColumn("longest", F.array_max(F.transform("common_words", F.length)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = (rows.join(words, "lang", "left")
            .withColumn("words", words_of(F.col("text")))
            .withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("hashes", _window_hashes(F.col("word_hashes")))
            .withColumn("repeats", F.size("hashes") > F.size(F.array_distinct("hashes")))
            .withColumn("places", F.when(F.col("repeats"), _hash_places(F.col("hashes"))))
            .withColumn("starts", F.when(F.col("repeats"), _repeated_starts(F.col("places"))))
            .withColumn("lines", F.filter(lines_of(F.col("text")),
                                          lambda x: F.btrim(x, F.lit(SPACE)) != ""))
            .withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
            .withColumn("rare", F.regexp_replace("text", PLAIN, ""))
            .withColumn("n_symbols", _count(F.col("rare"), SYMBOLS))
            .withColumn("found", F.filter("words", lambda w: (
                F.length(w) <= F.col("longest")) & F.array_contains(F.col("common_words"), w))))
    classes = [F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"),
               _count(F.col("rare"), "[A-Z]"), _count(F.col("rare"), "[0-9]"),
               _count(F.col("rare"), MARKS),
               (F.octet_length("text") - F.length("text")).cast("long")]
    rows = rows.withColumn("classes", F.array(*classes))
    rest = F.col("n_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    own = F.transform("common_words", lambda w: F.size(F.filter(
        "found", lambda x: x == w)).cast("long"))
    return rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered_words(F.col("starts")))
        .otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.concat("classes", F.array(F.greatest(rest, F.lit(0).cast("long")))).alias("classes"),
        F.concat(own, F.array((F.size("words") - F.size("found")).cast("long"))).alias("uses"),
        "word_ref")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE,
                  max_word_distance: float = MAX_WORD_DISTANCE,
                  compared_words: int = COMPARED_WORDS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the distances char_distance and word_distance.

    base_failed: fewer than 10 words, or over 20 % of them in repeated windows of five.
    """
    rows = stored(measured(docs, id_col, text_col, lang_col))
    n = 7
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(n)]
    refs = (rows.where(F.col("lang").isNotNull()).groupBy("lang").agg(*sums)
            .select("lang", _shares(F.array(*[f"c{k}" for k in range(n)])).alias("char_ref")))
    far = (F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False))
           | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False)))
    return (rows.join(refs, "lang", "left")
            .withColumn("char_distance", jensen_shannon(_shares(F.col("classes")),
                                                        F.col("char_ref")))
            .withColumn("word_distance", jensen_shannon(_shares(F.col("uses")),
                                                        F.col("word_ref")))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed")
                        & ((F.col("n_words") < compared_words) | ~far))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "lang", "char_distance",
                    "word_distance"))
