"""Words and lines as Spark columns; the white space is ASCII's only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space, as a set for trimming and as a regular expression class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words_of(text: Column) -> Column:
    """Runs of characters outside ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased, all else as it is; strings of ASCII alone take the faster function."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(
        F.translate(s, UPPER, LOWER))
