"""Finding restaurants by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.sources.staging import staged


def display_name() -> Column:
    """``name (address)``; NULL when either part is missing."""
    return F.concat(F.col("name"), F.lit(" ("), F.col("address"), F.lit(")"))


def search(business: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Restaurants whose name starts with ``text`` in any case, first ``limit`` by name.

    The text is taken literally: ``%`` and ``_`` have no special meaning.
    """
    wanted = F.lower(F.lit(text))
    return (business.where(F.lower("name").startswith(wanted))
            .select(display_name().alias("name"), "id")
            .orderBy("name", "id").limit(limit))


def full_list(business: DataFrame) -> DataFrame:
    return business.select(display_name().alias("restaurant"), F.col("id").alias("restaurant_id"))


def folded_names(business: DataFrame, folder: str | None = None) -> DataFrame:
    """``folded, name, id``: display names in the order of their folded business names, stored.

    Files and their row groups hold ranges of folded names, whose bounds the files carry.
    """
    folded = business.select(F.lower("name").alias("folded"), display_name().alias("name"), "id")
    in_order = folded.repartitionByRange("folded", "id").sortWithinPartitions("folded", "id")
    return staged(in_order, "folded", folder)


def after_prefix(prefix: str) -> str | None:
    """The smallest text above all texts that begin with the prefix, in the order of code points."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        if code == 0xD800:  # code points of surrogates stand in no text
            code = 0xE000
        if code <= 0x10FFFF:
            return prefix[:at] + chr(code)
    return None


def search_folded(folded: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """As :func:`search`, over :func:`folded_names`: a range of it, not a scan of all names."""
    prefix = folded.sparkSession.sql("SELECT lower(:text)", args={"text": text}).first()[0]
    rows = folded.where(F.col("folded") >= prefix)
    end = after_prefix(prefix)
    rows = rows if end is None else rows.where(F.col("folded") < end)
    return rows.select("name", "id").orderBy("name", "id").limit(limit)
