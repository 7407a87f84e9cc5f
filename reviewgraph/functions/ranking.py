"""Per-key top-k and joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# About how many rows one slice of a key may make in a join.
SLICE_ROWS = 1_000_000
# About how many joined rows a task that sorts them by seed should hold.
TASK_ROWS = 1_500_000
# About how many rows a list holds that is one of several of its key.
LIST_ROWS = 4096
# Types of whole numbers that are narrower than bigint, with their bits.
WHOLE_NUMBERS = (("tinyint", 8), ("smallint", 16), ("int", 32))
# The bits of a bigint that hold digits, and the most such numbers a group carries.
DIGIT_BITS = 62
MOST_SUMS = 8
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
                position: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    Up to the session's group limit, Spark cuts every group to ``k`` rows inside the map tasks,
    so that a hot key sends only ``k`` rows per task through the shuffle.
    """
    name = position or "_position"
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return ranked if position else ranked.drop(name)


def cap_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column],
             cap: int | None) -> DataFrame:
    """First ``cap`` rows per key where most keys have fewer; all of them without a cap.

    A limit inside the map tasks would sort all rows once more and drop next to none, so the
    condition is written in a way that does not ask for it.
    """
    if cap is None:
        return df
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_position", position).where(
        F.lit(cap) - F.col("_position") >= 0).drop("_position")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None,
          position: str | None = None) -> DataFrame:
    """First ``k`` rows per key, for keys of any size; all rows without a ``k``.

    Raises the session's group limit where it is below ``k``, so that hot keys are cut inside
    the map tasks.
    """
    if k is None:
        return df
    session = df.sparkSession
    if k > int(session.conf.get(GROUP_LIMIT, "1000")):
        session.conf.set(GROUP_LIMIT, str(k))
    return rank_within(df, by, order, k, position)


def clip(df: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int,
         inclusive: bool = True) -> DataFrame:
    """The first rows per key with their ``position`` from 1 on.

    ``limit`` counts from 0 and names the last row, kept if ``inclusive``.
    """
    return rank_within(df, by, order, limit + 1 if inclusive else limit, "position")


def spread_join(many: DataFrame, matched: DataFrame, key: str, spread: str,
                per_key: int | None = None, slice_rows: int = SLICE_ROWS, *,
                also: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key`` in which no task has to expand a hot key.

    A key makes as many rows as its rows on both sides multiplied (``per_key`` bounds the side
    of ``matched``; without it they are counted). Keys with more than ``slice_rows`` are cut into
    slices by the hash of ``spread``, and their rows of ``matched`` are repeated for each slice.
    The number of slices follows the rows that come out, so a slice stays as large at any size.
    There is at most one hot key for each ``slice_rows`` rows made, so these few are broadcast and
    neither side moves to be cut. ``also`` names further columns to join on; ``counted`` has the
    keys of ``many``, where that is costly to make twice.
    """
    made = (many if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_rows"))
    if per_key is None:
        each = matched.groupBy(key).agg(F.count(F.lit(1)).alias("_each"))
        made = made.join(each, key)
    else:
        made = made.withColumn("_each", F.lit(per_key))
    hot = F.broadcast(
        made.withColumn("_slices", F.ceil(F.col("_rows") * F.col("_each") / slice_rows))
        .where(F.col("_slices") > 1).select(key, "_slices"))
    first = F.lit(0).cast("bigint")
    left = (many.join(hot, key, "left")
            .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_slices")), first))
            .drop("_slices"))
    right = (matched.join(hot, key, "left")
             .withColumn("_slice", F.explode(F.sequence(
                 first, F.coalesce(F.col("_slices") - 1, first))))
             .drop("_slices"))
    return left.join(right, [key, *also, "_slice"]).drop("_slice")


def made_rows(many: DataFrame, matched: DataFrame, key: str,
              each: Column | None = None) -> int:
    """How many rows an inner join on ``key`` makes; ``each`` counts those of ``matched``."""
    each = F.count(F.lit(1)) if each is None else each
    counts = [df.groupBy(key).agg(n.cast("double").alias(name)) for df, n, name in (
        (many, F.count(F.lit(1)), "_rows"), (matched, each, "_each"))]
    found = counts[0].join(counts[1], key).agg(F.sum(F.col("_rows") * F.col("_each"))).first()
    return int(found[0] or 0)


def listed(df: DataFrame, key: str) -> DataFrame:
    """One row per key, which has a bounded number of rows: the other columns as ``_list``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("_list"))


def listed_in_parts(df: DataFrame, key: str, most: int = LIST_ROWS) -> DataFrame:
    """As :func:`listed`, for keys of any size: one with more than ``most`` rows has several lists
    of about that length."""
    slices = F.ceil(F.col("_rows") / most)
    large = F.broadcast(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
                        .where(F.col("_rows") > most).select(key, slices.alias("_slices")))
    rest = [c for c in df.columns if c != key]
    part = F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_slices")), F.lit(0).cast("bigint"))
    return (df.join(large, key, "left").groupBy(key, part.alias("_part"))
            .agg(F.collect_list(F.struct(*rest)).alias("_list")).drop("_part"))


def narrow_types(lists: DataFrame) -> dict[str, str]:
    """The narrowest type that holds all values, for each field of ``_list`` of whole numbers.

    Reads the lists, which should be written, once.
    """
    wide = [f.name for f in lists.schema["_list"].dataType.elementType if f.dataType == LongType()]
    if not wide:
        return {}
    ends = lists.select(*[F.min(F.array_min(F.col("_list")[f])).alias(f"low_{f}") for f in wide],
                        *[F.max(F.array_max(F.col("_list")[f])).alias(f"high_{f}") for f in wide]
                        ).first()

    def narrowest(low: int, high: int) -> str:
        return next((name for name, bits in WHOLE_NUMBERS
                     if -(1 << bits - 1) <= low and high < 1 << bits - 1), "bigint")

    return {f: narrowest(ends[f"low_{f}"] or 0, ends[f"high_{f}"] or 0) for f in wide}


def side_by_side(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """The fields of ``_list`` as an array each, which take the least room when rows move.

    ``types`` are those of :func:`narrow_types`.
    """
    types = types or {}
    arrays = [F.col("_list")[f].cast(f"array<{types[f]}>") if f in types else F.col("_list")[f]
              for f in df.schema["_list"].dataType.elementType.names]
    fields = df.schema["_list"].dataType.elementType.names
    return df.select(*[c for c in df.columns if c != "_list"],
                     F.struct(*[a.alias(f) for a, f in zip(arrays, fields)]).alias("_arrays"))


def unlisted(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each place of the arrays made by :func:`side_by_side`; whole numbers in
    ``types`` are bigint again."""
    fields = df.schema["_arrays"].dataType.names
    own = [c for c in df.columns if c != "_arrays"]
    rows = df.select(*own, "_arrays", F.posexplode(F.col("_arrays")[fields[0]]).alias(
        "_at", fields[0]))
    # read by their place: no object is made for a row
    others = [F.get(F.col("_arrays")[f], F.col("_at")).alias(f) for f in fields[1:]]
    return rows.select(*own, fields[0], *others).withColumns(
        {f: F.col(f).cast("bigint") for f in types or ()})


def dealt(df: DataFrame, by: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` moved by a key once, into as many tasks as its ``rows`` need to be sorted in memory.

    Windows and groups that include the key then follow without another exchange. A few rows are
    left to Spark, which puts small partitions together by their bytes: many rows that take little
    room while they move would not fit a task's memory.
    """
    tasks = -(-rows // task_rows)
    return df.repartition(*by) if tasks <= 1 else df.repartition(tasks, *by)


def rows_by(many: DataFrame, lists: DataFrame, key: str, by: str) -> DataFrame:
    """``by, _rows``: the rows that a join of ``many`` with the rows in ``lists`` makes."""
    sizes = lists.select(key, F.size("_list").cast("bigint").alias("_size"))
    return many.select(by, key).join(sizes, key).groupBy(by).agg(F.sum("_size").alias("_rows"))


def last_kept(rows: DataFrame, by: str, order: Sequence[Column], columns: Sequence[str],
              cap: int) -> DataFrame:
    """``by, _cut``: of keys with ``cap`` rows or more, the ``columns`` of the last one kept."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_position", place).where(F.col("_position") == cap).select(
        by, F.struct(*columns).alias("_cut"))


def up_to_cut(columns: Sequence[str]) -> Column:
    """Whether a row stands at ``_cut`` or before it; no cut keeps all.

    The order is the first column's, descending with nulls last, then the others', ascending.
    """
    first, *rest = columns
    value, cut = F.col(first), F.col("_cut")[first]
    before = F.coalesce(value > cut, value.isNotNull() & cut.isNull())
    ties = F.struct(*[F.col(c) for c in rest]) <= F.struct(
        *[F.col("_cut")[c].alias(c) for c in rest])
    return F.col("_cut").isNull() | before | (value.eqNullSafe(cut) & ties)


def digits_fit(places: int, bits: int) -> bool:
    """Whether :func:`digit_sums` may hold that many digits."""
    return bits <= DIGIT_BITS and -(-places // (DIGIT_BITS // bits)) <= MOST_SUMS


def digit_sums(place: str, digit: Column, places: int, bits: int) -> list[Column]:
    """Sums over a group that hold a digit above 0 for each of its places, 0 to ``places`` - 1.

    A group has a place at most once, so that whole numbers carry what would be a list: they are
    counted without an object for each group. ``bits`` hold one digit.
    """
    each = DIGIT_BITS // bits
    at = F.col(place)
    return [F.sum(F.when((at >= k) & (at < k + each), F.call_function(
        "shiftleft", digit.cast("bigint"), ((at - k) * bits).cast("int"))).otherwise(0))
        .alias(f"_digits{k // each}") for k in range(0, places, each)]


def digits(df: DataFrame, places: int, bits: int) -> DataFrame:
    """A row with ``place`` and ``digit`` for each digit in the sums of :func:`digit_sums`."""
    each = DIGIT_BITS // bits
    held = F.array(*[F.struct(F.lit(k).alias("place"), F.call_function(
        "shiftright", F.col(f"_digits{k // each}"), F.lit(k % each * bits)).bitwiseAND(
        F.lit((1 << bits) - 1).cast("bigint")).alias("digit")) for k in range(places)])
    rest = [c for c in df.columns if not c.startswith("_digits")]
    return df.select(*rest, F.inline(held)).where(F.col("digit") > 0)
