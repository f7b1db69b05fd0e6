"""Joins and rankings that hold when one key carries a large share of the rows.

A first pass counts rows per key with map-side combine and keeps the few keys above a
threshold. Rows of those keys are spread over many tasks; all others take the plain plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with more rows than this is spread; a task can sort this many without help.
HOT_ROWS = 2_000_000
# Bound on the spread keys, hence on what is broadcast. Keys beyond it (the least hot ones)
# take the plain plan, which is slower for them but gives the same rows.
MAX_HOT_KEYS = 1_000
MAX_PINNED_ROWS = 10_000


def pin_small(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame | None:
    """``df`` evaluated into a local relation, or None when it has more than ``max_rows`` rows."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, hottest first, at most MAX_HOT_KEYS; None if there are none."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    hottest = counted.orderBy(F.desc("__n"), *keys).limit(MAX_HOT_KEYS).select(*keys)
    pinned = pin_small(hottest, MAX_HOT_KEYS)
    return None if pinned is None or pinned.isEmpty() else pinned


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    hot_rows: int = HOT_ROWS,
    salts: int = 64,
    known: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """``big`` joined to ``small`` on ``on``; hot keys of ``big`` are salted by the ``spread`` columns.

    ``known`` passes hot keys that were found before, so that they are not counted again.
    """
    hot = known[0] if known else hot_keys(big, on, hot_rows)
    if hot is None:
        return big.join(small, on, how)
    flags = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = big.join(flags, on, "left").withColumn("__salt", salt).drop("__hot")
    copies = small.join(flags, on, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return salted.join(copies, on + ["__salt"], how).drop("__salt")


def _at_or_after(order: list[tuple[str, bool]], bound) -> Column:
    """Whether a row sorts at or after ``bound`` in the given column directions."""
    result = F.lit(True)
    for name, ascending in reversed(order):
        column, value = F.col(name), F.lit(bound[name])
        beyond = column > value if ascending else column < value
        result = beyond | ((column == value) & result)
    return result


def _slice_number(order: list[tuple[str, bool]], bounds: list) -> Column:
    """Index of the slice a row falls into, found by binary search over the sorted bounds."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_at_or_after(order, bounds[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(bounds))


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    out: str,
    hot_rows: int = HOT_ROWS,
    max_slices: int = 512,
    known: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """Row number (from 1) of each row within its ``keys`` group, as a window would give it.

    ``order`` holds (column, ascending) pairs that are unique within a group and not null; no
    keys at all ranks the whole table. A hot group is cut into slices of its order at sampled
    bounds: each slice is numbered alone, then shifted by the size of the slices before it.
    Any bounds give the same numbers; they only decide how even the slices are.
    """
    sorting = [F.asc(c) if up else F.desc(c) for c, up in order]
    if not keys:
        ranked = rank_in_group(df.withColumn("__all", F.lit(0)), ["__all"], order, out, hot_rows, max_slices)
        return ranked.drop("__all")
    hot = known[0] if known else hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*sorting)).cast("bigint"))

    columns = [c for c, _ in order]
    hot_part = df.join(F.broadcast(hot), keys, "left_semi")
    slices = min(max_slices, max(2, -(-hot_part.count() // hot_rows) * 2))
    sample = hot_part.select(*columns).orderBy(F.xxhash64(*columns)).limit(slices * 20)
    ordered = sample.distinct().orderBy(*sorting).collect()
    step = max(1, len(ordered) // slices)
    bounds = ordered[step::step]

    flagged = df.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    number = F.when(F.col("__hot"), _slice_number(order, bounds)).otherwise(F.lit(0))
    sliced = flagged.withColumn("__slice", number)
    sizes = sliced.where("__hot").groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__slice_rows"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_HOT_KEYS * max_slices rows.
    shifts = sizes.select(*keys, "__slice", F.coalesce(F.sum("__slice_rows").over(before), F.lit(0)).alias("__shift"))
    within = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*sorting))
    return (
        sliced.join(F.broadcast(shifts), keys + ["__slice"], "left")
        .withColumn(out, (within + F.coalesce(F.col("__shift"), F.lit(0))).cast("bigint"))
        .drop("__hot", "__slice", "__shift")
    )


def distinct_lengths(df: DataFrame, column: str) -> list[int]:
    """The lengths the strings of a column have: k different ones take k * k / 2 characters or more, so they are few."""
    found = df.select(F.length(column).alias("n")).distinct().orderBy("n").collect()
    return [row["n"] for row in found if row["n"]]


def length_array(lengths: list[int]) -> Column:
    """Lengths as one literal of the plan, however many there are."""
    return F.from_json(F.lit(str(lengths)), "array<int>")


def any_of(conditions: list[Column]) -> Column:
    """Disjunction as a balanced tree, so that long lists stay shallow."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [reduce(lambda a, b: a | b, pair) for pair in pairs]
    return conditions[0]
