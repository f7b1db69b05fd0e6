"""Selections per user, folded from an event log, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import HOT_ROWS, rank_in_group, skew_join

TOGGLE, SELECT_ALL, RESET = "TOGGLE_SELECTION", "SELECT_ALL", "RESET_SELECTION"


def fold_selection(
    events: DataFrame,
    payloads: DataFrame | None = None,
    start: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(user_id, place, item_id): each user's selection after all events, in selection order.

    ``events`` has user_id, ts, seq, op, item_id, items and is ordered by (ts, seq). Long
    SELECT_ALL lists come as rows of ``payloads`` (user_id, seq, place, item_id) instead of in
    ``items``. ``start`` (user_id, place, item_id) is what was selected before.

    No step walks through a user's events. The last replacing event decides the base; an item is
    selected if it is in the base xor toggled an odd number of times since; an item toggled
    since then moves to where its last toggle put it. Counting combines before the shuffle.
    """
    at = F.struct("ts", "seq")
    base = events.where(F.col("op").isin(SELECT_ALL, RESET)).groupBy("user_id").agg(
        F.max(at).alias("__base"), F.max_by(F.struct("op", "items"), at).alias("__set")
    )
    toggles = events.where((F.col("op") == TOGGLE) & F.col("item_id").isNotNull()).select(
        "user_id", "item_id", "seq", at.alias("__at")
    )
    since = skew_join(toggles, base.select("user_id", "__base"), ["user_id"], "left", ["seq"], hot_rows)
    since = since.where(F.col("__base").isNull() | (F.col("__at") > F.col("__base")))

    replaced = base.where(F.col("__set.op") == SELECT_ALL)
    members = replaced.select("user_id", F.posexplode("__set.items").alias("place", "item_id"))
    if payloads is not None:
        last = replaced.select("user_id", F.col("__base.seq").alias("seq"))
        members = members.unionByName(payloads.join(last, ["user_id", "seq"]).select("user_id", "place", "item_id"))
    if start is not None:
        kept = start.join(base.select("user_id"), "user_id", "left_anti")
        members = members.unionByName(kept.select("user_id", "place", "item_id"))

    kind = dict(since.dtypes)["__at"]
    rows = members.select(
        "user_id", "item_id", F.col("place").cast("bigint").alias("place"), F.lit(None).cast(kind).alias("__at")
    ).unionByName(since.select("user_id", "item_id", F.lit(None).cast("bigint").alias("place"), "__at"))
    items = rows.groupBy("user_id", "item_id").agg(
        F.array_sort(F.collect_list("place")).alias("places"),
        F.count("__at").alias("toggles"),
        F.max("__at").alias("last"),
    )
    odd = F.col("toggles") % 2 == 1
    selected = items.where((F.size("places") > 0) != odd)
    moved = F.col("toggles") > 0
    # An item named twice in a replacing list stays twice until it is toggled.
    placed = selected.withColumn(
        "__place", F.explode(F.when(moved, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("places")))
    )
    ordered = placed.select(
        "user_id", "item_id", moved.cast("int").alias("__moved"), "__place",
        F.coalesce(F.unix_micros(F.col("last.ts").cast("timestamp")), F.lit(0)).alias("__ts"),
        F.coalesce(F.col("last.seq"), F.lit(0)).alias("__seq"),
    )
    by = [("__moved", True), ("__place", True), ("__ts", True), ("__seq", True), ("item_id", True)]
    return rank_in_group(ordered, ["user_id"], by, "place", hot_rows).select("user_id", "place", "item_id")


def selection_snapshot(writes: DataFrame, default: str = "[]") -> DataFrame:
    """The last stored selection per key, parsed; what cannot be read becomes the default.

    ``writes`` has key, ts, seq, payload (a JSON list of ids).
    """
    latest = writes.groupBy("key").agg(F.max_by("payload", F.struct("ts", "seq")).alias("payload"))
    parsed = F.from_json("payload", "array<string>")
    return latest.select("key", F.coalesce(parsed, F.from_json(F.lit(default), "array<string>")).alias("items"))


def select_all_visible(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """The shown hits as the rows of a SELECT_ALL payload, in their order."""
    return hits.select("query_id", (F.col(rank) - 1).alias("place"), F.col("doc_id").cast("string").alias("item_id"))


def selection_size(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per user, how many assets are selected and how many kilobytes they hold."""
    sized = selection.join(catalog.select(F.col("id").alias("item_id"), "size"), "item_id")
    return sized.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_selected"), F.round(F.sum("size") / 1024, 1).alias("kilobytes")
    )


def recent_items(events: DataFrame, limit: int = 5) -> DataFrame:
    """Per user the items used last, newest first. Tasks keep only their own newest rows."""
    used = events.where("item_id is not null").groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "seq")).alias("at"))
    window = Window.partitionBy("user_id").orderBy(F.desc("at"), "item_id")
    ranked = used.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)
    return ranked.select("user_id", "place", "item_id", F.col("at.ts").alias("last_used"))


def debounce_terms(keystrokes: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Add ``searched``: the term if its user typed nothing newer within the gap, else null.

    Only the next keystroke matters, and only if it is near. So time is cut into spans at least
    as long as the gap; the next keystroke is in the same span, or the first of the following
    one, or too far away. One busy user thus spreads over many spans.
    """
    gap_us = gap_ms * 1000
    span_us = max(gap_us, 3_600_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = keystrokes.withColumn("__at", at).withColumn("__span", F.floor(at / span_us))
    starts = rows.groupBy("user_id", (F.col("__span") - 1).alias("__span")).agg(F.min("__at").alias("__following"))
    window = Window.partitionBy("user_id", "__span").orderBy("__at", "seq")
    following = F.coalesce(F.lead("__at").over(window), F.col("__following"))
    joined = rows.join(starts, ["user_id", "__span"], "left").withColumn("__next", following)
    quiet = F.col("__next").isNull() | (F.col("__next") - F.col("__at") >= gap_us)
    return joined.withColumn("searched", F.when(quiet, F.col("term"))).drop("__at", "__span", "__following", "__next")
