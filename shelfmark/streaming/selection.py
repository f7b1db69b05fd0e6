"""Selections kept up to date from a stream of events, in keyed state.

State is held per user and bucket of items, so that one busy user spreads over several tasks: a toggle goes to the
bucket of its item, an event that replaces the selection to all buckets. Each key holds the selection up to the
watermark and, apart from it, the events behind the watermark, which may still be joined by earlier ones. Timers of event
time fold events into the selection once nothing earlier can come. Every batch emits the selections of the keys it
touches, with the open events folded in by their time; a folder per batch holds them, and a repeated batch replaces its
own folder. Reading takes each key's newest rows and orders them per user as the batch operator does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.selection import RESET, SELECT_ALL, TOGGLE
from ..operators.skew import HOT_ROWS, rank_in_group

# Keys per user. A stream keeps the number it was started with.
BUCKETS = 8
# How long after the latest event an earlier one is still taken in.
LATENESS = "1 day"

# A selected item: where the replacing event put it, or when its last toggle moved it behind those.
ROW = "item_id string, moved int, place bigint, at bigint, seq bigint"
STATE_SCHEMA = f"user_id bigint, bucket int, {ROW}, batch_id bigint, is_full boolean"
STATE = (
    "settled array<struct<item_id:string,moved:int,place:bigint,at:bigint,seq:bigint>>, "
    "open array<struct<at:bigint,seq:bigint,op:string,item_id:string,members:array<struct<place:bigint,item_id:string>>>>"
)

Items = dict[str, list[tuple[int, int, int, int]]]


def fold_events(items: Items, events: list[tuple]) -> Items:
    """The selected ``items`` of a key (rows of moved, place, at, seq by item) after ``events`` in their order.

    An item named twice in a replacing list stays twice until it is toggled.
    """
    for at, seq, op, item, members in events:
        if op == TOGGLE:
            if items.pop(item, None) is None:
                items[item] = [(1, 0, at, seq)]
        else:
            items = {}
            for place, name in members:
                items.setdefault(name, []).append((0, place, 0, 0))
    return items


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["item_id", "moved", "place", "at", "seq"])
    frame.insert(0, "bucket", key[1])
    frame.insert(0, "user_id", key[0])
    return frame


def update_key(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's step: take in new events and emit its selection, or at its timer settle what the watermark has passed.

    The state is two lists: what is selected up to the watermark, and the events that are still open.
    """
    settled, known = state.get if state.exists else ([], [])
    items: Items = {}
    for item, *row in settled:
        items.setdefault(item, []).append(tuple(row))
    events = [(at, seq, op, item, [tuple(m) for m in members or []]) for at, seq, op, item, members in known]
    fresh = []
    for part in parts:
        for at, seq, op, item, members in zip(*(part[c] for c in ("at", "seq", "op", "item_id", "members"))):
            fresh.append((int(at), int(seq), op, item, [(m["place"], m["item_id"]) for m in members] if members is not None else []))
    events = sorted([*events, *fresh], key=lambda e: e[:2])
    until = state.getCurrentWatermarkMs() * 1000
    past = next((i for i, e in enumerate(events) if e[0] > until), len(events))
    items, events = fold_events(items, events[:past]), events[past:]
    state.update(([(item, *row) for item, held in items.items() for row in held], events))
    if events:
        # The watermark has to pass the last open event, by whole milliseconds.
        state.setTimeoutTimestamp(events[-1][0] // 1000 + 1)
    if fresh:
        items = fold_events(items, events)
        # A row without an item says that the key was written, even if nothing is selected.
        yield _frame(key, [(None, 0, 0, 0, 0), *((item, *row) for item, held in items.items() for row in held)])


def keyed_events(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Events (user_id, ts, seq, op, item_id, items) per bucket: toggles once, replacing events for each bucket with its items."""
    bucket_of = lambda item: F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")
    wanted = events.where(((F.col("op") == TOGGLE) & F.col("item_id").isNotNull()) | F.col("op").isin(SELECT_ALL, RESET))
    every = F.when(F.col("op") == TOGGLE, F.array(bucket_of(F.col("item_id")))).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))
    placed = F.transform("items", lambda item, i: F.struct(i.cast("bigint").alias("place"), item.alias("item_id")))
    own = F.filter(placed, lambda m: m["item_id"].isNotNull() & (bucket_of(m["item_id"]) == F.col("bucket")))
    timed = wanted.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("bucket", F.explode(every))
    return timed.select(
        "user_id", "bucket", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("bigint").alias("seq"), "op", "item_id",
        F.when(F.col("op") == SELECT_ALL, own).alias("members"),
    )


def selection_rows(events: DataFrame, buckets: int = BUCKETS, lateness: str = LATENESS) -> DataFrame:
    """The streamed selections: all rows of a key (user_id, bucket) whenever events change it."""
    keyed = keyed_events(events, buckets).withWatermark("ts", lateness)
    return keyed.groupBy("user_id", "bucket").applyInPandasWithState(update_key, f"user_id bigint, bucket int, {ROW}", STATE, "update", "EventTimeTimeout")


def _versions(spark: SparkSession, table: str, before: int | None) -> DataFrame:
    try:
        rows = spark.read.schema(STATE_SCHEMA).parquet(table)
        rows.schema
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], STATE_SCHEMA)
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    # Batches older than the last complete one are not needed.
    complete = rows.where("is_full").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).scalar()
    return rows.where(F.col("batch_id") >= complete)


def current_rows(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """Newest rows per key, the ones without an item included."""
    rows = _versions(spark, table, before)
    newest = rows.groupBy("user_id", "bucket").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["user_id", "bucket", "batch_id"])


def read_selection(spark: SparkSession, table: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(user_id, place, item_id): each user's selection, in selection order."""
    rows = current_rows(spark, table).where("item_id is not null").withColumnRenamed("place", "__place")
    by = [("moved", True), ("__place", True), ("at", True), ("seq", True), ("item_id", True)]
    return rank_in_group(rows, ["user_id"], by, "place", hot_rows).select("user_id", "place", "item_id")


def write_batch(rows: DataFrame, table: str, batch_id: int, full: bool = False) -> None:
    """Write what a batch emitted; with ``full`` also the newest rows of all other keys, so that older folders can go."""
    kept = [c.split()[0] for c in f"user_id bigint, bucket int, {ROW}".split(", ")]
    rows = rows.select(*kept)
    if full:
        rows.persist()
        others = current_rows(rows.sparkSession, table, before=batch_id).select(*kept)
        written = rows.unionByName(others.join(rows.select("user_id", "bucket").distinct(), ["user_id", "bucket"], "left_anti"))
    else:
        written = rows
    written.withColumn("is_full", F.lit(full)).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
    rows.unpersist()


def selection_stream(
    events: DataFrame, table: str, checkpoint: str, full_every: int = 50, buckets: int = BUCKETS, lateness: str = LATENESS
) -> StreamingQuery:
    """Start keeping ``table`` up to date from streamed events, until what is available is applied.

    Events of any order are taken in; those older than the watermark, ``lateness`` behind the latest event of the
    batches before, are dropped.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, table, batch_id, full=batch_id % full_every == full_every - 1)

    return (
        selection_rows(events, buckets, lateness).writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
