"""Debounced search terms from a stream of keystrokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def settled_terms(keystrokes: DataFrame, gap_ms: int = 300, lateness: str = "10 seconds") -> DataFrame:
    """(user_id, ts, term): the last keystroke of every burst, a burst ending with a quiet gap.

    ``keystrokes`` has user_id, ts, seq, term. Later ones than ``lateness`` are dropped.
    """
    # Session windows that just touch are merged; a keystroke exactly at the gap is to start anew.
    gap = f"{gap_ms * 1000 - 1} microseconds"
    timed = keystrokes.withColumn("ts", F.col("ts").cast("timestamp"))
    watched = timed.withWatermark("ts", lateness)
    bursts = watched.groupBy("user_id", F.session_window("ts", gap).alias("burst"))
    last = bursts.agg(F.max(F.struct("ts", "seq", "term")).alias("last"))
    return last.select("user_id", "last.ts", "last.term")


def write_settled(terms: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        terms.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_terms(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, ts, term): the last keystroke so far of every burst that the stream has not ended yet, read from its state."""
    return spark.read.format("statestore").load(checkpoint).select("value.user_id", "value.max.ts", "value.max.term")


def read_settled(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """What a stream has written; with its ``checkpoint`` also the bursts at its end, for a stream that goes on no further."""
    written = spark.read.schema("user_id bigint, ts timestamp, term string").parquet(path)
    return written if checkpoint is None else written.unionByName(open_terms(spark, checkpoint))
