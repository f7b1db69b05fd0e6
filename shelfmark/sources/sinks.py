"""Writing catalogs, search tables and rendered exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.catalog import stat_columns


def by_filename() -> list:
    """The order of a catalog: by filename as people sort it, equal ones by code point."""
    return [F.collate("filename", "UNICODE"), F.col("filename")]


def _counted(rows: DataFrame, *totals) -> tuple[DataFrame, Observation]:
    """``rows`` and what will hold their totals once they are written: taken from the rows on their way, not from a second pass."""
    seen = Observation()
    return rows.observe(seen, *totals), seen


def write_catalog(catalog: DataFrame, path: str, json: bool = False) -> dict:
    """Store records in filename order, sorted across files by range, with their stats beside them. Gives the stats."""
    ordered, seen = _counted(catalog.orderBy(*by_filename()), *stat_columns())
    if json:
        ordered.write.mode("overwrite").json(f"{path}/records")
    else:
        ordered.write.mode("overwrite").parquet(f"{path}/records")
    stats = dict(seen.get)
    row = catalog.sparkSession.createDataFrame([tuple(stats.values())], "total bigint, last_updated timestamp, labelled bigint")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return stats


def stored_order(rows: DataFrame) -> DataFrame:
    """Add file and row, the place of each row of a stored table: files are named in the order of their ranges."""
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def write_search_table(documents: DataFrame, path: str) -> None:
    """Store a document table for lookups by day and id: one folder per day, ids sorted within files."""
    ranged = documents.repartitionByRange("created", "id").sortWithinPartitions("created", "id")
    (
        ranged.write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("created")
        .parquet(path)
    )


def write_encoded(rows: DataFrame, path: str, by_part: bool = False) -> dict:
    """Encoded rows as JSON lines; rows packed into parts lie together, part after part. Gives how many rows and bytes they are."""
    if by_part:
        rows = rows.repartitionByRange("part", "filename").sortWithinPartitions("part", F.desc("size_bytes"), "filename")
    rows, seen = _counted(rows, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    rows.write.mode("overwrite").json(path)
    return dict(seen.get)


def write_bundle(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str, separator: str = "\n") -> None:
    """Rendered lines (user_id, place, line) as text, in order, one folder per user.

    Meant for the users whose selections are exported, not for all users there are: those stay a
    table.
    """
    ranged = lines.repartitionByRange("user_id", "place").sortWithinPartitions("user_id", "place")
    ranged.select("user_id", F.col("line").alias("value")).write.mode("overwrite").option(
        "lineSep", separator
    ).partitionBy("user_id").text(path)
