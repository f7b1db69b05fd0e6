"""Selections as text, markup, encoded rows and parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .skew import HOT_ROWS, rank_in_group, skew_join

MAX_PART_BYTES = 1_024_000
MAX_BROADCAST_SIZES = 2_000_000
# The formats of the exports.
IMAGE_TAG = '<img src="%s" alt="%s" />'
STYLE_RULE = """.emoji-%s {
  background-image: url('%s');
  background-size: contain;
  background-repeat: no-repeat;
  background-position: center;
}"""
TABLE_HEADING = "| Emoji | Filename |\n|---|---|"
TABLE_ROW = "| ![%s](%s) | %s |"


def _attribute(value: Column) -> Column:
    for plain, entity in [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")]:
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def export_text(selected: DataFrame) -> DataFrame:
    """Lines (user_id, place, line) of filenames; ``selected`` has user_id, place, id, filename, path."""
    return selected.select("user_id", "place", F.col("filename").alias("line"))


def export_html(selected: DataFrame, origin: str | None, escape: bool = True) -> DataFrame:
    source, name = N.absolute_url(F.col("path"), origin), F.col("filename")
    if escape:
        source, name = _attribute(source), _attribute(name)
    line = F.format_string(IMAGE_TAG, source, name)
    return selected.select("user_id", "place", line.alias("line"))


def export_css(selected: DataFrame, origin: str | None) -> DataFrame:
    """One rule per asset; the sink separates rules by a blank line."""
    rule = F.format_string(STYLE_RULE, F.col("id"), N.absolute_url(F.col("path"), origin))
    return selected.select("user_id", "place", rule.alias("line"))


def export_markdown(selected: DataFrame, origin: str | None) -> DataFrame:
    """Table rows, headed per user by a row with place -1."""
    name = F.col("filename")
    row = F.format_string(TABLE_ROW, name, N.absolute_url(F.col("path"), origin), name)
    lines = selected.select("user_id", "place", row.alias("line"))
    headings = selected.select("user_id").distinct().select(
        "user_id", F.lit(-1).cast("bigint").alias("place"), F.lit(TABLE_HEADING).alias("line")
    )
    return headings.unionByName(lines)


def export_bundle(selection: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of every selected file once (filename, content): the content of an archive."""
    wanted = selection.select(F.col("item_id").alias("id")).distinct()
    return files.join(wanted, "id", "left_semi").select("id", "filename", "content")


def bundle_manifest(bundle: DataFrame) -> DataFrame:
    return bundle.select("id", "filename", F.length("content").cast("bigint").alias("size_bytes"))


def base64_rows(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Encoded rows of (filename, content) for the accepted file endings."""
    name = F.col("filename")
    return files.where(N.has_extension(name, types or N.ENCODE_TYPES)).select(
        "filename",
        F.lower(N.extension_of(name)).alias("extension"),
        F.length("content").cast("bigint").alias("size_bytes"),
        N.mime_type(name).alias("mime_type"),
        # Spark breaks lines in long base64 output; the rows carry none.
        F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("base64"),
    )


# ---- parts of bounded size ----------------------------------------------------------------


def _size_plan(max_bytes: int):
    """Fold over (size, n), largest size first: where each size's rows fall among the parts.

    A part closes with the row that reaches the limit. Rows of one size fill parts evenly, so a
    size is one step however many rows it has: ``head`` rows end the open part, then every
    ``each`` rows make a part.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, filled = 1, 0
        for batch in batches:
            rows = []
            for size, n in zip(batch["size"].tolist(), batch["n"].tolist()):
                if size <= 0:
                    rows.append((size, part, n + 1, 1))
                    continue
                head, each = -(-(max_bytes - filled) // size), -(-max_bytes // size)
                rows.append((size, part, head, each))
                if n < head:
                    filled += n * size
                else:
                    closed, rest = divmod(n - head, each)
                    part, filled = part + 1 + closed, rest * size
            yield pd.DataFrame(rows, columns=["size", "part", "head", "each"])

    return run


def pack_by_size(
    files: DataFrame, max_bytes: int = MAX_PART_BYTES, order: list[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``part``: rows from the largest down, a part closing with the row that reaches the limit.

    ``files`` has size and the ``order`` columns, unique together, that break ties. The fold runs
    over distinct sizes below the limit only (fewer than ``max_bytes`` of them, however large the
    table); a row's part then follows from its number among rows of its size.
    """
    order = order or ["filename"]
    if not max_bytes:
        return files.withColumn("part", F.lit(1).cast("bigint"))
    sizes = F.least(F.col("size").cast("bigint"), F.lit(max_bytes).cast("bigint"))
    capped = files.withColumn("__size", sizes)
    counts = capped.groupBy(F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # Counted in parallel; only the finished counts meet in one task.
    plan = counts.repartition(1).sortWithinPartitions(F.desc("size")).mapInPandas(
        _size_plan(max_bytes), "size bigint, part bigint, head bigint, each bigint"
    )
    by = ([("size", False)] if "size" not in order else []) + [(c, True) for c in order]
    ranked = rank_in_group(capped, ["__size"], by, "__number", hot_rows)
    plan = plan.withColumnRenamed("size", "__size")
    # The plan has at most max_bytes + 1 rows of 32 bytes.
    if max_bytes <= MAX_BROADCAST_SIZES:
        joined = ranked.join(F.broadcast(plan), "__size")
    else:
        joined = skew_join(ranked, plan, ["__size"], "inner", order, hot_rows)
    later = F.col("part") + 1 + F.floor((F.col("__number") - 1 - F.col("head")) / F.col("each"))
    part = F.when(F.col("__number") <= F.col("head"), F.col("part")).otherwise(later)
    return joined.withColumn("part", part.cast("bigint")).drop("__size", "__number", "head", "each")
