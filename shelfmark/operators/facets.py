"""Counts per filter value, and the order they are shown in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, rank_in_group


def facet_counts(hits: DataFrame) -> DataFrame:
    """Per query, filter and value: hits that pass the filters, and hits before filtering.

    ``hits`` has query_id, filters and passes. Counting combines before the shuffle, so a value
    that most documents carry costs no more than a rare one.
    """
    named = hits.select("query_id", "passes", F.explode("filters").alias("filter", "values"))
    valued = named.select("query_id", "passes", "filter", F.explode(F.array_distinct("values")).alias("value"))
    return valued.groupBy("query_id", "filter", "value").agg(
        F.count_if("passes").alias("n_filtered"), F.count(F.lit(1)).alias("n_total")
    )


def unfiltered_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(
        F.count_if("passes").alias("n_filtered"), F.count(F.lit(1)).alias("n_unfiltered")
    )


def index_facets(docs: DataFrame) -> DataFrame:
    """Counts over the whole index, as shown before any search."""
    every = docs.select(F.lit(0).alias("query_id"), "filters", F.lit(True).alias("passes"))
    return facet_counts(every).select("filter", "value", F.col("n_total").alias("n"))


def merge_facets(parts: list[DataFrame]) -> DataFrame:
    """Facets of several indexes summed per filter and value."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("query_id", "filter", "value").agg(
        F.sum("n_filtered").alias("n_filtered"), F.sum("n_total").alias("n_total")
    )


def facet_view(
    facets: DataFrame,
    totals: DataFrame,
    order: str | list[str] = "alphabetical",
    selected: list[str] | None = None,
    show_empty: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Facet rows as shown: an ``All`` row first, empty values hidden unless selected.

    ``order`` is alphabetical, count-desc, count-asc or a list of values (others follow in
    alphabetical order). Selected values show their count before filtering. ``totals`` has
    query_id and n_unfiltered. Positions count within (query_id, filter).
    """
    chosen = F.col("value").isin(selected or [])
    shown = facets.withColumn("selected", chosen).withColumn(
        "n", F.when(chosen, F.col("n_total")).otherwise(F.col("n_filtered"))
    )
    if not show_empty:
        shown = shown.where((F.col("n") > 0) | F.col("selected"))
    names = facets.select("query_id", "filter").distinct()
    every = names.join(totals, "query_id").select(
        "query_id", "filter", F.lit("All").alias("value"), F.col("n_unfiltered").alias("n"), F.lit(0).alias("__tier")
    )
    rows = shown.select("query_id", "filter", "value", "n", F.lit(1).alias("__tier")).unionByName(every)
    if isinstance(order, list):
        listed = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("value"))
        key = F.when(listed > 0, listed).otherwise(len(order) + 1)
    elif order == "count-desc":
        key = -F.col("n")
    elif order == "count-asc":
        key = F.col("n")
    elif order == "alphabetical":
        key = F.lit(0)
    else:
        raise ValueError(f"unknown order {order!r}")
    keyed = rows.withColumn("__key", key.cast("bigint")).withColumn("__alphabet", F.collate("value", "UNICODE"))
    by = [("__tier", True), ("__key", True), ("__alphabet", True), ("value", True)]
    ranked = rank_in_group(keyed, ["query_id", "filter"], by, "position", hot_rows)
    return ranked.drop("__tier", "__key", "__alphabet")
