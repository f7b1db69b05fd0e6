"""The catalog: one record per asset, with labels carried over from earlier catalogs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.images import probe_size
from ..functions.labels import has_labels, parse_label_reply

NO_LABELS_TYPE = "struct<categories:array<string>,tags:array<string>>"


def _no_labels() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(empty.alias("categories"), empty.alias("tags"))


def known_labels(existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels by filename, and by stem for files whose ending changed.

    Of records with one filename the last labels count, at the place of the first record; of
    filenames with one stem the first in catalog order counts.
    """
    labels = F.struct(
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )
    labelled = existing.select("pos", "filename", labels.alias("labels")).where(
        has_labels(F.col("labels")) & (F.coalesce("filename", F.lit("")) != "")
    )
    by_name = labelled.groupBy("filename").agg(
        F.max_by("labels", "pos").alias("labels"), F.min("pos").alias("first_pos")
    )
    by_stem = by_name.groupBy(N.stem_of(F.col("filename")).alias("stem")).agg(
        F.min_by("labels", "first_pos").alias("moved")
    )
    return by_name.select("filename", F.col("labels").alias("own")), by_stem


def carry_labels(
    files: DataFrame, existing: DataFrame, fresh: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """Add categories, tags and where they came from.

    Precedence: same filename, same stem, fresh label; ``force`` puts fresh labels first.
    ``fresh`` has filename, categories, tags and no row where labelling failed.
    """
    by_name, by_stem = known_labels(existing)
    rows = files.join(by_name, "filename", "left")
    if force:
        rows = rows.withColumn("moved", F.lit(None).cast(NO_LABELS_TYPE))
    else:
        rows = rows.withColumn("stem", N.stem_of(F.col("filename"))).join(by_stem, "stem", "left").drop("stem")
    if fresh is None:
        rows = rows.withColumn("fresh", F.lit(None).cast(NO_LABELS_TYPE))
    else:
        rows = rows.join(fresh.select("filename", F.struct("categories", "tags").alias("fresh")), "filename", "left")
    sources = [("fresh", "fresh"), ("own", "same_name")] if force else [
        ("own", "same_name"), ("moved", "same_stem"), ("fresh", "fresh")]
    origin = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for c, name in sources], F.lit("none"))
    labels = F.coalesce(*[F.col(c) for c, _ in sources], _no_labels())
    return (
        rows.withColumn("label_source", origin)
        .withColumn("categories", labels["categories"])
        .withColumn("tags", labels["tags"])
        .drop("own", "moved", "fresh")
    )


def unlabelled(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The files that need a fresh label: only these are worth a call to a labeller."""
    if force:
        return files
    by_name, by_stem = known_labels(existing)
    named = files.join(by_name, "filename", "left_anti").withColumn("stem", N.stem_of(F.col("filename")))
    return named.join(by_stem, "stem", "left_anti").drop("stem")


def label_assets(files: DataFrame, labeller: Callable[[bytes], str]) -> DataFrame:
    """(filename, categories, tags) from a caller's labeller, which gets a file's bytes.

    A failing call or an unreadable reply yields no row, never a failed job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(content: bytes) -> str | None:
            try:
                return labeller(content)
            except Exception:
                return None

        for batch in batches:
            yield pd.DataFrame({"filename": batch["filename"], "reply": [ask(c) for c in batch["content"]]})

    accepted = files.where(N.has_extension(F.col("filename"), N.LABEL_TYPES, case_sensitive=True))
    replies = accepted.select("filename", "content").mapInPandas(run, "filename string, reply string")
    labels = replies.select("filename", parse_label_reply(F.col("reply")).alias("labels"))
    return labels.where("labels is not null").select("filename", "labels.categories", "labels.tags")


def probe_dimensions(files: DataFrame) -> DataFrame:
    """Add width, height, pages and the animated flag; rows that are no image are dropped."""
    probed = files.withColumn("__size", probe_size("content")).where("__size.width is not null")
    return (
        probed.withColumn("width", F.col("__size.width"))
        .withColumn("height", F.col("__size.height"))
        .withColumn("pages", F.col("__size.pages"))
        .withColumn("animated", F.col("__size.pages") > 1)
        .drop("__size", "content")
    )


def build_metadata(
    files: DataFrame, existing: DataFrame, fresh: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """Catalog records for scanned files of (filename, size, created, width, height).

    Unordered: the order by filename belongs to the sink that needs it.
    """
    labelled = carry_labels(files, existing, fresh, force)
    return labelled.select(
        N.stable_id(F.col("filename")).alias("id"),
        "filename",
        N.asset_path(F.col("filename")).alias("path"),
        "categories",
        "tags",
        "created",
        "size",
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        "label_source",
    )


def stat_columns() -> list[Column]:
    """How many records there are, when the last one was made, and how many have labels."""
    labelled = has_labels({"categories": F.col("categories"), "tags": F.col("tags")})
    return [
        F.count(F.lit(1)).alias("total"),
        F.max("created").alias("last_updated"),
        F.count_if(labelled).alias("labelled"),
    ]


def catalog_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(*stat_columns())


def id_collisions(catalog: DataFrame) -> DataFrame:
    """Ids shared by different filenames: a sign that ids are too short for the catalog."""
    return (
        catalog.select("id", "filename").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("filenames"))
        .where("filenames > 1")
    )
