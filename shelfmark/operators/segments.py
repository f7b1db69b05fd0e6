"""A search index that grows by segments, one per batch of documents.

Every batch is written as an index of its own and published by a manifest, a table of one file that is written last: a
batch that fails before leaves nothing a reader sees, and one that is repeated after it changes nothing. Documents that
come again or are taken out get removal marks, which hold for the segments before them. Compaction merges the segments'
postings, without looking at texts again, into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .index import TextIndex, build_index, read_index, write_index

MANIFEST = "version bigint, segment string, added bigint"
# Terms and folders of a segment are numbered from its number times this on.
TERMS_EACH, PARTS_EACH = 1 << 52, 1 << 20


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        rows = spark.read.schema(schema).parquet(path)
        rows.schema
        return rows
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, int]]:
    """The version of the index, 0 for none yet, and its segments with the version that added each."""
    rows = _table(spark, f"{root}/manifest", MANIFEST)
    version = rows.agg(F.max("version")).first()[0] or 0
    return version, {row["segment"]: row["added"] for row in rows.where(F.col("version") == version).orderBy("added").collect()}


def _publish(spark: SparkSession, root: str, version: int, segments: dict[str, int]) -> None:
    rows = spark.createDataFrame([(version, name, added) for name, added in segments.items()], MANIFEST)
    rows.coalesce(1).drop("version").write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def _removed(spark: SparkSession, root: str, kind: str, before: int | None = None) -> DataFrame:
    """(doc_id, removed): the last version that took a document out of the segments before it."""
    marks = _table(spark, f"{root}/removed", f"doc_id {kind}, version bigint")
    if before is not None:
        marks = marks.where(F.col("version") <= before)
    return marks.groupBy("doc_id").agg(F.max("version").alias("removed"))


def _live(table: DataFrame, added: int, removed: DataFrame) -> DataFrame:
    return table.join(removed.where(F.col("removed") > added).select("doc_id"), "doc_id", "left_anti")


def remove_documents(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Take the documents with these doc_ids out of the index."""
    version, segments = current(spark, root)
    ids.select("doc_id").distinct().write.mode("overwrite").parquet(f"{root}/removed/version={version + 1}")
    _publish(spark, root, version + 1, segments)


def add_segment(spark: SparkSession, root: str, name: str, docs: DataFrame, kept: list[str] | None = None) -> bool:
    """Index ``docs`` as the segment ``name``; False if it is there already. Documents of earlier segments with the same
    doc_id give way to the new ones."""
    version, segments = current(spark, root)
    if name in segments:
        return False
    write_index(build_index(docs, kept), f"{root}/segments/{name}")
    fresh = spark.read.parquet(f"{root}/segments/{name}/docs").select("doc_id")
    if segments:
        earlier = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/segments/{s}/docs").select("doc_id") for s in segments])
        fresh.distinct().join(earlier, "doc_id", "left_semi").write.mode("overwrite").parquet(f"{root}/removed/version={version + 1}")
    _publish(spark, root, version + 1, {**segments, name: version + 1})
    return True


def open_index(spark: SparkSession, root: str) -> TextIndex:
    """The index as published: all segments side by side, without what is removed.

    A term is in the dictionary once per segment that has it, so how many documents hold it is counted in a search.
    """
    version, segments = current(spark, root)
    if not segments:
        raise ValueError(f"no segment has been published in {root}")
    parts = {field: [] for field in ("postings", "docs", "lengths", "terms", "blocks")}
    for number, (name, added) in enumerate(segments.items()):
        own = read_index(spark, f"{root}/segments/{name}")
        removed = _removed(spark, root, dict(own.docs.dtypes)["doc_id"], before=version)
        for field, tables in parts.items():
            table = getattr(own, field)
            if field in ("postings", "terms", "blocks"):
                # Sums over folder columns stay filters on folders.
                table = table.withColumns({"term_id": F.col("term_id") + F.lit(number * TERMS_EACH), "part": F.col("part") + F.lit(number * PARTS_EACH)})
            if field in ("postings", "docs", "lengths"):
                table = _live(table, added, removed)
            tables.append(table)
    union = lambda tables: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return TextIndex(**{field: union(tables) for field, tables in parts.items()}, counted=False)


def compact(spark: SparkSession, root: str) -> str:
    """Merge all segments into one and publish it alone; removal marks up to now are done with. Gives its name."""
    version, _ = current(spark, root)
    index = open_index(spark, root)
    named = index.terms.select("term_id", "term", "term_exact")
    postings = index.postings.join(named, "term_id").select("lang", "term", "term_exact", "doc_id", "tf", "positions", "weight")
    name = f"merged-{version + 1}"
    # Lengths are read by several steps; texts and postings once.
    write_index(TextIndex(postings, index.docs, stored(index.lengths, "lengths")), f"{root}/segments/{name}")
    _publish(spark, root, version + 1, {name: version + 1})
    return name
