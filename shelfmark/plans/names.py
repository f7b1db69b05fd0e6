"""Queries over names, paths and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import names as N
from ..operators.rules import related_tags_from
from . import views as V
from .registry import query

# Rules whose needles occur in the given part names.
RULES = [
    (1, "bolt", ["fastener", "metal"]),
    (2, "gear", ["machine", "metal"]),
    (3, "ring", ["round"]),
    (4, "anvil", ["forge", "metal"]),
]
RULE_LIST = [(needle, tags) for _, needle, tags in RULES]
SQL_RELATED = "CASE " + " ".join(
    f"WHEN contains(path, '{needle}') THEN {tags}" for _, needle, tags in RULES
) + " ELSE []::VARCHAR[] END"


@query("filter_by_extension", f"""WITH {V.ASSETS}
SELECT pos, filename, regexp_matches(lower(filename), '\\.(png|jpg|jpeg|gif|webp|svg)$') AS importable,
  regexp_matches(filename, '\\.(png|jpg|jpeg|gif|webp|pdf)$') AS labelled
FROM assets WHERE regexp_matches(lower(filename), '\\.(png|jpg|jpeg|gif|bmp|webp)$')""")
def _(spark, sf):
    name = F.col("filename")
    return V.assets(spark, sf).where(N.has_extension(name, N.ENCODE_TYPES)).select(
        "pos", "filename",
        N.has_extension(name, N.IMPORT_TYPES).alias("importable"),
        N.has_extension(name, N.LABEL_TYPES, case_sensitive=True).alias("labelled"),
    )


@query("split_name", f"""WITH {V.RAW_NAMES}
SELECT file_id, {V.sql_stem('name')} AS stem, {V.sql_ext('name')} AS extension FROM raw_names""")
def _(spark, sf):
    name = F.col("name")
    return V.raw_names(spark, sf).select(
        "file_id", N.stem_of(name).alias("stem"), N.extension_of(name).alias("extension")
    )


@query("normalize_filename", f"""WITH {V.RAW_NAMES}
SELECT file_id, name, {V.sql_normalized('name')} AS normalized FROM raw_names""")
def _(spark, sf):
    return V.raw_names(spark, sf).select("file_id", "name", N.normalize_filename(F.col("name")).alias("normalized"))


@query("trim_numbered_name", f"""WITH {V.RAW_NAMES}
SELECT file_id, {V.sql_trimmed('name')} AS trimmed FROM raw_names""")
def _(spark, sf):
    return V.raw_names(spark, sf).select("file_id", N.trim_numbered_name(F.col("name")).alias("trimmed"))


@query("content_hash", f"WITH {V.BLOBS} SELECT doc_id, sha256(text) AS hash FROM blobs")
def _(spark, sf):
    return V.blobs(spark, sf).select("doc_id", N.content_hash(F.col("content")).alias("hash"))


@query("stable_id", f"WITH {V.ASSETS} SELECT pos, substr(md5(filename), 1, 8) AS id FROM assets")
def _(spark, sf):
    return V.assets(spark, sf).select("pos", N.stable_id(F.col("filename")).alias("id"))


@query("asset_path", f"""WITH {V.ASSETS}
SELECT pos, '/emojis/' || filename AS path, filename AS base FROM assets""")
def _(spark, sf):
    return V.assets(spark, sf).select("pos", N.asset_path(F.col("filename")).alias("path")).withColumn(
        "base", N.base_name(F.col("path"))
    )


@query("created_day", f"WITH {V.ASSETS} SELECT pos, strftime(created, '%Y-%m-%d') AS day FROM assets")
def _(spark, sf):
    return V.assets(spark, sf).select("pos", N.created_day(F.col("created")).alias("day"))


@query("mime_type", f"""WITH {V.ASSETS}
SELECT pos, CASE WHEN lower(filename) LIKE '%.jpg' THEN 'image/jpeg'
  ELSE 'image/' || regexp_extract(lower(filename), '\\.([^.]*)$', 1) END AS mime_type FROM assets""")
def _(spark, sf):
    return V.assets(spark, sf).select("pos", N.mime_type(F.col("filename")).alias("mime_type"))


@query("display_label", f"""WITH {V.CATALOG}
SELECT pos, regexp_replace(split_part(path, '.', 1), '/.*/', '') AS label FROM catalog""")
def _(spark, sf):
    return V.catalog(spark, sf).select("pos", N.display_label(F.col("path")).alias("label"))


@query("animated_by_extension", f"""WITH {V.ASSETS}
SELECT pos, filename LIKE '%.webp' OR filename LIKE '%.gif' AS animated FROM assets""")
def _(spark, sf):
    return V.assets(spark, sf).select("pos", N.animated_by_extension(F.col("filename")).alias("animated"))


@query("absolute_url", f"""WITH {V.CATALOG}
SELECT pos, 'http://localhost:3000' || path AS from_root, 'http://localhost:3000/' || filename AS from_name FROM catalog""")
def _(spark, sf):
    origin = "http://localhost:3000"
    return V.catalog(spark, sf).select(
        "pos", N.absolute_url(F.col("path"), origin).alias("from_root"),
        N.absolute_url(F.col("filename"), origin).alias("from_name"),
    )


@query("absolute_url_of_pages", "SELECT page_id, url AS absolute FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", N.absolute_url(F.col("url"), "http://x").alias("absolute"))


@query("result_url", f"""WITH {V.CATALOG}
SELECT pos, regexp_replace(regexp_replace('https://example.com/site/' || path, '/+', '/', 'g'), '^(https?:/)', '\\1/')
  || '?mark=' || url_encode(tags[1]) || '&mark=' || url_encode(tags[2]) AS url FROM catalog""")
def _(spark, sf):
    term = F.array_join("tags", " ")
    return V.catalog(spark, sf).select(
        "pos", N.result_url(F.col("path"), "https://example.com/site", term, "mark").alias("url")
    )


@query("related_tags", f"""WITH {V.CATALOG}
SELECT pos, array_to_string({SQL_RELATED}, ',') AS related FROM catalog""")
def _(spark, sf):
    related = L.related_tags(F.col("path"), RULE_LIST)
    return V.catalog(spark, sf).select("pos", F.array_join(related, ",").alias("related"))


def _rule_table(spark):
    return spark.createDataFrame(RULES, "priority int, needle string, tags array<string>")


@query("related_tags_from_table", f"""WITH {V.CATALOG}
SELECT pos, array_to_string({SQL_RELATED}, ',') AS related FROM catalog""")
def _(spark, sf):
    tagged = related_tags_from(V.catalog(spark, sf), _rule_table(spark), max_inline=0)
    return tagged.select("pos", F.array_join("related", ",").alias("related"))


@query("join_labels", f"""WITH {V.CATALOG}
SELECT pos, array_to_string(list_concat(list_concat(categories, tags), {SQL_RELATED}), ', ') AS labels FROM catalog""")
def _(spark, sf):
    related = L.related_tags(F.col("path"), RULE_LIST)
    return V.catalog(spark, sf).select(
        "pos", L.join_labels(F.col("categories"), F.col("tags"), related).alias("labels")
    )


@query("distinct_labels", f"""WITH {V.CATALOG}, every AS (
  SELECT pos, lower(label) AS label, place FROM (
    SELECT pos, unnest(l) AS label, unnest(range(len(l))) AS place FROM (
      SELECT pos, list_concat(list_concat(list_concat([filename], categories), tags), {SQL_RELATED}) AS l FROM catalog)))
SELECT pos, string_agg(label, ', ' ORDER BY place) AS labels
FROM (SELECT pos, label, min(place) AS place FROM every GROUP BY pos, label) GROUP BY pos""")
def _(spark, sf):
    related = L.related_tags(F.col("path"), RULE_LIST)
    return V.catalog(spark, sf).select(
        "pos", L.distinct_labels(F.col("filename"), F.col("categories"), F.col("tags"), related).alias("labels")
    )


# Replies as a labeller gives them, made from the parts: bare, fenced, partial and broken.
REPLY = """CASE p_partkey % 4
  WHEN 0 THEN '{"categories": ["' || lower(p_type) || '"], "tags": ["' || p_brand || '", "t' || p_size || '"]}'
  WHEN 1 THEN '```json' || chr(10) || '{"categories": ["' || lower(p_type) || '"], "tags": []}' || chr(10) || '```'
  WHEN 2 THEN '{"tags": ["' || p_brand || '"]}'
  ELSE 'I cannot label ' || p_name END"""


@query("parse_label_reply", """WITH r AS (SELECT p_partkey, p_type, p_brand, p_size FROM part)
SELECT p_partkey, p_partkey % 4 <> 3 AS readable,
  CASE WHEN p_partkey % 4 IN (0, 1) THEN lower(p_type) WHEN p_partkey % 4 = 2 THEN '' END AS categories,
  CASE p_partkey % 4 WHEN 0 THEN p_brand || ',t' || p_size WHEN 1 THEN '' WHEN 2 THEN p_brand END AS tags
FROM r""")
def _(spark, sf):
    replies = V.table(spark, sf, "part").selectExpr("p_partkey", f"{REPLY} AS reply")
    labels = F.col("labels")
    return replies.withColumn("labels", L.parse_label_reply(F.col("reply"))).select(
        "p_partkey", labels.isNotNull().alias("readable"),
        F.array_join(labels["categories"], ",").alias("categories"), F.array_join(labels["tags"], ",").alias("tags"),
    )


@query("hit_projection", f"""WITH {V.CATALOG}
SELECT pos, id, path AS filename, path, array_to_string(list_concat(categories, tags), '|') AS categories,
  0::BIGINT AS n_tags, '' AS created, size FROM catalog""")
def _(spark, sf):
    hits = V.catalog(spark, sf).select(
        "pos", "path",
        L.join_labels(F.col("categories"), F.col("tags"), F.array().cast("array<string>")).alias("content"),
        F.create_map(F.lit("id"), F.col("id"), F.lit("size"), F.col("size").cast("string")).alias("meta"),
    )
    record = L.hit_record(F.col("path"), F.col("path"), F.col("content"), F.col("meta"))
    rows = hits.select("pos", *record)
    return rows.select(
        "pos", "id", "filename", "path", F.array_join("categories", "|").alias("categories"),
        F.size("tags").cast("bigint").alias("n_tags"), "created", "size",
    )
