"""Queries over scans, imports, conversions and catalog building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import catalog as C
from ..operators import export as E
from ..operators import imports as I
from ..operators import search as find
from ..operators.segments import compact
from ..session import scratch_path
from ..sources import files as S
from ..sources import sinks as K
from ..streaming.ingest import ingest_files, read_ingested, read_records
from . import views as V
from .registry import query

ORDER = ["filename", "doc_id"]


@query("scan_assets")
def _(spark, sf):
    found = S.scan_assets(spark, sf, ["parquet"], recursive=True)
    return found.select("filename", "size", N.created_day(F.col("created")).alias("day"))


@query("catalog_round_trip", f"""WITH {V.CATALOG}
SELECT id, filename, size, array_to_string(tags, ',') AS tags FROM catalog""")
def _(spark, sf):
    path = scratch_path(spark, "catalog")
    K.write_catalog(V.catalog(spark, sf).drop("pos"), path)
    return S.read_catalog_table(spark, f"{path}/records").select(
        "id", "filename", "size", F.array_join("tags", ",").alias("tags")
    )


@query("write_search_table", f"""WITH {V.CATALOG}
SELECT id, path AS url, filename AS file_base_name, strftime(created, '%Y-%m-%d') AS day, size::VARCHAR AS size FROM catalog""")
def _(spark, sf):
    from ..operators.index import full_text_documents

    path = scratch_path(spark, "search-table")
    K.write_search_table(full_text_documents(V.catalog(spark, sf)), path)
    stored = spark.read.parquet(path)
    return stored.select("id", "url", "file_base_name", F.date_format("created", "yyyy-MM-dd").alias("day"), "size")


@query("base64_rows", f"""WITH {V.BLOBS}
SELECT filename, '.png' AS extension, size AS size_bytes, 'image/png' AS mime_type, base64(content) AS base64 FROM blobs""")
def _(spark, sf):
    return E.base64_rows(V.blobs(spark, sf))


# Documents as files that arrive in three batches, the second of them once more under other names.
ARRIVED = """arrived AS (
  SELECT doc_id, lang, source, doc_id % 3 AS batch, source || '-' || doc_id || 'x.png' AS filename, text, sha256(text) AS hash FROM documents),
taken AS (
  SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY hash ORDER BY batch, filename, 'd' || doc_id) = 1)"""


def _ingested(spark, sf):
    """The folder of a finished ingest of all documents."""
    docs = V.table(spark, sf, "documents").select(
        F.concat("source", F.lit("-"), "doc_id", F.lit("x.png")).alias("filename"), F.concat(F.lit("d"), "doc_id").alias("file_path"),
        F.octet_length("text").cast("bigint").alias("size"), F.lit("2024-05-01").cast("timestamp").alias("created"),
        F.encode("text", "UTF-8").alias("content"), (F.col("doc_id") % 3).alias("batch"), "lang", "source",
    )
    files = docs.drop("lang", "source", "batch")
    labels = docs.select(F.lit(0).alias("pos"), "filename", F.array("lang").alias("categories"), F.array("source").alias("tags"))
    drop, table, checkpoint = (scratch_path(spark, name) for name in ("arrived", "ingested", "ingest-checkpoint"))
    again = files.where(docs["batch"] == 1).withColumn("filename", F.concat(F.lit("z"), "filename")).withColumn("file_path", F.concat(F.lit("z"), "file_path"))
    for batch in [*[files.where(docs["batch"] == i) for i in range(3)], again]:
        batch.write.mode("append").parquet(drop)
        arrived = spark.readStream.schema(files.schema).parquet(drop)
        ingest_files(arrived, table, checkpoint, types=["png"], labels=labels).awaitTermination()
    return table


@query("ingest_stream", f"""WITH {ARRIVED}
SELECT filename, filename AS original, '/emojis/' || filename AS path, octet_length(encode(text))::BIGINT AS size, hash, lang || '/' || source AS labels
FROM taken""")
def _(spark, sf):
    records = read_records(spark, _ingested(spark, sf))
    labels = F.concat_ws("/", F.array_join("categories", ","), F.array_join("tags", ","))
    return records.select("filename", F.col("source").alias("original"), "path", "size", "hash", labels.alias("labels"))


@query("search_ingested", f"""WITH {ARRIVED}, sizes AS (SELECT count(*) AS n FROM taken),
words AS (SELECT 1 AS query_id, filename FROM taken WHERE lang = 'en' UNION ALL SELECT 2, filename FROM taken WHERE source = 'src1'),
df AS (SELECT query_id, count(*) AS df FROM words GROUP BY query_id)
SELECT query_id, '/emojis/' || filename AS url, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4) AS score FROM words JOIN df USING (query_id), sizes""")
def _(spark, sf):
    table = _ingested(spark, sf)
    compact(spark, f"{table}/index")
    index = read_ingested(spark, table)
    # Every document has two words, so a word that is there counts its idf.
    hits = find.search(index, find.queries_from(spark, ["en", "src1"]), prefix=False, locations=False)
    return hits.join(index.docs.select("doc_id", "url"), "doc_id").select("query_id", "url", F.round("score", 4).alias("score"))


# ---- import -------------------------------------------------------------------------------

HASHED = f"{V.BLOBS}, hashed AS (SELECT filename, doc_id, sha256(text) AS hash FROM blobs)"


def _hashed(spark, sf):
    return V.blobs(spark, sf).select("filename", "doc_id", N.content_hash(F.col("content")).alias("hash"))


@query("dedupe_exact", f"""WITH {HASHED}
SELECT filename, doc_id, hash FROM hashed
QUALIFY row_number() OVER (PARTITION BY hash ORDER BY filename, doc_id) = 1""")
def _(spark, sf):
    return I.dedupe_exact(_hashed(spark, sf), ORDER)


@query("duplicate_report", f"""WITH {HASHED}, flagged AS (
  SELECT *, first_value(filename) OVER w AS survivor, row_number() OVER w AS n FROM hashed
  WINDOW w AS (PARTITION BY hash ORDER BY filename, doc_id))
SELECT filename, doc_id, hash, survivor FROM flagged WHERE n > 1""")
def _(spark, sf):
    return I.duplicate_report(_hashed(spark, sf), ORDER)


NO_NAMES = "SELECT ''::VARCHAR AS name WHERE false"


def _sql_resolution(rows: str, present: str = NO_NAMES) -> str:
    """Names given one by one in order, per family of names that can meet; ``rows`` has name, file_id, target.

    ``present`` selects the names that are taken from the start.
    """
    return f"""held AS (
  SELECT regexp_replace({V.sql_stem('name')}, '(-[1-9][0-9]*)+$', '') || {V.sql_ext('name')} AS family, list(name) AS names
  FROM ({present}) GROUP BY 1),
parted AS (
  SELECT *, {V.sql_stem('target')} AS stem, {V.sql_ext('target')} AS ext FROM {rows}),
families AS (
  SELECT *, regexp_replace(stem, '(-[1-9][0-9]*)+$', '') || ext AS family FROM parted),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY name, file_id) AS n FROM families),
given AS (
  SELECT q.family, 0::BIGINT AS n, ''::VARCHAR AS file_id, ''::VARCHAR AS final_name, coalesce(h.names, []::VARCHAR[]) AS taken
  FROM (SELECT DISTINCT family FROM queue) q LEFT JOIN held h ON h.family = q.family
  UNION ALL
  SELECT family, n, file_id, final_name, list_append(taken, final_name) FROM (
    SELECT q.family, q.n, q.file_id, g.taken,
      list_filter(list_transform(range(0, len(g.taken) + 1), lambda k: q.stem || CASE WHEN k = 0 THEN '' ELSE '-' || k END || q.ext),
        lambda c: NOT list_contains(g.taken, c))[1] AS final_name
    FROM given g JOIN queue q ON q.family = g.family AND q.n = g.n + 1))"""


CLEANED = f"""{V.RAW_NAMES}, cleaned AS (
  SELECT name, file_id, hash, {V.sql_normalized('name')} AS target FROM raw_names)"""


@query("resolve_name_clash", f"""WITH RECURSIVE {CLEANED}, {_sql_resolution('cleaned')}
SELECT file_id, final_name FROM given WHERE n > 0""")
def _(spark, sf):
    files = V.raw_names(spark, sf).withColumn("target", N.normalize_filename(F.col("name")))
    return I.resolve_name_clash(files, ["name", "file_id"]).select("file_id", "final_name")


# Files already in place: every clean name of a part, holding the bytes of its brand and size.
IN_PLACE = """in_place AS (
  SELECT DISTINCT replace(p_name, ' ', '') || '.png' AS name, sha256(p_brand || '/' || p_size) AS hash
  FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1)"""


def _in_place(spark, sf):
    first = V.table(spark, sf, "part").groupBy("p_name").agg(
        F.min_by(F.struct("p_brand", "p_size"), "p_partkey").alias("first")
    )
    return first.select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".png")).alias("name"),
        F.sha2(F.concat("first.p_brand", F.lit("/"), "first.p_size"), 256).alias("hash"),
    )


@query("existing_duplicate", f"""WITH {CLEANED}, {IN_PLACE}
SELECT c.file_id, c.target, p.hash IS NOT NULL AS in_place
FROM cleaned c LEFT JOIN in_place p ON p.name = c.target AND p.hash = c.hash""")
def _(spark, sf):
    files = V.raw_names(spark, sf).withColumn("target", N.normalize_filename(F.col("name")))
    flagged = I.existing_duplicate(files, _in_place(spark, sf), ["name", "file_id"])
    return flagged.select("file_id", "target", "in_place")


PLAN = f"""{V.RAW_NAMES}, trimmed AS (
  SELECT name, file_id, hash, {V.sql_trimmed('name')} AS short,
    row_number() OVER (PARTITION BY hash ORDER BY name, file_id) AS copy,
    first_value(name) OVER (PARTITION BY hash ORDER BY name, file_id) AS survivor
  FROM raw_names WHERE regexp_matches(lower(name), '\\.(png|jpg|jpeg|gif|webp|svg)$')),
cleaned AS (SELECT *, {V.sql_normalized('short')} AS target FROM trimmed),
arriving AS (SELECT * FROM cleaned WHERE copy = 1),
{_sql_resolution('arriving')},
planned AS (
  SELECT c.name, c.file_id, c.target, g.final_name, CASE WHEN copy = 1 THEN 'imported' ELSE 'duplicate' END AS status,
    copy = 1 AND c.target <> c.name AS renamed, c.survivor
  FROM cleaned c LEFT JOIN given g ON g.file_id = c.file_id)"""


@query("import_plan", f"WITH RECURSIVE {PLAN} SELECT * FROM planned")
def _(spark, sf):
    plan = I.import_plan(V.raw_names(spark, sf))
    return plan.select("name", "file_id", "target", "final_name", "status", "renamed", "survivor")


@query("import_summary", f"""WITH RECURSIVE {PLAN}
SELECT count(*) FILTER (status = 'imported')::BIGINT AS imported, count(*) FILTER (status = 'duplicate')::BIGINT AS skipped,
  count(*) FILTER (status = 'duplicate')::BIGINT AS duplicates, count(*) FILTER (renamed)::BIGINT AS renamed, 0::BIGINT AS errors
FROM planned""")
def _(spark, sf):
    return I.import_summary(I.import_plan(V.raw_names(spark, sf)))


# The folder files arrive in: the names above, and for every other part a numbered one that follows.
FILLED = f"""{IN_PLACE}, filled AS (
  SELECT name, hash FROM in_place UNION ALL
  SELECT replace(p_name, ' ', '') || '-1.png', sha256(min(p_brand) || '/' || min(p_size))
  FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0)"""
FILLED_PLAN = f"""{V.RAW_NAMES}, {FILLED}, shortened AS (
  SELECT name, file_id, hash, {V.sql_trimmed('name')} AS short,
    row_number() OVER (PARTITION BY hash ORDER BY name, file_id) AS copy
  FROM raw_names WHERE regexp_matches(lower(name), '\\.(png|jpg|jpeg|gif|webp|svg)$')),
targets AS (SELECT *, {V.sql_normalized('short')} AS target FROM shortened),
judged AS (
  SELECT t.*, CASE WHEN copy > 1 THEN 'duplicate'
    WHEN EXISTS (SELECT 1 FROM filled f WHERE f.name = t.target AND f.hash = t.hash)
      OR EXISTS (SELECT 1 FROM filled f, filled b WHERE b.name = t.target AND f.hash = t.hash
        AND f.name = {V.sql_stem('t.target')} || '-1' || {V.sql_ext('t.target')}) THEN 'duplicate_existing'
    ELSE 'imported' END AS status FROM targets t),
entering AS (SELECT * FROM judged WHERE status = 'imported'),
{_sql_resolution('entering', 'SELECT name FROM filled')}"""


def _filled(spark, sf):
    parts = V.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_brand").alias("brand"), F.min("p_size").alias("size"))
    numbered = parts.where("k % 2 = 0").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("-1.png")).alias("name"), F.sha2(F.concat("brand", F.lit("/"), "size"), 256).alias("hash")
    )
    return _in_place(spark, sf).unionByName(numbered)


@query("import_into_filled", f"""WITH RECURSIVE {FILLED_PLAN}
SELECT j.file_id, j.target, j.status, g.final_name FROM judged j LEFT JOIN given g ON g.file_id = j.file_id AND g.n > 0""")
def _(spark, sf):
    plan = I.import_plan(V.raw_names(spark, sf), _filled(spark, sf))
    return plan.select("file_id", "target", "status", "final_name")


# ---- conversions --------------------------------------------------------------------------

STEMS = f"""{V.ASSETS}, stems AS (
  SELECT *, {V.sql_stem('filename')} AS stem, lower({V.sql_ext('filename')}) AS ext FROM assets),
originals AS (SELECT * FROM stems WHERE ext IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.tiff'))"""


@query("pending_conversions", f"""WITH {STEMS}
SELECT pos, filename, stem || '.webp' AS converted_name FROM originals o
WHERE NOT EXISTS (SELECT 1 FROM stems s WHERE s.filename = o.stem || '.webp')""")
def _(spark, sf):
    return I.pending_conversions(V.assets(spark, sf)).select("pos", "filename", "converted_name")


@query("orphaned_originals", f"""WITH {STEMS}
SELECT pos, filename, stem FROM originals o
WHERE EXISTS (SELECT 1 FROM stems s WHERE s.ext = '.webp' AND s.stem = o.stem)""")
def _(spark, sf):
    return I.orphaned_originals(V.assets(spark, sf)).select("pos", "filename", "stem")


SAVINGS = f"""{STEMS}, savings AS (
  SELECT o.pos, o.filename, o.size, c.converted_size, round((1 - c.converted_size / o.size) * 100, 1) AS saved_percent
  FROM originals o JOIN (SELECT stem, max(size) AS converted_size FROM stems WHERE ext = '.webp' GROUP BY stem) c
    ON c.stem = o.stem)"""


@query("conversion_savings", f"WITH {SAVINGS} SELECT pos, filename, converted_size, saved_percent FROM savings")
def _(spark, sf):
    return I.conversion_savings(V.assets(spark, sf)).select("pos", "filename", "converted_size", "saved_percent")


@query("total_savings", f"""WITH {SAVINGS}
SELECT count(*)::BIGINT AS files, round((1 - sum(converted_size) / sum(size)) * 100, 1) AS saved_percent FROM savings""")
def _(spark, sf):
    return I.total_savings(I.conversion_savings(V.assets(spark, sf)))


# ---- metadata -----------------------------------------------------------------------------

LABELS = f"""{V.ASSETS}, {V.EARLIER}, by_name AS (
  SELECT filename, arg_max(labels, pos) AS labels, min(pos) AS pos FROM earlier WHERE labels <> '' GROUP BY filename),
by_stem AS (
  SELECT {V.sql_stem('filename')} AS stem, arg_min(labels, pos) AS labels FROM by_name GROUP BY 1),
fresh AS (
  SELECT filename, arg_min(lower(tags[1]) || '/f', pos) AS labels FROM assets WHERE filename LIKE '%.webp' GROUP BY filename),
joined AS (
  SELECT a.*, n.labels AS own, s.labels AS moved, f.labels AS fresh
  FROM assets a LEFT JOIN by_name n ON n.filename = a.filename
  LEFT JOIN by_stem s ON s.stem = {V.sql_stem('a.filename')}
  LEFT JOIN fresh f ON f.filename = a.filename)"""


def _fresh(spark, sf):
    """Fresh labels for some files, one row per filename."""
    webp = V.assets(spark, sf).where(F.col("filename").endswith(".webp"))
    first = webp.groupBy("filename").agg(F.min_by(F.get("tags", 0), "pos").alias("first"))
    return first.select("filename", F.array(F.lower("first")).alias("categories"), F.array(F.lit("f")).alias("tags"))


def _labels():
    return F.array_join(F.concat("categories", "tags"), "/").alias("labels")


@query("carry_labels", f"""WITH {LABELS}
SELECT pos, filename, coalesce(own, moved, fresh, '') AS labels,
  CASE WHEN own IS NOT NULL THEN 'same_name' WHEN moved IS NOT NULL THEN 'same_stem' WHEN fresh IS NOT NULL THEN 'fresh'
    ELSE 'none' END AS label_source
FROM joined""")
def _(spark, sf):
    carried = C.carry_labels(
        V.assets(spark, sf).select("pos", "filename"), V.earlier_catalog(spark, sf), _fresh(spark, sf)
    )
    return carried.select("pos", "filename", _labels(), "label_source")


@query("relabel_all", f"""WITH {LABELS}
SELECT pos, coalesce(fresh, own, '') AS labels,
  CASE WHEN fresh IS NOT NULL THEN 'fresh' WHEN own IS NOT NULL THEN 'same_name' ELSE 'none' END AS label_source
FROM joined""")
def _(spark, sf):
    carried = C.carry_labels(
        V.assets(spark, sf).select("pos", "filename"), V.earlier_catalog(spark, sf), _fresh(spark, sf), force=True
    )
    return carried.select("pos", _labels(), "label_source")


@query("unlabelled_assets", f"WITH {LABELS} SELECT pos, filename FROM joined WHERE own IS NULL AND moved IS NULL")
def _(spark, sf):
    return C.unlabelled(V.assets(spark, sf), V.earlier_catalog(spark, sf)).select("pos", "filename")


@query("label_assets", f"""WITH {V.BLOBS}
SELECT filename, 'text' AS categories, 'b' || octet_length(content) AS tags FROM blobs WHERE octet_length(content) % 3 <> 0""")
def _(spark, sf):
    def labeller(content: bytes) -> str:
        if len(content) % 3 == 0:
            raise ValueError("no label")
        return '```json\n{"categories": ["text"], "tags": ["b%d"]}\n```' % len(content)

    labels = C.label_assets(V.blobs(spark, sf), labeller)
    return labels.select(
        "filename", F.array_join("categories", ",").alias("categories"), F.array_join("tags", ",").alias("tags")
    )


@query("probe_dimensions", """SELECT p_partkey AS pos,
  CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size + 2 END AS width, (p_partkey % 1000 + 1)::INT AS height,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS pages, p_partkey % 3 = 1 AS animated
FROM part WHERE p_partkey % 3 <> 2""")
def _(spark, sf):
    # Image bytes made of the parts: a PNG head, a GIF with two blocks, or no image at all.
    le = "concat(substr(lpad(hex({0}), 4, '0'), 3, 2), substr(lpad(hex({0}), 4, '0'), 1, 2))"
    png = "concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_size + 1), 8, '0'), lpad(hex(p_partkey % 1000 + 1), 8, '0'))"
    block = "'2C0000000001000100000201AA00'"
    gif = f"concat('474946383961', {le.format('p_size + 2')}, {le.format('p_partkey % 1000 + 1')}, '000000', {block}, {block}, '3B')"
    files = V.table(spark, sf, "part").selectExpr(
        "p_partkey AS pos",
        f"unhex(CASE p_partkey % 3 WHEN 0 THEN {png} WHEN 1 THEN {gif} ELSE hex(p_name) END) AS content",
    )
    return C.probe_dimensions(files).select("pos", "width", "height", "pages", "animated")


METADATA = f"""{LABELS}, metadata AS (
  SELECT substr(md5(filename), 1, 8) AS id, filename, '/emojis/' || filename AS path,
    coalesce(own, moved, '') AS labels, strftime(created, '%Y-%m-%d') AS created, size, width, 0 AS height FROM joined)"""


def _metadata(spark, sf):
    return C.build_metadata(V.assets(spark, sf), V.earlier_catalog(spark, sf))


@query("build_metadata", f"WITH {METADATA} SELECT * FROM metadata")
def _(spark, sf):
    return _metadata(spark, sf).select(
        "id", "filename", "path", _labels(), N.created_day(F.col("created")).alias("created"), "size", "width", "height"
    )


@query("catalog_stats", f"""WITH {METADATA}
SELECT count(*)::BIGINT AS total, max(created) AS last_updated, count(*) FILTER (labels <> '')::BIGINT AS labelled FROM metadata""")
def _(spark, sf):
    stats = C.catalog_stats(_metadata(spark, sf))
    return stats.withColumn("last_updated", N.created_day(F.col("last_updated")))


@query("id_collisions", f"""WITH {V.ASSETS}
SELECT substr(md5(filename), 1, 3) AS id, count(DISTINCT filename)::BIGINT AS filenames FROM assets GROUP BY 1
HAVING count(DISTINCT filename) > 1""")
def _(spark, sf):
    short = V.assets(spark, sf).withColumn("id", N.stable_id(F.col("filename"), 3))
    return C.id_collisions(short)


@query("write_catalog_order", f"""WITH {V.CATALOG}
SELECT filename, row_number() OVER (ORDER BY translate(lower(filename), '_-.', '!"#'), filename) AS position FROM catalog""")
def _(spark, sf):
    from ..operators.skew import rank_in_group

    path = scratch_path(spark, "catalog")
    K.write_catalog(V.catalog(spark, sf).drop("pos"), path)
    placed = K.stored_order(S.read_catalog_table(spark, f"{path}/records"))
    return rank_in_group(placed, [], [("file", True), ("row", True)], "position").select("filename", "position")


@query("counted_sinks", f"""WITH {V.BLOBS}, {V.CATALOG}
SELECT 'encoded' AS sink, count(*)::BIGINT AS total, sum(size)::BIGINT AS amount FROM blobs
UNION ALL SELECT 'catalog', count(*), count(*) FILTER (len(categories) > 0 OR len(tags) > 0) FROM catalog""")
def _(spark, sf):
    encoded = K.write_encoded(E.base64_rows(V.blobs(spark, sf)), scratch_path(spark, "encoded"))
    stats = K.write_catalog(V.catalog(spark, sf).drop("pos"), scratch_path(spark, "catalog"))
    rows = [("encoded", encoded["rows"], encoded["bytes"]), ("catalog", stats["total"], stats["labelled"])]
    return spark.createDataFrame(rows, "sink string, total bigint, amount bigint")
