"""Catalog, corpus and event inputs as views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.sections import extract_anchors, visible_text
from ..operators.selection import RESET, SELECT_ALL, TOGGLE
from ..sources.tables import read_wide


# Tables whose rows hold whole texts, with their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_wide(spark, path, TEXTS[name]) if name in TEXTS else spark.read.parquet(path)


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """One asset per part."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS pos",
        "concat(replace(p_name, ' ', '_'), '-', p_partkey % 97, "
        "CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' WHEN 2 THEN '.webp' ELSE '.JPG' END) AS filename",
        "array(lower(p_type)) AS categories",
        "split(p_name, ' ') AS tags",
        "CAST(p_size AS BIGINT) * 1024 AS size",
        "CAST(date_add(DATE'2024-01-01', CAST(p_partkey % 365 AS INT)) AS TIMESTAMP) AS created",
        "CAST(p_size % 7 AS INT) AS width",
        "CAST(NULL AS INT) AS height",
    )


ASSETS = """assets AS (
  SELECT p_partkey AS pos,
    replace(p_name, ' ', '_') || '-' || (p_partkey % 97)
      || CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' WHEN 2 THEN '.webp' ELSE '.JPG' END AS filename,
    [lower(p_type)] AS categories, string_split(p_name, ' ') AS tags,
    p_size::BIGINT * 1024 AS size,
    DATE '2024-01-01' + (p_partkey % 365)::INT AS created,
    (p_size % 7)::INT AS width
  FROM part)"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Assets as catalog records; the id holds the position, since names repeat in this view."""
    return assets(spark, sf).withColumn("id", F.concat(F.lit("a"), "pos")).withColumn(
        "path", N.asset_path(F.col("filename"))
    )


CATALOG = ASSETS + """, catalog AS (SELECT *, 'a' || pos AS id, '/emojis/' || filename AS path FROM assets)"""


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Untidy file names with few distinct clean forms, and content with many copies."""
    return table(spark, sf, "part").selectExpr(
        "concat(CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey % 50, '_ ') ELSE '' END, "
        "CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, "
        "CASE WHEN p_partkey % 7 = 0 THEN '!' ELSE '' END, "
        "CASE WHEN p_partkey % 5 > 0 THEN concat('_', p_partkey % 5) ELSE '' END, "
        "CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif' WHEN 2 THEN '.txt' ELSE '.png' END) AS name",
        "lpad(CAST(p_partkey AS STRING), 12, '0') AS file_id",
        "sha2(concat(p_brand, '/', p_size), 256) AS hash",
    )


RAW_NAMES = """raw_names AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 50) || '_ ' ELSE '' END
      || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END
      || CASE WHEN p_partkey % 7 = 0 THEN '!' ELSE '' END
      || CASE WHEN p_partkey % 5 > 0 THEN '_' || (p_partkey % 5) ELSE '' END
      || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.gif' WHEN 2 THEN '.txt' ELSE '.png' END AS name,
    lpad(p_partkey::VARCHAR, 12, '0') AS file_id,
    sha256(p_brand || '/' || p_size) AS hash
  FROM part)"""

# Cleaning a name, in SQL: the stem goes through these steps in order.
SQL_STEM = "CASE WHEN {n} = '..' OR NOT regexp_matches({n}, '(?s)^.+\\.[^.]*$') THEN {n} ELSE regexp_extract({n}, '(?s)^(.+)\\.[^.]*$', 1) END"
SQL_EXT = "CASE WHEN {n} = '..' THEN '' ELSE regexp_extract({n}, '(?s)^.+(\\.[^.]*)$', 1) END"


def sql_stem(name: str) -> str:
    return SQL_STEM.format(n=name)


def sql_ext(name: str) -> str:
    return SQL_EXT.format(n=name)


def sql_normalized(name: str) -> str:
    stem = f"lower({sql_stem(name)})"
    for pattern, new in [
        ("^[0-9]+[-_\\s]+", ""), ("[-_]+$", ""), ("^[-_]+", ""), ("[-_]+", "-"), ("[^a-z0-9-]", ""), ("-+", "-"),
    ]:
        stem = f"regexp_replace({stem}, '{pattern}', '{new}', 'g')"
    return f"coalesce(nullif({stem}, ''), 'emoji') || lower({sql_ext(name)})"


def sql_trimmed(name: str) -> str:
    return f"coalesce(nullif(regexp_replace({sql_stem(name)}, '[-_\\s][1-3]$', ''), ''), 'emoji') || {sql_ext(name)}"


def earlier_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """An older catalog that shares some names and stems with the assets; some records have no labels."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS pos",
        "concat(replace(p_name, ' ', '_'), '-', p_partkey % 89, "
        "CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.bmp' ELSE '.gif' END) AS filename",
        "CASE WHEN p_size % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(lower(p_brand)) END AS categories",
        "CASE WHEN p_size % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(concat('k', p_partkey)) END AS tags",
    )


EARLIER = """earlier AS (
  SELECT p_partkey AS pos,
    replace(p_name, ' ', '_') || '-' || (p_partkey % 89)
      || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.bmp' ELSE '.gif' END AS filename,
    CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_brand) || '/k' || p_partkey END AS labels
  FROM part)"""


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: name from the source, bytes from the text."""
    return table(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS id",
        "concat(source, '-', doc_id, '.png') AS filename",
        "encode(text, 'UTF-8') AS content",
        "CAST(octet_length(text) AS BIGINT) AS size",
        "doc_id",
    )


BLOBS = """blobs AS (
  SELECT 'd' || doc_id AS id, source || '-' || doc_id || '.png' AS filename, encode(text) AS content,
    octet_length(encode(text))::BIGINT AS size, doc_id, text
  FROM documents)"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as search documents with filters, meta and sort keys."""
    return table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("/docs/"), "source", F.lit("/"), "doc_id").alias("url"),
        F.col("text").alias("content"),
        F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")).alias("filters"),
        F.create_map(F.lit("filename"), F.concat(F.lit("doc_"), "doc_id"), F.lit("source"), F.col("source")).alias("meta"),
        F.create_map(F.lit("filename"), F.concat(F.lit("doc_"), "doc_id"), F.lit("source"), F.col("source")).alias("sort"),
    )


def talk(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as a second corpus of the same shape."""
    return table(spark, sf, "conversations").select(
        (-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("doc_id"),
        F.lit("en").alias("lang"),
        F.col("text").alias("content"),
        F.create_map(F.lit("role"), F.array("role")).alias("filters"),
    )


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as search documents: their visible text, with the headings in it."""
    pages = extract_anchors(table(spark, sf, "pages"))
    return pages.select(
        F.col("page_id").alias("doc_id"), F.lit("en").alias("lang"), "url", F.col("url").alias("title"),
        visible_text(F.col("html")).alias("content"), "anchors",
    )


SQL_TAGS = (
    "(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<title\\b[^>]*>.*?</title\\s*>|<!--.*?-->|<[^>]*>"
)


def sql_visible(html: str) -> str:
    return f"trim(regexp_replace(regexp_replace({html}, '{SQL_TAGS}', ' ', 'g'), '\\s+', ' ', 'g'))"


PAGE_TEXTS = f"""page_heads AS (
  SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS inner_html, {sql_visible("split_part(html, '<h1', 1)")} AS lead
  FROM pages WHERE contains(html, '<h1')),
page_anchors AS (
  SELECT page_id AS doc_id, CASE WHEN lead = '' THEN 0 ELSE len(string_split(lead, ' ')) END::INT AS location, {sql_visible("inner_html")} AS heading
  FROM page_heads),
page_texts AS (SELECT page_id AS doc_id, url, {sql_visible("html")} AS text FROM pages)"""


DROPPED = "[\\p{Pd}\\p{Pe}\\p{Pf}\\p{Pi}\\p{Po}\\p{Ps}]"
BLANK = "[\\s\\x0B\\p{Z}\\x{FEFF}]"


def terms_sql(source: str, name: str = "terms") -> str:
    """CTEs ``{name}`` (doc_id, position, term_exact, term) and {name}_lens over a source of (doc_id, text)."""
    return f"""{name}_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS position
  FROM (SELECT doc_id, CASE WHEN contains(text, chr(8203)) THEN string_split(text, chr(8203))
                            ELSE regexp_split_to_array(text, '{BLANK}+') END AS w FROM {source})),
{name} AS (
  SELECT * FROM (
    SELECT doc_id, position, term_exact, strip_accents(term_exact) AS term
    FROM (SELECT doc_id, position, lower(regexp_replace(word, '{DROPPED}', '', 'g')) AS term_exact FROM {name}_words))
  WHERE term <> ''),
{name}_lens AS (
  SELECT s.doc_id, count(t.term)::BIGINT AS n_terms
  FROM {source} s LEFT JOIN {name} t USING (doc_id) GROUP BY s.doc_id)"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as selection actions on twenty items."""
    return table(spark, sf, "events").selectExpr(
        "user_id",
        "ts",
        "event_id AS seq",
        f"CASE event_type WHEN 'click' THEN '{TOGGLE}' WHEN 'view' THEN '{TOGGLE}' WHEN 'error' THEN '{RESET}' "
        f"WHEN 'purchase' THEN '{SELECT_ALL}' ELSE 'SET_GRID_SCALE' END AS op",
        "concat('i', event_id % 20) AS item_id",
        "CASE WHEN event_type = 'purchase' THEN "
        "transform(sequence(0, 4), i -> concat('i', (event_id + 3 * i) % 20)) END AS items",
    )


ACTIONS = """actions AS (
  SELECT user_id, ts, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'T' WHEN 'view' THEN 'T' WHEN 'error' THEN 'R' WHEN 'purchase' THEN 'A' ELSE '-' END AS op,
    'i' || (event_id % 20) AS item_id,
    list_transform(range(5), lambda i: 'i' || ((event_id + 3 * i) % 20)) AS items
  FROM events)"""

# Step by step over each user's events, as the closed form must come out.
FOLDED = ACTIONS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM actions),
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, []::VARCHAR[] AS chosen FROM actions
  UNION ALL
  SELECT f.user_id, a.n,
    CASE a.op WHEN 'R' THEN []::VARCHAR[] WHEN 'A' THEN a.items
      WHEN 'T' THEN CASE WHEN list_contains(f.chosen, a.item_id)
        THEN list_filter(f.chosen, lambda x: x <> a.item_id) ELSE list_append(f.chosen, a.item_id) END
      ELSE f.chosen END
  FROM fold f JOIN numbered a ON a.user_id = f.user_id AND a.n = f.n + 1),
selections AS (
  SELECT user_id, arg_max(chosen, n) AS chosen FROM fold GROUP BY user_id),
selected AS (
  SELECT user_id, unnest(range(1, len(chosen) + 1)) AS place, unnest(chosen) AS item_id FROM selections)"""


def action_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty items as assets, sized by the parts they stand for."""
    return (
        table(spark, sf, "part")
        .groupBy((F.col("p_partkey") % 20).alias("k"))
        .agg(F.sum(F.col("p_size").cast("bigint")).alias("size"), F.min("p_name").alias("name"))
        .select(
            F.concat(F.lit("i"), "k").alias("id"),
            "size",
            F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("."), F.lit("png")).alias("filename"),
        )
        .withColumn("path", N.asset_path(F.col("filename")))
    )


ACTION_CATALOG = """items AS (
  SELECT 'i' || k AS id, size, filename, '/emojis/' || filename AS path
  FROM (SELECT p_partkey % 20 AS k, sum(p_size)::BIGINT AS size, replace(min(p_name), ' ', '_') || '.png' AS filename
        FROM part GROUP BY 1))"""


def keystrokes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id", "ts", "event_id AS seq", "event_type AS term")
