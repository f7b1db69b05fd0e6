"""Queries over selections, their exports and typed terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import search as S
from ..operators import selection as O
from ..session import scratch_path
from ..sources import sinks as K
from ..streaming import selection as R
from ..streaming import terms as D
from . import views as V
from .registry import query

ORIGIN = "http://localhost:3000"


@query("fold_selection", f"WITH RECURSIVE {V.FOLDED} SELECT user_id, place, item_id FROM selected")
def _(spark, sf):
    return O.fold_selection(V.actions(spark, sf))


@query("selection_stream", f"WITH RECURSIVE {V.FOLDED} SELECT user_id, place, item_id FROM selected")
def _(spark, sf):
    # Three files with events of all days each: the second and third hold earlier events than the first has brought.
    dealt, table = scratch_path(spark, "events"), scratch_path(spark, "selection")
    V.actions(spark, sf).repartitionByRange(3, F.col("seq") % 3).write.parquet(dealt)
    events = spark.readStream.schema(V.actions(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(dealt)
    # Users are alike here: one key each.
    run = R.selection_stream(events, table, scratch_path(spark, "selection-checkpoint"), buckets=1, lateness="60 days")
    run.awaitTermination()
    return R.read_selection(spark, table)


@query("selection_snapshot", """WITH w AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'i' || event_id % 20 END AS item, ts, event_id FROM events)
SELECT 'u' || user_id AS key, coalesce(arg_max(coalesce(item, ''), event_id), '') AS items FROM w GROUP BY user_id""")
def _(spark, sf):
    writes = V.table(spark, sf, "events").selectExpr(
        "concat('u', user_id) AS key", "ts", "event_id AS seq",
        "CASE WHEN event_type = 'error' THEN '[broken' ELSE concat('[\"i', event_id % 20, '\"]') END AS payload",
    )
    return O.selection_snapshot(writes).select("key", F.array_join("items", ",").alias("items"))


@query("select_all_visible", """SELECT 1 AS query_id, row_number() OVER (ORDER BY 'doc_' || doc_id, doc_id) - 1 AS place,
  doc_id::VARCHAR AS item_id FROM documents WHERE lang = 'en'""")
def _(spark, sf):
    docs = V.corpus(spark, sf)
    hits = S.filter_only_search(docs, {"lang": "en"}).withColumn("query_id", F.lit(1))
    return O.select_all_visible(S.sort_hits(hits, docs, {"filename": "asc"}))


@query("selection_size", f"""WITH RECURSIVE {V.FOLDED}, {V.ACTION_CATALOG}
SELECT user_id, count(*)::BIGINT AS n_selected, round(sum(size) / 1024, 1) AS kilobytes
FROM selected s JOIN items i ON i.id = s.item_id GROUP BY user_id""")
def _(spark, sf):
    return O.selection_size(O.fold_selection(V.actions(spark, sf)), V.action_catalog(spark, sf))


@query("recent_items", f"""WITH {V.ACTIONS}, used AS (SELECT user_id, item_id, max(ts) AS last_used, max(seq) AS seq FROM actions GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, seq DESC, item_id)::INT AS place, item_id,
  strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used
FROM used QUALIFY place <= 5""")
def _(spark, sf):
    recent = O.recent_items(V.actions(spark, sf), 5)
    return recent.withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("debounce_terms", """WITH k AS (
  SELECT user_id, ts, event_id AS seq, event_type AS term, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT user_id, seq, term, CASE WHEN next IS NULL OR next - ts >= INTERVAL 30 MINUTE THEN term END AS searched FROM k""")
def _(spark, sf):
    return O.debounce_terms(V.keystrokes(spark, sf), 30 * 60 * 1000).select("user_id", "seq", "term", "searched")


SETTLED = """WITH k AS (
  SELECT user_id, ts, event_type AS term, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, term FROM k WHERE next IS NULL OR next - ts >= INTERVAL 30 MINUTE"""


@query("settled_terms", SETTLED)
def _(spark, sf):
    terms = D.settled_terms(V.keystrokes(spark, sf), 30 * 60 * 1000)
    return terms.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "term")


@query("settled_terms_stream", SETTLED)
def _(spark, sf):
    schema = V.table(spark, sf, "events").schema
    stored = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    typed = stored.selectExpr("user_id", "ts", "event_id AS seq", "event_type AS term")
    path, checkpoint = scratch_path(spark, "terms"), scratch_path(spark, "terms-checkpoint")
    D.write_settled(D.settled_terms(typed, 30 * 60 * 1000), path, checkpoint).awaitTermination()
    terms = D.read_settled(spark, path, checkpoint)
    return terms.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "term")


# ---- export -------------------------------------------------------------------------------

CHOSEN = f"""{V.FOLDED}, {V.ACTION_CATALOG},
chosen AS (SELECT s.user_id, s.place, i.* FROM selected s JOIN items i ON i.id = s.item_id)"""


def _chosen(spark, sf):
    selection = O.fold_selection(V.actions(spark, sf))
    items = V.action_catalog(spark, sf).withColumnRenamed("id", "item_id")
    return selection.join(items, "item_id").withColumn("id", F.col("item_id"))


def _exported(expression, extra=""):
    return f"WITH RECURSIVE {CHOSEN} SELECT user_id, place, {expression} AS line FROM chosen{extra}"


@query("export_text", _exported("filename"))
def _(spark, sf):
    return E.export_text(_chosen(spark, sf))


@query("export_html", _exported(f"""'<img src="{ORIGIN}' || path || '" alt="' || filename || '" />'"""))
def _(spark, sf):
    return E.export_html(_chosen(spark, sf), ORIGIN)


@query("export_css", _exported(f"""'.emoji-' || id || ' {{' || chr(10) || '  background-image: url(''{ORIGIN}' || path || ''');' || chr(10)
  || '  background-size: contain;' || chr(10) || '  background-repeat: no-repeat;' || chr(10) || '  background-position: center;' || chr(10) || '}}'"""))
def _(spark, sf):
    return E.export_css(_chosen(spark, sf), ORIGIN)


@query("export_markdown", _exported(
    f"""'| ![' || filename || '](' || '{ORIGIN}' || path || ') | ' || filename || ' |'""",
    " UNION ALL SELECT DISTINCT user_id, -1, '| Emoji | Filename |' || chr(10) || '|---|---|' FROM chosen",
))
def _(spark, sf):
    return E.export_markdown(_chosen(spark, sf), ORIGIN)


@query("text_sink", _exported("filename"))
def _(spark, sf):
    path = scratch_path(spark, "lines")
    lines = E.export_text(_chosen(spark, sf))
    K.write_lines(lines.select("user_id", "place", F.concat_ws("\t", "place", "line").alias("line")), path)
    stored = spark.read.schema("value string, user_id bigint").text(path)
    parts = F.split("value", "\t")
    return stored.select("user_id", parts[0].cast("bigint").alias("place"), parts[1].alias("line"))


@query("export_bundle", f"""WITH {V.BLOBS}
SELECT id, filename, size AS size_bytes FROM blobs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(spark, sf):
    good = V.table(spark, sf, "labels").where("quality = 1")
    selection = good.select(F.concat(F.lit("d"), "doc_id").alias("item_id"))
    return E.bundle_manifest(E.export_bundle(selection, V.blobs(spark, sf)))


@query("pack_by_size", f"""WITH RECURSIVE {V.BLOBS}, ordered AS (
  SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, filename, doc_id) AS n FROM blobs),
packed AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS doc_id, 1::BIGINT AS part, 0::BIGINT AS filled
  UNION ALL
  SELECT o.n, o.doc_id, CASE WHEN p.filled >= 50000 THEN p.part + 1 ELSE p.part END,
    CASE WHEN p.filled >= 50000 THEN o.size ELSE p.filled + o.size END
  FROM packed p JOIN ordered o ON o.n = p.n + 1)
SELECT doc_id, part FROM packed WHERE n > 0""")
def _(spark, sf):
    packed = E.pack_by_size(V.blobs(spark, sf), 50_000, order=["filename", "doc_id"])
    return packed.select("doc_id", "part")
