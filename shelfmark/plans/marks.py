"""Queries that highlight texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as M
from . import views as V
from .registry import query

OPEN, CLOSE = '<mark data-markjs="true">', "</mark>"
PLAIN = M.MarkOptions(diacritics=False)
KEYWORDS = ["the and", "tion", "en"]
PATTERN = "(tion|the|and|en)"


def _texts(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text")


def _marked(spark, sf, terms, options):
    text = F.col("text")
    return _texts(spark, sf).select(
        "doc_id",
        M.count_marks(text, terms, options).cast("bigint").alias("n_marks"),
        F.md5(M.mark_keywords(text, terms, options)).alias("marked"),
    )


def _sql(pattern, flags="gi", open_tag=OPEN):
    return f"""SELECT doc_id, len(regexp_extract_all(text, '(?{flags.replace("g", "") or "s"}){pattern}'))::BIGINT AS n_marks,
  md5(regexp_replace(text, '{pattern}', '{open_tag}\\1{CLOSE}', '{flags}')) AS marked FROM documents"""


@query("highlight_terms", _sql(PATTERN))
def _(spark, sf):
    return _marked(spark, sf, KEYWORDS, PLAIN)


@query("highlight_case_sensitive", _sql("(The and|Ère)", "g", '<em data-markjs="true" class="hit">').replace(CLOSE, "</em>"))
def _(spark, sf):
    options = M.MarkOptions(
        element="em", class_name="hit", separate_words=False, case_sensitive=True, diacritics=False
    )
    return _marked(spark, sf, ["The and", "Ère"], options)


E_GROUP = "eèéẻẽẹêềếểễệëěēęEÈÉẺẼẸÊỀẾỂỄỆËĚĒĘ"
N_GROUP = "nñňńNÑŇŃ"


@query("highlight_accents", _sql(f"([{E_GROUP}][{N_GROUP}])"))
def _(spark, sf):
    return _marked(spark, sf, ["en"], M.MarkOptions())


@query("unmatched_keywords", """SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(lower(text), 'tion') THEN 'tion' END,
  CASE WHEN NOT contains(lower(text), 'the') THEN 'the' END, CASE WHEN NOT contains(lower(text), 'and') THEN 'and' END,
  CASE WHEN NOT contains(lower(text), 'en') THEN 'en' END) AS unmatched FROM documents""")
def _(spark, sf):
    missing = M.unmatched_keywords(F.col("text"), KEYWORDS, PLAIN)
    return _texts(spark, sf).select("doc_id", F.array_join(missing, ",").alias("unmatched"))


OUTSIDE = "[^\\s!-/:-@\\[-`{-~¡¿]*"


@query("match_accuracy_complementary", _sql(f"({OUTSIDE}(?:the|and){OUTSIDE})"))
def _(spark, sf):
    return _marked(spark, sf, ["the and"], M.MarkOptions(diacritics=False, accuracy="complementary"))


@query("match_accuracy_exactly", """SELECT doc_id,
  len(list_filter(regexp_split_to_array(lower(text), '\\s'), lambda w: w IN ('the', 'and')))::BIGINT AS n_marks FROM documents""")
def _(spark, sf):
    options = M.MarkOptions(diacritics=False, accuracy="exactly")
    return _marked(spark, sf, ["the and"], options).select("doc_id", "n_marks")


@query("match_accuracy_limiters", """SELECT doc_id,
  len(list_filter(regexp_split_to_array(lower(text), '[\\s,.]'), lambda w: w IN ('the', 'and')))::BIGINT AS n_marks FROM documents""")
def _(spark, sf):
    options = M.MarkOptions(diacritics=False, accuracy="exactly", limiters=[",", "."])
    return _marked(spark, sf, ["the and"], options).select("doc_id", "n_marks")


@query("match_synonyms", _sql("(the|une)"))
def _(spark, sf):
    return _marked(spark, sf, ["the"], M.MarkOptions(diacritics=False, synonyms={"une": "the"}))


@query("match_wildcards", _sql("(t\\S?on\\S*)"))
def _(spark, sf):
    return _marked(spark, sf, ["t?on*"], M.MarkOptions(diacritics=False, wildcards="enabled"))


@query("match_joiners", _sql("(t[-.­​‌‍]*h[-.­​‌‍]*e)"))
def _(spark, sf):
    options = M.MarkOptions(diacritics=False, ignore_joiners=True, ignore_punctuation=["-", "."])
    return _marked(spark, sf, ["the"], options)


@query("mark_regexp", f"""SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '{OPEN}\\0{CLOSE}', 'g')) AS numbers,
  md5(regexp_replace(text, '(\\s)([A-Z][a-z]+)(\\s)', '\\1{OPEN}\\2{CLOSE}\\3', 'g')) AS names FROM documents""")
def _(spark, sf):
    text = F.col("text")
    return _texts(spark, sf).select(
        "doc_id",
        F.md5(M.mark_regexp(text, "[0-9]+")).alias("numbers"),
        F.md5(M.mark_regexp(text, r"(\s)([A-Z][a-z]+)(\s)", ignore_groups=1)).alias("names"),
    )


# Ranges of each document: some inside, some overlapping, one empty, one past its end.
RANGES = [("3", "10"), ("0", "5"), ("8", "4"), ("20", "0"), ("n - 5", "50"), ("n + 3", "2"), ("n div 2", "7")]


@query("mark_ranges", f"""WITH given AS (
  SELECT doc_id, text, length(text) AS n FROM documents),
ranges AS ({' UNION ALL '.join(f"SELECT doc_id, text, n, {s.replace('div', '//')} AS start, {l} AS len FROM given" for s, l in RANGES)}),
ordered AS (
  SELECT *, start + len AS stop, coalesce(max(start + len) OVER (PARTITION BY doc_id ORDER BY start, len
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM ranges WHERE len > 0),
cut AS (
  SELECT doc_id, text, n, least(greatest(start, greatest(last, 0)), n) AS b, least(stop, n) AS e FROM ordered WHERE stop > greatest(last, 0)),
taken AS (SELECT * FROM cut WHERE regexp_matches(substr(text, b + 1, e - b), '\\S')),
pieces AS (
  SELECT doc_id, b, substr(text, coalesce(lag(e) OVER w, 0) + 1, b - coalesce(lag(e) OVER w, 0)) || '{OPEN}' || substr(text, b + 1, e - b) || '{CLOSE}' AS piece, e
  FROM taken WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY b) AS head, max(e) AS last, count(*) AS n_marks FROM pieces GROUP BY doc_id)
SELECT g.doc_id, coalesce(n_marks, 0)::BIGINT AS n_marks, md5(coalesce(head, '') || substr(text, coalesce(last, 0) + 1)) AS marked
FROM given g LEFT JOIN joined j USING (doc_id)""")
def _(spark, sf):
    rows = _texts(spark, sf).withColumn("n", F.length("text"))
    ranges = F.array(*[
        F.struct(F.expr(f"CAST({s} AS INT)").alias("start"), F.expr(f"CAST({l} AS INT)").alias("length")) for s, l in RANGES
    ])
    text = F.col("text")
    return rows.select(
        "doc_id",
        F.size(M.markable_ranges(text, ranges)).cast("bigint").alias("n_marks"),
        F.md5(M.mark_ranges(text, ranges)).alias("marked"),
    )


@query("unmark", "SELECT doc_id, md5(text) AS plain, true AS was_marked FROM documents WHERE regexp_matches(text, '(?i)(tion|the|and|en)')")
def _(spark, sf):
    marked = M.mark_keywords(F.col("text"), KEYWORDS, PLAIN)
    rows = _texts(spark, sf).select("doc_id", "text", marked.alias("marked")).where("marked <> text")
    return rows.select("doc_id", F.md5(M.unmark(F.col("marked"))).alias("plain"), F.lit(True).alias("was_marked"))


@query("highlight_from_url", """SELECT page_id, list_aggregate(list_transform(regexp_extract_all(
  regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), '^', '&'), '&ref=([^&]*)', 1), lambda t: url_decode(t)), 'string_agg', ',') AS terms
FROM pages WHERE contains(url, 'ref=')""")
def _(spark, sf):
    pages = V.table(spark, sf, "pages").withColumn("terms", M.url_terms(F.col("url"), "ref"))
    return pages.where(F.size("terms") > 0).select("page_id", F.array_join("terms", ",").alias("terms"))
