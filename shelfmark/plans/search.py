"""Queries over indexes, searches, facets, excerpts, fuzzy and vector lookup."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facets as A
from ..operators import fuzzy as Z
from ..operators import index as X
from ..operators import search as S
from ..operators import sections as P
from ..operators import vectors as W
from ..session import scratch_path
from . import views as V
from .registry import query

TERMS = ["the and", "Ère, UN", "tion en", '"of the"', "zzzzz", "  ...  ", "ouon"]
# Number of the quoted one.
PHRASE = 4


def _queries(spark):
    return S.queries_from(spark, TERMS)


# Where the index of a corpus is stored, by application and folder of the tables.
_PATHS: dict[tuple[str, str, str], str] = {}


def _index(spark, sf, corpus=V.corpus):
    """The stored index of a corpus: written by the first query that asks for it, read again by all others."""
    key = (spark.sparkContext.applicationId, sf, corpus.__name__)
    if key in _PATHS:
        try:
            return X.read_index(spark, _PATHS[key])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    path = scratch_path(spark, "index")
    X.write_index(X.build_index(corpus(spark, sf)), path)
    _PATHS[key] = path
    return X.read_index(spark, path)


def _sql_values(terms):
    rows = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(terms, 1))
    return f"queries(query_id, term) AS (VALUES {rows})"


DOCS = "docs AS (SELECT doc_id, lang, source, text FROM documents)"
Q_WORDS = f"""{_sql_values(TERMS)}, normal AS (
  SELECT query_id, trim(regexp_replace(lower(regexp_replace(term, '{V.DROPPED}', '', 'g')), '\\s{{2,}}', ' ', 'g')) AS term_exact
  FROM queries),
q_words AS (
  SELECT query_id, word_exact, strip_accents(word_exact) AS word, count(*) OVER (PARTITION BY query_id) AS n_words
  FROM (SELECT DISTINCT query_id, unnest(string_split(term_exact, ' ')) AS word_exact FROM normal WHERE term_exact <> ''))"""
INDEX = f"{DOCS}, {V.terms_sql('docs')}"


def _scored(matching: str, whole: str = "TRUE") -> str:
    """CTEs up to ``hits`` for a match condition between a term t and a query word w; ``whole`` holds for quoted words."""
    return f"""{INDEX}, {Q_WORDS}, postings AS (
  SELECT term, term_exact, doc_id, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
matches AS (
  SELECT w.query_id, w.word, w.n_words, t.doc_id, t.tf, length(w.word) / length(t.term) AS bonus,
    CASE WHEN starts_with(t.term_exact, w.word_exact) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS accents
  FROM postings t JOIN q_words w ON {matching} AND (w.query_id <> {PHRASE} OR {whole})),
phrases AS (
  SELECT DISTINCT a.doc_id FROM terms a JOIN terms b ON b.doc_id = a.doc_id AND b.position = a.position + 1
  WHERE a.term = 'of' AND b.term = 'the'),
per_word AS (
  SELECT query_id, word, n_words, doc_id, sum(tf)::BIGINT AS raw_tf, sum(tf * bonus * accents) AS wtf, max(bonus) AS bonus
  FROM matches GROUP BY ALL),
df AS (SELECT query_id, word, count(*)::BIGINT AS df FROM per_word GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT AS n, avg(n_terms) AS avg_terms FROM terms_lens),
scored AS (
  SELECT p.*, d.df, l.n_terms, c.n, c.avg_terms, ln(1 + (c.n - d.df + 0.5) / (d.df + 0.5)) AS idf,
    wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * l.n_terms / c.avg_terms)) AS saturating
  FROM per_word p JOIN df d USING (query_id, word) JOIN terms_lens l USING (doc_id) CROSS JOIN corpus c),
hits AS (
  SELECT query_id, doc_id, round(sum(idf * saturating), 9) AS score FROM scored
  WHERE query_id <> {PHRASE} OR doc_id IN (SELECT doc_id FROM phrases)
  GROUP BY query_id, doc_id, n_words HAVING count(*) = n_words)"""


# Words as they match by themselves, and as a search takes them.
MATCHED = _scored("starts_with(t.term, w.word)")
HITS = _scored("starts_with(t.term, w.word)", "t.term = w.word")


@query("index_documents", f"""WITH {V.CATALOG}
SELECT id AS doc_id, 'en' AS lang, path AS url, array_to_string(list_concat(categories, tags), ', ') AS content,
  id || '|' || size || '|' || filename || '|' || filename || '|' || path || '|' || strftime(created, '%Y-%m-%d') AS meta,
  strftime(created, '%Y-%m-%d') || '|' || filename AS sort FROM catalog""")
def _(spark, sf):
    keys = ["id", "size", "filename", "fileBaseName", "path", "created"]
    meta = F.concat_ws("|", *[F.element_at("meta", k) for k in keys])
    sort = F.concat_ws("|", F.element_at("sort", "created"), F.element_at("sort", "filename"))
    docs = X.index_documents(V.catalog(spark, sf))
    return docs.select("doc_id", "lang", "url", "content", meta.alias("meta"), sort.alias("sort"))


@query("full_text_documents", f"""WITH {V.CATALOG}, every AS (
  SELECT pos, lower(label) AS label, place FROM (
    SELECT pos, unnest(l) AS label, unnest(range(len(l))) AS place FROM (
      SELECT pos, list_concat(list_concat([filename], categories), tags) AS l FROM catalog))),
texts AS (SELECT pos, string_agg(label, ', ' ORDER BY place) AS text
  FROM (SELECT pos, label, min(place) AS place FROM every GROUP BY pos, label) GROUP BY pos)
SELECT id, path AS url, text, filename, size::VARCHAR AS size, strftime(created, '%Y-%m-%d') AS created
FROM catalog JOIN texts USING (pos)""")
def _(spark, sf):
    docs = X.full_text_documents(V.catalog(spark, sf))
    return docs.select("id", "url", "text", "filename", "size", F.col("created").cast("string").alias("created"))


@query("field_index", f"""WITH {V.CATALOG}, fields AS (
  SELECT id, 'url' AS field, path AS value FROM catalog UNION ALL
  SELECT id, 'content', array_to_string(list_concat(categories, tags), ', ') FROM catalog)
SELECT id, field, value, len(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS n_tokens FROM fields""")
def _(spark, sf):
    return X.field_index(V.catalog(spark, sf))


@query("normalize_term", f"""SELECT doc_id, md5(lower(regexp_replace(text, '{V.DROPPED}', '', 'g'))) AS lowered,
  md5(trim(strip_accents(regexp_replace(regexp_replace(lower(regexp_replace(text, '{V.DROPPED}', '', 'g')),
    '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')))) AS normalized FROM documents""")
def _(spark, sf):
    text = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.lower(T.strip_punctuation(text))).alias("lowered"),
        F.md5(T.normalize_term(text)).alias("normalized"),
    )


@query("build_postings", f"""WITH {INDEX}
SELECT term, term_exact, doc_id, count(*)::BIGINT AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
FROM terms GROUP BY term, term_exact, doc_id""")
def _(spark, sf):
    postings = X.build_postings(V.corpus(spark, sf))
    places = F.array_join(F.col("positions").cast("array<string>"), ",")
    return postings.select("term", "term_exact", "doc_id", "tf", places.alias("positions"))


@query("term_statistics", f"""WITH {INDEX}
SELECT d.lang, term, count(DISTINCT doc_id)::BIGINT AS doc_frequency, count(*)::BIGINT AS occurrences
FROM terms JOIN documents d USING (doc_id) GROUP BY ALL""")
def _(spark, sf):
    return X.term_statistics(X.build_postings(V.corpus(spark, sf)))


@query("document_statistics", f"""WITH {INDEX}
SELECT count(*)::BIGINT AS n_docs, round(avg(n_terms), 6) AS avg_terms FROM terms_lens""")
def _(spark, sf):
    stats = X.document_statistics(X.document_lengths(V.corpus(spark, sf)))
    return stats.withColumn("avg_terms", F.round("avg_terms", 6))


@query("document_lengths", f"WITH {INDEX} SELECT doc_id, n_terms FROM terms_lens")
def _(spark, sf):
    return X.document_lengths(V.corpus(spark, sf)).select("doc_id", "n_terms")


@query("language_entries", "SELECT lang, count(*)::BIGINT AS page_count FROM documents GROUP BY lang")
def _(spark, sf):
    return X.language_entries(V.corpus(spark, sf))


# ---- matching and scoring -----------------------------------------------------------------


@query("match_words", f"""WITH {MATCHED}
SELECT query_id, word, doc_id, raw_tf, round(bonus, 6) AS length_bonus FROM per_word""")
def _(spark, sf):
    index = _index(spark, sf)
    matches = S.match_words(index, S.query_words(_queries(spark)))
    return matches.groupBy("query_id", "word", "doc_id").agg(
        F.sum("tf").alias("raw_tf"), F.round(F.max("length_bonus"), 6).alias("length_bonus")
    )


@query("bm25_explain", f"""WITH {MATCHED}
SELECT query_id, word, doc_id, raw_tf, round(wtf, 4) AS weighted_term_frequency, df AS pages_containing_term,
  n_terms AS document_length, round(avg_terms, 4) AS average_page_length, n AS total_pages, round(idf, 4) AS idf,
  round(saturating, 4) AS saturating_tf, round(idf * saturating, 4) AS score FROM scored""")
def _(spark, sf):
    index = _index(spark, sf)
    scored = S.score_words(index, S.match_words(index, S.query_words(_queries(spark))))
    rounded = ["weighted_term_frequency", "average_page_length", "idf", "saturating_tf", "score"]
    plain = ["query_id", "word", "doc_id", "raw_tf", "pages_containing_term", "document_length", "total_pages"]
    return scored.select(*plain, *[F.round(c, 4).alias(c) for c in rounded])


def _hits(spark, sf):
    index = _index(spark, sf)
    return index, S.search(index, _queries(spark), locations=False)


@query("search", f"WITH {HITS} SELECT query_id, doc_id, round(score, 4) AS score FROM hits")
def _(spark, sf):
    return _hits(spark, sf)[1].select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("search_request", f"""WITH {HITS} SELECT query_id, doc_id, round(score, 4) AS score FROM hits
UNION ALL SELECT {len(TERMS) + 1}, doc_id, 0.0 FROM docs""")
def _(spark, sf):
    index = _index(spark, sf)
    # A term that is missing asks for every document.
    hits = S.search(index, S.queries_from(spark, [*TERMS, None]), locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("filtered_requests", f"""WITH {HITS}, every AS (
  SELECT query_id, doc_id, score FROM hits UNION ALL SELECT {len(TERMS) + 1}, doc_id, 0.0 FROM docs),
passed AS (
  SELECT query_id, doc_id, score, 'doc_' || doc_id AS filename FROM every JOIN docs USING (doc_id)
  WHERE query_id = 1 AND lang = 'en' OR query_id = 3 AND source = 'src1' OR query_id = 4 OR query_id = {len(TERMS) + 1} AND lang = 'fr' AND source = 'src3')
SELECT query_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN query_id = 1 THEN filename END, CASE WHEN query_id > 4 THEN filename END DESC, score DESC, doc_id) AS rank FROM passed""")
def _(spark, sf):
    requests = [
        (1, TERMS[0], {"lang": ["en"]}, "filename", False), (3, TERMS[2], {"source": ["src1"]}, None, None), (4, TERMS[3], None, None, None),
        (len(TERMS) + 1, None, {"lang": ["fr"], "source": ["src3"]}, "filename", True),
    ]
    schema = "query_id int, term string, filters map<string,array<string>>, sort string, descending boolean"
    hits = S.search_requests(_index(spark, sf), spark.createDataFrame(requests, schema))
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query("search_stored_index", f"WITH {HITS} SELECT query_id, doc_id, round(score, 4) AS score FROM hits")
def _(spark, sf):
    path = scratch_path(spark, "index")
    X.write_index(X.build_index(V.corpus(spark, sf)), path)
    hits = S.search(X.read_index(spark, path), _queries(spark), locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


ANY = _scored("t.term = w.word").replace("HAVING count(*) = n_words", "")


@query("search_any_word", f"WITH {ANY} SELECT query_id, doc_id, round(score, 4) AS score FROM hits")
def _(spark, sf):
    index = _index(spark, sf)
    hits = S.search(index, _queries(spark), prefix=False, match_all=False, locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


EXACT = _scored("starts_with(t.term_exact, w.word_exact)", "t.term_exact = w.word_exact")


@query("exact_diacritics", f"WITH {EXACT} SELECT query_id, doc_id, round(score, 4) AS score FROM hits")
def _(spark, sf):
    index = _index(spark, sf)
    hits = S.search(index, _queries(spark), exact_diacritics=True, locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("meta_weights", f"""WITH {HITS}, idfs AS (SELECT DISTINCT query_id, word, idf FROM scored),
fields AS (SELECT doc_id, 'filename' AS field, strip_accents('doc' || chr(95) || doc_id) AS word FROM docs
  UNION ALL SELECT doc_id, 'source', source FROM docs),
boosts AS (
  SELECT i.query_id, f.doc_id, sum(CASE field WHEN 'source' THEN 2.0 ELSE 1.0 END * idf / total) AS boost
  FROM fields f JOIN idfs i USING (word) JOIN (SELECT query_id, sum(idf) AS total FROM idfs GROUP BY query_id) USING (query_id)
  GROUP BY ALL)
SELECT query_id, doc_id, round(score * (1 + coalesce(boost, 0)), 4) AS score FROM hits LEFT JOIN boosts USING (query_id, doc_id)""")
def _(spark, sf):
    index = _index(spark, sf)
    ranking = S.Ranking(meta_weights={"source": 2.0, "filename": 1.0})
    hits = S.search(index, _queries(spark), ranking, locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("ranking_options", f"""WITH {HITS}, other AS (
  SELECT m.query_id, m.word, m.n_words, m.doc_id, sum(m.tf * m.accents) AS wtf FROM matches m GROUP BY ALL),
blended AS (
  SELECT o.query_id, o.doc_id, o.n_words,
    s.idf * (0.5 * o.wtf * 3.0 / (o.wtf + 2.0 * (0.5 + 0.5 * s.n_terms / s.avg_terms)) + 0.5 * o.wtf) AS part
  FROM other o JOIN scored s USING (query_id, word, doc_id))
SELECT query_id, doc_id, round(sum(part), 4) AS score FROM blended
WHERE query_id <> {PHRASE} OR doc_id IN (SELECT doc_id FROM phrases) GROUP BY query_id, doc_id, n_words HAVING count(*) = n_words""")
def _(spark, sf):
    index = _index(spark, sf)
    ranking = S.Ranking(term_similarity=0.0, page_length=0.5, term_saturation=2.0, term_frequency=0.5)
    hits = S.search(index, _queries(spark), ranking, locations=False)
    return hits.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("empty_term", f"""WITH {HITS}, counted AS (SELECT query_id, count(*)::BIGINT AS n FROM hits GROUP BY query_id)
SELECT q.query_id, n.term_exact = '' AS blank, coalesce(c.n, 0)::BIGINT AS n
FROM queries q JOIN normal n USING (query_id) LEFT JOIN counted c USING (query_id)""")
def _(spark, sf):
    _, hits = _hits(spark, sf)
    counts = S.count_hits(hits, S.normalize_queries(_queries(spark)))
    return counts.select("query_id", (F.col("normalized") == "").alias("blank"), "n")


@query("app_search", f"""WITH {V.CATALOG}
SELECT 'blank' AS kind, id FROM catalog
UNION ALL SELECT 'gear', id FROM catalog WHERE len(list_filter(list_concat(categories, tags), lambda x: starts_with(x, 'gear'))) > 0""")
def _(spark, sf):
    catalog = V.catalog(spark, sf)
    index = X.build_index(X.index_documents(catalog))
    blank = S.app_search(catalog, index, " ").select(F.lit("blank").alias("kind"), "id")
    return blank.unionByName(S.app_search(catalog, index, " Gear").select(F.lit("gear").alias("kind"), "id"))


@query("filter_only_search", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE lang = 'fr' AND source = 'src3'")
def _(spark, sf):
    return S.filter_only_search(V.corpus(spark, sf), S.parse_filter_pills(["lang:fr", "source:src3"]))


@query("phrase_search", f"""WITH {INDEX}
SELECT 4 AS query_id, a.doc_id, a.position::INT AS start FROM terms a JOIN terms b
  ON b.doc_id = a.doc_id AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the'""")
def _(spark, sf):
    return S.phrase_search(_index(spark, sf), _queries(spark))


# ---- filters, facets, order ---------------------------------------------------------------

PASSING = f"""{HITS}, flagged AS (
  SELECT h.*, d.lang, d.source, d.lang = 'en' AND d.source IN ('src1', 'src2') AS passes FROM hits h JOIN docs d USING (doc_id)),
facets AS (
  SELECT query_id, filter, value, count(*) FILTER (passes)::BIGINT AS n_filtered, count(*)::BIGINT AS n_total
  FROM (SELECT query_id, passes, 'lang' AS filter, lang AS value FROM flagged
        UNION ALL SELECT query_id, passes, 'source', source FROM flagged) GROUP BY ALL),
totals AS (SELECT query_id, count(*) FILTER (passes)::BIGINT AS n_filtered, count(*)::BIGINT AS n_unfiltered FROM flagged GROUP BY ALL)"""
WANTED = {"lang": ["en"], "source": ["src1", "src2"]}


def _flagged(spark, sf):
    index, hits = _hits(spark, sf)
    return S.apply_filters(hits, index.docs, S.wanted_map(WANTED), mode="any")


@query("attribute_filters", f"""WITH {PASSING}
SELECT query_id, doc_id, passes, lang = 'en' AND false AS passes_all FROM flagged""")
def _(spark, sf):
    flagged = _flagged(spark, sf)
    # A document has one source, so it cannot carry all of two.
    strict = S.passes(F.col("filters"), S.wanted_map(WANTED), mode="all")
    return flagged.select("query_id", "doc_id", "passes", strict.alias("passes_all"))


@query("with_category", f"WITH {V.ASSETS} SELECT pos, filename FROM assets WHERE list_contains(categories, 'small')")
def _(spark, sf):
    return S.with_category(V.assets(spark, sf), "small").select("pos", "filename")


@query("distinct_categories", f"WITH {V.ASSETS} SELECT DISTINCT unnest(categories) AS category FROM assets")
def _(spark, sf):
    return S.distinct_categories(V.assets(spark, sf))


@query("facet_counts", f"WITH {PASSING} SELECT * FROM facets")
def _(spark, sf):
    return A.facet_counts(_flagged(spark, sf))


@query("unfiltered_counts", f"WITH {PASSING} SELECT * FROM totals")
def _(spark, sf):
    return A.unfiltered_counts(_flagged(spark, sf))


@query("index_facets", """SELECT 'lang' AS filter, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY ALL""")
def _(spark, sf):
    return A.index_facets(V.corpus(spark, sf))


def _view(order):
    return f"""WITH {PASSING}, shown AS (
  SELECT query_id, filter, value, CASE WHEN value = 'src5' THEN n_total ELSE n_filtered END AS n, 1 AS tier FROM facets
  WHERE n_filtered > 0 OR value = 'src5'
  UNION ALL SELECT DISTINCT f.query_id, f.filter, 'All', t.n_unfiltered, 0 FROM facets f JOIN totals t USING (query_id))
SELECT query_id, filter, value, n,
  row_number() OVER (PARTITION BY query_id, filter ORDER BY tier, {order} value) AS position FROM shown"""


def _facet_view(spark, sf, order):
    flagged = _flagged(spark, sf)
    return A.facet_view(A.facet_counts(flagged), A.unfiltered_counts(flagged), order, selected=["src5"])


@query("facet_view", _view(""))
def _(spark, sf):
    return _facet_view(spark, sf, "alphabetical")


@query("facet_view_by_count", _view("n DESC,"))
def _(spark, sf):
    return _facet_view(spark, sf, "count-desc")


@query("facet_view_in_given_order", _view("CASE value WHEN 'src2' THEN 1 WHEN 'src5' THEN 2 ELSE 3 END,"))
def _(spark, sf):
    return _facet_view(spark, sf, ["src2", "src5"])


@query("sort_hits", f"""WITH {HITS}
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY 'doc_' || doc_id, doc_id) AS rank FROM hits""")
def _(spark, sf):
    index, hits = _hits(spark, sf)
    return S.sort_hits(hits, index.docs, {"filename": "asc"}).select("query_id", "doc_id", "rank")


@query("top_hits", f"""WITH {HITS}
SELECT query_id, doc_id, round(score, 4) AS score FROM hits
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50""")
def _(spark, sf):
    _, hits = _hits(spark, sf)
    best = S.top_hits(hits, 50)
    return best.select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("page_hits", f"""WITH {HITS}
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM hits
QUALIFY rank <= 15""")
def _(spark, sf):
    _, hits = _hits(spark, sf)
    shown = S.page_hits(hits, page=3)
    return shown.select("query_id", "doc_id", "rank")


@query("full_text_topk", f"""WITH {HITS}
SELECT query_id, doc_id, '/docs/' || source || '/' || doc_id AS url, md5(text) AS text, round(score, 3) AS score
FROM hits JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20""")
def _(spark, sf):
    best = S.full_text_topk(_index(spark, sf), _queries(spark), 20)
    return best.select("query_id", "doc_id", "url", F.md5("text").alias("text"), F.round("score", 3).alias("score"))


# ---- around a search ----------------------------------------------------------------------

TURNS = """turns AS (SELECT -(conv_id * 1000 + turn) - 1 AS doc_id, role, text FROM conversations)"""


def _plain_hits(prefix, source):
    """CTEs {prefix}_hits: equality search for the single words the, and over one corpus."""
    return f"""{V.terms_sql(source, prefix)}, {prefix}_tf AS (
  SELECT CASE term WHEN 'the' THEN 1 ELSE 2 END AS query_id, doc_id, count(*) AS tf FROM {prefix} WHERE term IN ('the', 'and') GROUP BY ALL),
{prefix}_df AS (SELECT query_id, count(*) AS df FROM {prefix}_tf GROUP BY ALL),
{prefix}_c AS (SELECT count(*) AS n, avg(n_terms) AS a FROM {prefix}_lens),
{prefix}_hits AS (
  SELECT query_id, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / a)) AS score
  FROM {prefix}_tf JOIN {prefix}_df USING (query_id) JOIN {prefix}_lens USING (doc_id) CROSS JOIN {prefix}_c)"""


MERGED = f"""{DOCS}, {TURNS}, {_plain_hits('a', 'docs')}, {_plain_hits('b', 'turns')}, merged AS (
  SELECT query_id, doc_id, score, 0 AS index_number, 'documents' AS site FROM a_hits
  UNION ALL SELECT query_id, doc_id, score * 0.5, 1, 'talk' FROM b_hits)"""


def _merged(spark, sf):
    queries = S.queries_from(spark, ["the", "and"])
    parts = []
    for corpus, weight, site in [(V.corpus, 1.0, "documents"), (V.talk, 0.5, "talk")]:
        index = _index(spark, sf, corpus)
        hits = S.search(index, queries, prefix=False, locations=False).join(index.docs.select("doc_id", "filters"), "doc_id")
        parts.append((hits.select("query_id", "doc_id", "score", "filters"), weight, {"site": site}))
    return S.merge_indexes(parts)


@query("merge_indexes", f"WITH {MERGED} SELECT query_id, doc_id, round(score, 4) AS score, index_number, site FROM merged")
def _(spark, sf):
    return _merged(spark, sf).select(
        "query_id", "doc_id", F.round("score", 4).alias("score"), "index_number",
        F.get(F.element_at("filters", "site"), 0).alias("site"),
    )


@query("merge_facets", f"""WITH {MERGED}, valued AS (
  SELECT query_id, 'site' AS filter, site AS value FROM merged
  UNION ALL SELECT query_id, 'lang', d.lang FROM merged m JOIN documents d ON d.doc_id = m.doc_id AND index_number = 0
  UNION ALL SELECT query_id, 'source', d.source FROM merged m JOIN documents d ON d.doc_id = m.doc_id AND index_number = 0
  UNION ALL SELECT query_id, 'role', t.role FROM merged m JOIN turns t ON t.doc_id = m.doc_id AND index_number = 1)
SELECT query_id, filter, value, count(*)::BIGINT AS n_filtered, count(*)::BIGINT AS n_total FROM valued GROUP BY ALL""")
def _(spark, sf):
    merged = _merged(spark, sf).withColumn("passes", F.lit(True))
    return A.merge_facets([A.facet_counts(merged.where(F.col("index_number") == i)) for i in (0, 1)])


@query("route_language", """WITH entries AS (SELECT lang, count(*) AS page_count FROM documents GROUP BY lang),
requests AS (SELECT DISTINCT lang || suffix AS requested FROM documents, (VALUES (''), ('-XX')) s(suffix)
  UNION ALL SELECT 'xx'),
largest AS (SELECT arg_max(lang, page_count) AS lang FROM entries)
SELECT requested, coalesce(
  (SELECT lang FROM entries e WHERE e.lang = requested), (SELECT lang FROM entries e WHERE e.lang = split_part(requested, '-', 1)),
  (SELECT lang FROM largest)) AS lang FROM requests""")
def _(spark, sf):
    docs = V.corpus(spark, sf)
    langs = docs.select("lang").distinct()
    requests = langs.select(F.explode(F.array("lang", F.concat("lang", F.lit("-XX")))).alias("requested"))
    requests = requests.unionByName(spark.range(1).select(F.lit("xx").alias("requested")))
    return S.route_language(requests, X.language_entries(docs)).select("requested", "lang")


@query("selected_only", f"""WITH {HITS}
SELECT query_id, doc_id FROM hits WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = hits.doc_id AND quality = 1)""")
def _(spark, sf):
    chosen = V.table(spark, sf, "labels").where("quality = 1")
    return S.selected_only(_hits(spark, sf)[1], chosen).select("query_id", "doc_id")


@query("result_summary", f"""WITH {HITS}, counted AS (
  SELECT q.query_id, q.term, count(h.doc_id) AS n FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY ALL)
SELECT query_id, n::BIGINT AS n, n || CASE WHEN n = 1 THEN ' result' ELSE ' results' END || ' for ' || term AS summary FROM counted""")
def _(spark, sf):
    counts = S.count_hits(_hits(spark, sf)[1], _queries(spark))
    return S.result_summary(counts).select("query_id", "n", "summary")


# ---- excerpts and sections ----------------------------------------------------------------

def _starts(spots: str, keys: str, length: int) -> str:
    """CTEs up to ``starts`` ({keys}, excerpt_start): the densest stretch of ``length`` words over {spots} ({keys}, loc)."""
    same = " AND ".join(f"x.{k} = {{0}}.{k}" for k in keys.split(", "))
    return f"""spans AS (
  SELECT {keys}, max(loc) + 1 AS w, count(*) FILTER (loc < {length}) AS s0 FROM {spots} GROUP BY {keys}),
grid AS (SELECT {keys}, w, s0, unnest(range(w)) AS i FROM spans),
slid AS (
  SELECT g.*, count(x.loc) OVER (PARTITION BY {", ".join("g." + k for k in keys.split(", "))} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {length} FOLLOWING) AS s
  FROM grid g LEFT JOIN {spots} x ON {same.format("g")} AND x.loc = g.i),
tops AS (SELECT {keys}, any_value(w) AS w, any_value(s0) AS s0, greatest(max(s), any_value(s0)) AS m FROM slid GROUP BY {keys}),
firsts AS (SELECT t.*, CASE WHEN s0 = m THEN 0 ELSE (SELECT min(i) FROM slid x WHERE {same.format("t")} AND x.s = t.m) END AS first FROM tops t),
stops AS (
  SELECT f.*, coalesce((SELECT min(i) FROM slid x WHERE {same.format("f")} AND x.i > f.first AND x.s <> f.m), w) AS stop FROM firsts f),
starts AS (
  SELECT {keys}, CASE WHEN w <= {length} THEN 0 ELSE first + (greatest(stop, first + 1) - first) // 2 END AS excerpt_start FROM stops)"""


SPOT_ROWS = f"""{INDEX}, spots AS (
  SELECT CASE term_exact WHEN 'the' THEN 1 ELSE 2 END AS query_id, doc_id, position AS loc FROM terms WHERE term_exact IN ('the', 'en'))"""
SPOTS = f"""{SPOT_ROWS},
{_starts("spots", "query_id, doc_id", 30)}"""


def _spots(spark, sf):
    index = _index(spark, sf)
    return index, S.search(index, S.queries_from(spark, ["the", "en"]), prefix=False, exact_diacritics=True)


@query("excerpt_start", f"WITH {SPOTS} SELECT query_id, doc_id, excerpt_start::INT AS excerpt_start FROM starts")
def _(spark, sf):
    index, hits = _spots(spark, sf)
    return P.hit_excerpts(hits, index.docs).select("query_id", "doc_id", "excerpt_start")


@query("excerpt_start_long", f"WITH {SPOTS} SELECT query_id, doc_id, excerpt_start::INT AS excerpt_start FROM starts")
def _(spark, sf):
    words = X.document_terms(V.corpus(spark, sf)).where(F.col("term_exact").isin("the", "en"))
    hits = words.select(
        F.when(F.col("term_exact") == "the", 1).otherwise(2).alias("query_id"), "doc_id", F.col("position").alias("location"),
        F.lit(1.0).alias("balanced_score"),
    )
    return P.excerpt_starts(hits, ["query_id", "doc_id"], 30)


@query("build_excerpt", f"""WITH {SPOTS}, placed AS (
  SELECT s.*, regexp_split_to_array(replace(replace(text, '<', '&lt;'), '>', '&gt;'), '{V.BLANK}+') AS w
  FROM starts s JOIN docs USING (doc_id)),
bounded AS (SELECT *, greatest(0, least(excerpt_start, len(w) - 30)) AS b FROM placed),
marked AS (
  SELECT query_id, doc_id, b, w, unnest(range(b, least(b + 30, len(w)))) AS k FROM bounded)
SELECT m.query_id, m.doc_id, trim(string_agg(CASE WHEN s.loc IS NULL THEN w[k + 1] ELSE '<mark>' || w[k + 1] || '</mark>' END, ' ' ORDER BY k)) AS excerpt,
  trim(string_agg(w[k + 1], ' ' ORDER BY k)) AS plain_excerpt
FROM marked m LEFT JOIN spots s ON s.query_id = m.query_id AND s.doc_id = m.doc_id AND s.loc = m.k GROUP BY m.query_id, m.doc_id""")
def _(spark, sf):
    index, hits = _spots(spark, sf)
    return P.hit_excerpts(hits, index.docs).select("query_id", "doc_id", "excerpt", "plain_excerpt")


@query("escape_markup", "SELECT page_id, md5(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def _(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(T.escape_markup(F.col("html"))).alias("escaped"))


@query("extract_anchors", """WITH heads AS (
  SELECT page_id, html, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS inner_html,
    split_part(html, '<h1', 1) AS before FROM pages WHERE contains(html, '<h1')),
texts AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(inner_html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text,
    trim(regexp_replace(regexp_replace(before,
      '(?s)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<title\\b[^>]*>.*?</title\\s*>|<!--.*?-->|<[^>]*>',
      ' ', 'g'), '\\s+', ' ', 'g')) AS lead FROM heads)
SELECT page_id, 'h1' AS element, CASE WHEN lead = '' THEN 0 ELSE len(string_split(lead, ' ')) END::INT AS location, text,
  trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS id FROM texts""")
def _(spark, sf):
    pages = P.extract_anchors(V.table(spark, sf, "pages"))
    return pages.select("page_id", F.explode("anchors").alias("a")).select(
        "page_id", "a.element", "a.location", "a.text", "a.id"
    )


SECTIONS = f"""{SPOTS}, held AS (
  SELECT query_id, doc_id, CASE WHEN loc < 20 THEN 0 ELSE (loc - 20) // 40 + 1 END AS section, loc FROM spots),
sections AS (
  SELECT query_id, doc_id, section::INT AS section, count(*)::BIGINT AS n_hits, string_agg(loc::VARCHAR, ',' ORDER BY loc) AS locations,
    '/docs/' || any_value(source) || '/' || doc_id || CASE WHEN section = 0 THEN '' ELSE '#s' || section END AS section_url,
    CASE WHEN section = 0 THEN 'doc_' || doc_id ELSE 'Part ' || section END AS title
  FROM held JOIN docs USING (doc_id) GROUP BY query_id, doc_id, section)"""


def _sections(spark, sf):
    """Documents with a heading at word 20 and every 40 words from there."""
    index, hits = _spots(spark, sf)
    n = F.size(T.split_words(F.col("content")))
    starts = F.when(n > 20, F.sequence(F.lit(20), n - 1, F.lit(40))).otherwise(F.array().cast("array<int>"))
    anchors = F.transform(
        starts,
        lambda at, i: F.struct(
            F.lit("h2").alias("element"), F.concat(F.lit("s"), i + 1).alias("id"), at.alias("location"),
            F.concat(F.lit("Part "), i + 1).alias("text"),
        ),
    )
    docs = index.docs.select("doc_id", "url", F.element_at("meta", "filename").alias("title"), "content")
    return P.sub_results(hits.join(docs, "doc_id").withColumn("anchors", anchors))


@query("sub_results", f"WITH {SECTIONS} SELECT query_id, doc_id, section, n_hits, locations, section_url, title FROM sections")
def _(spark, sf):
    return _sections(spark, sf).select(
        "query_id", "doc_id", "section", "n_hits",
        F.array_join(F.col("locations").cast("array<string>"), ",").alias("locations"), "section_url", "title",
    )


@query("sub_result_excerpts", f"""WITH {SPOT_ROWS}, held AS (
  SELECT query_id, doc_id, section, CASE WHEN section = 0 THEN 0 ELSE 40 * section - 20 END AS begin, loc - begin AS loc
  FROM (SELECT *, CASE WHEN loc < 20 THEN 0 ELSE (loc - 20) // 40 + 1 END AS section FROM spots) AS s),
{_starts("held", "query_id, doc_id, section", 12)},
cut AS (
  SELECT query_id, doc_id, section, excerpt_start, CASE WHEN section = 0 THEN 0 ELSE 40 * section - 20 END AS begin,
    regexp_split_to_array(replace(replace(text, '<', '&lt;'), '>', '&gt;'), '{V.BLANK}+') AS w,
    CASE WHEN 20 + 40 * section < len(w) THEN 20 + 40 * section END AS stop
  FROM starts JOIN docs USING (doc_id)),
sized AS (
  SELECT *, coalesce(stop, len(w)) - begin AS n, least(CASE WHEN stop IS NULL THEN 12 ELSE least(stop - begin - excerpt_start, 12) END, n) AS size,
    greatest(least(excerpt_start, n - size), 0) AS b FROM cut),
marked AS (SELECT query_id, doc_id, section, begin, w, unnest(range(b, b + size)) AS k FROM sized),
texts AS (
  SELECT m.query_id, m.doc_id, m.section, trim(string_agg(CASE WHEN h.loc IS NULL THEN w[begin + k + 1] ELSE '<mark>' || w[begin + k + 1] || '</mark>' END, ' ' ORDER BY k)) AS excerpt,
    trim(string_agg(w[begin + k + 1], ' ' ORDER BY k)) AS plain_excerpt
  FROM marked m LEFT JOIN (SELECT query_id, doc_id, section, loc FROM held) h ON h.query_id = m.query_id AND h.doc_id = m.doc_id AND h.section = m.section AND h.loc = m.k
  GROUP BY m.query_id, m.doc_id, m.section)
SELECT query_id, doc_id, section::INT AS section, (excerpt_start + begin)::INT AS excerpt_start, excerpt, plain_excerpt FROM sized JOIN texts USING (query_id, doc_id, section)""")
def _(spark, sf):
    return _sections(spark, sf).select("query_id", "doc_id", "section", "excerpt_start", "excerpt", "plain_excerpt")


@query("page_sub_results", f"""WITH {V.PAGE_TEXTS}, {V.terms_sql("page_texts")}, spots AS (
  SELECT CASE term_exact WHEN 'the' THEN 1 ELSE 2 END AS query_id, doc_id, position AS loc FROM terms WHERE term_exact IN ('the', 'de')),
placed AS (SELECT s.*, location, heading, url, location IS NOT NULL AND loc >= location AS below FROM spots s JOIN page_texts USING (doc_id) LEFT JOIN page_anchors USING (doc_id))
SELECT query_id, doc_id, below::INT AS section, count(*)::BIGINT AS n_hits, string_agg(loc::VARCHAR, ',' ORDER BY loc) AS locations,
  CASE WHEN below THEN any_value(heading) ELSE any_value(url) END AS title,
  CASE WHEN below THEN regexp_replace(any_value(url), '#.*$', '') || '#' || trim(regexp_replace(lower(any_value(heading)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') ELSE any_value(url) END AS section_url
FROM placed GROUP BY query_id, doc_id, below""")
def _(spark, sf):
    index = _index(spark, sf, V.page_texts)
    hits = S.search(index, S.queries_from(spark, ["the", "de"]), prefix=False, exact_diacritics=True)
    made = P.sub_results(hits.join(index.docs.select("doc_id", "url", "title", "content", "anchors"), "doc_id"))
    places = F.array_join(F.col("locations").cast("array<string>"), ",")
    return made.select("query_id", "doc_id", "section", "n_hits", places.alias("locations"), "title", "section_url")


@query("thin_sub_results", f"""WITH {SECTIONS}
SELECT query_id, doc_id, section, n_hits FROM sections WHERE section > 0
QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n_hits DESC, section) <= 3""")
def _(spark, sf):
    return P.thin_sub_results(_sections(spark, sf)).select("query_id", "doc_id", "section", "n_hits")


# ---- fuzzy and vector lookup --------------------------------------------------------------

FUZZY = [(1, "gizmi"), (2, "smal rng"), (3, "widgets"), (4, "x"), (5, "economi")]


@query("fuzzy_lookup", f"""WITH {V.CATALOG}, fields AS (
  SELECT id, 'url' AS field, path AS value FROM catalog UNION ALL
  SELECT id, 'content', array_to_string(list_concat(categories, tags), ', ') FROM catalog),
tokens AS (SELECT DISTINCT id, field, unnest(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+')) AS token FROM fields),
asked AS (SELECT query_id, unnest(string_split(term, ' ')) AS word, len(string_split(term, ' ')) AS n_words
  FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in FUZZY)}) q(query_id, term)),
close AS (
  SELECT token, word, levenshtein(token, word) AS distance FROM (SELECT DISTINCT token FROM tokens), (SELECT DISTINCT word FROM asked)
  WHERE levenshtein(token, word) <= greatest(1, length(word) // 4)),
best AS (SELECT query_id, n_words, id, word, min(distance) AS distance FROM tokens JOIN close USING (token) JOIN asked USING (word) GROUP BY ALL)
SELECT query_id, id, sum(distance)::BIGINT AS distance FROM best GROUP BY query_id, id, n_words HAVING count(*) = n_words""")
def _(spark, sf):
    queries = spark.createDataFrame(FUZZY, "query_id int, term string")
    return Z.fuzzy_lookup(X.field_index(V.catalog(spark, sf)), queries).select("query_id", "id", "distance")


MEANS = """means AS (
  SELECT label, i, avg(x::DOUBLE) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
centres AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM means GROUP BY label),
near AS (SELECT query_id, vec_id AS id, v, embedding::DOUBLE[] AS e FROM centres, embeddings)"""


def _vectors(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    return rows, W.mean_vectors(rows, "label")


@query("vector_topk", f"""WITH {MEANS}
SELECT query_id, id, round(list_distance(v, e), 4) AS distance FROM near
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, e), id) <= 10""")
def _(spark, sf):
    near = W.vector_topk(*_vectors(spark, sf), 10)
    return near.select("query_id", "id", F.round("distance", 4).alias("distance"))


@query("vector_topk_cosine", f"""WITH {MEANS}
SELECT query_id, id, round(1 - list_cosine_similarity(v, e), 4) AS distance FROM near
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(v, e), id) <= 10""")
def _(spark, sf):
    near = W.vector_topk(*_vectors(spark, sf), 10, metric="cosine")
    return near.select("query_id", "id", F.round("distance", 4).alias("distance"))


def _asked(rows):
    return rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def _vector_index(spark, sf, metric="l2"):
    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = scratch_path(spark, "vectors")
    W.write_vector_index(rows, path, metric)
    return rows, W.read_vector_index(spark, path, metric)


@query("vector_index_topk", """SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) <= 10""")
def _(spark, sf):
    rows, index = _vector_index(spark, sf)
    near = W.search_vectors(index, _asked(rows), 10, exact=True)
    return near.select("query_id", "id", F.round("distance", 4).alias("distance"))


@query("vector_index_recall", "SELECT 10 * count(*)::BIGINT AS n_exact, true AS reaches FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, sf):
    rows, index = _vector_index(spark, sf, "cosine")
    asked = _asked(rows)
    share = W.recall(W.search_vectors(index, asked, 10), W.vector_topk(rows, asked, 10, "cosine"))
    return share.select("n_exact", (F.col("recall") >= 0.9).alias("reaches"))
