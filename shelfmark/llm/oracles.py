"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"

NEAREST = f"""
WITH v AS (SELECT vec_id, {_WHOLE} AS vec FROM embeddings WHERE {_FINITE}),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

VECTOR_COPIES = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.vec, b.vec) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN degree ON a = vec_id
"""

CONTAMINATION = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
sized AS (SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0),
placed AS (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
strings AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS string FROM placed),
runs AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM strings) AS s WHERE len(w) >= size),
hits AS (SELECT r, i, runs.size, item FROM runs JOIN strings ON strings.size = runs.size AND string = array_to_string(w[i:i + runs.size - 1], ' ')),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits) AS once) AS each GROUP BY r),
hit_items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) AS once GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit_words.n, 0)::BIGINT AS n_hit, coalesce(hit_items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, hit_words.n IS NOT NULL AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

# crc32 byte by byte, over the eight steps of each byte; near words by what is left of both without one letter.
SPELLING = f"""
WITH runs AS (
  SELECT doc, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents) AS each
  GROUP BY doc, run
),
steps AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) AS bytes(i)
),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM runs, steps
),
spoiled AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) AS each),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, words.word, words.n FROM less JOIN words ON rest = words.word
  UNION SELECT words.word, less.word, less.n FROM less JOIN words ON rest = words.word
),
best AS (SELECT word, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN best.n >= 5 * words.n THEN other END AS form, CASE WHEN best.n >= 5 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND k = 1
),
roots AS (
  SELECT word AS start, word AS here, form FROM formed
  UNION ALL
  SELECT roots.start, formed.word, formed.form FROM roots JOIN formed ON formed.word = roots.form
)
SELECT word, n, n_near, formed.form, form_n, here AS root FROM formed JOIN roots ON start = word AND roots.form IS NULL
""".replace("WITH runs", "WITH RECURSIVE runs")

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS vec
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
inside AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS n
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM inside WHERE n <= 5
"""

ORACLES: dict[str, str] = {
    "op1_nearest_vectors": NEAREST,
    "op6_vector_copies": VECTOR_COPIES,
    "op11_contamination": CONTAMINATION,
    "op12_spelling_variants": SPELLING,
    "op13_hard_negatives": HARD_NEGATIVES,
}
