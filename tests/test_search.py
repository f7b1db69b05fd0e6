import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfmark.operators import facets as A
from shelfmark.operators import fuzzy as Z
from shelfmark.operators import index as X
from shelfmark.operators import rules as U
from shelfmark.operators import search as S
from shelfmark.operators import vectors as W

TEXTS = {
    1: "The cat sat on the mat", 2: "A cathedral of cats", 3: "Élan vital, élan!", 4: "elan on the dog", 5: "of the, cat on of the mat", 6: "",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, "en", f"/d/{i}", t, {"kind": ["a", "b"] if i % 2 else ["b"]}, {"name": f"n{9 - i}"}, {"title": t[:3]}) for i, t in TEXTS.items()]
    schema = (
        "doc_id int, lang string, url string, content string, filters map<string,array<string>>, "
        "sort map<string,string>, meta map<string,string>"
    )
    return X.build_index(spark.createDataFrame(rows, schema))


def found(hits, query=1):
    return sorted(r["doc_id"] for r in hits.where(F.col("query_id") == query).collect())


def test_matching(spark, index):
    queries = S.queries_from(spark, ["cat", "cat the", "ELAN", "", None, "zebra"])
    hits = S.search(index, queries)
    assert [found(hits, q) for q in range(1, 7)] == [[1, 2, 5], [1, 5], [3, 4], [], [1, 2, 3, 4, 5, 6], []]
    # Quoted words follow each other and match whole: no beginning of "cathedral", and none of the other order.
    quoted = S.search(index, S.queries_from(spark, ['"of the"', '"the of"', '"the cat"', '"the mat"', None, "cat"]))
    assert [found(quoted, q) for q in range(1, 7)] == [[5], [], [1, 5], [1, 5], [1, 2, 3, 4, 5, 6], [1, 2, 5]]
    assert {r["score"] for r in quoted.where("query_id = 5").collect()} == {0.0}
    assert found(S.search(index, queries, prefix=False)) == [1, 5]
    assert found(S.search(index, queries, match_all=False), 2) == [1, 2, 4, 5]
    accents = S.queries_from(spark, ["élan"])
    assert found(S.search(index, accents, exact_diacritics=True)) == [3]
    scores = {r["doc_id"]: r["score"] for r in S.search(index, accents).collect()}
    assert scores[3] > scores[4]


def test_many_query_words_read_only_their_folders(spark, index):
    # 300 words that nothing begins with, beside two that are there: the folders read are still those of the two.
    few, many = ["cat", "elan"], ["cat", "elan", *(f"q{i}" for i in range(300))]
    got = [sorted((r["query_id"], r["doc_id"]) for r in S.search(index, S.queries_from(spark, terms)).collect()) for terms in (few, many)]
    assert got[0] == got[1]
    words = S.query_words(S.queries_from(spark, many))
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in (S.match_words(index, words), S.match_words(index, S.query_words(S.queries_from(spark, few))))]
    parts = [set(p.split("part#")[1].split("IN (", 1)[-1].split(")")[0].split(",")) if " IN (" in p else set() for p in plans]
    assert parts[0] == parts[1] and "PartitionFilters: [" in plans[0] and "Generate" not in plans[0]


def test_dictionary_numbers_follow_the_terms(index):
    rows = index.stored.terms.orderBy("lang", "term", "term_exact").collect()
    assert [r["term_id"] for r in rows] == sorted(r["term_id"] for r in rows)
    cat = [r for r in rows if r["term"] == "cat"]
    assert [(r["doc_frequency"], r["occurrences"]) for r in cat] == [(2, 2)]


def test_block_numbers(column):
    places = [1, 128, 129, 1024, 1025, 1152, 8320, 8321, 10**6]
    assert column(places, "bigint", X.block_number) == [0, 0, 1, 1, 2, 2, 3, 3, 5]


@pytest.fixture(scope="module")
def long_lists(spark):
    """Documents in which few stand out: lists of postings with several blocks, and many ties."""
    rng = random.Random(7)
    texts = {}
    for i in range(3000):
        words = ["common"] * rng.choice([1, 1, 1, 2]) + ["pad"] * rng.choice([5, 30, 60]) + ["other"] * (i % 3 == 0) + ["common"] * (30 if i % 500 == 1 else 0)
        texts[i] = " ".join(words + ["commoner"] * (i % 40 == 0))
    rows = [(i, "en", f"/d/{i}", t) for i, t in texts.items()]
    return X.build_index(spark.createDataFrame(rows, "doc_id int, lang string, url string, content string"))


def test_best_hits_skip_blocks_and_equal_full_scoring(spark, long_lists):
    queries = S.queries_from(spark, ["common", "common other", "commoner", '"pad other"', "zebra", "", "comm pad"])
    seen = []
    for limit, prefix in ((5, False), (20, True)):
        full = S.top_hits(S.search(long_lists, queries, prefix=prefix, locations=False), limit)
        want = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in full.collect())
        best = S.best_hits(long_lists, queries, limit, prefix=prefix, skipped=lambda b: seen.append(b.select("query_id", "block", "n", "read").collect()))
        assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in best.collect()) == want
    whole = [r for r in seen[0] if r["query_id"] == 1]
    # Five documents stand out for "common": only the first blocks of its list can hold better ones.
    assert sum(r["n"] for r in whole if not r["read"]) > 1500 and {r["block"] for r in whole if r["read"]} <= {0, 1}


def test_phrase(spark, index):
    hits = S.phrase_search(index, S.queries_from(spark, ['"of the"', "of the", '"the mat"', '"on of the mat"']))
    assert sorted(map(tuple, hits.collect())) == [(1, 5, 0), (1, 5, 4), (3, 1, 4), (3, 5, 5), (4, 5, 3)]


def test_filters_and_facets(spark, index):
    assert S.parse_filter_pills(["a:b:c", "a:d", "odd"]) == {"a": ["b:c", "d"]}
    docs = index.docs
    assert sorted(r["doc_id"] for r in S.filter_only_search(docs, {"kind": ["a", "b"]}).collect()) == [1, 3, 5]
    assert S.filter_only_search(docs, {"kind": ["a", "b"]}, mode="any").count() == 6
    assert S.filter_only_search(docs, {"absent": "x"}).count() == 0
    assert S.filter_only_search(docs, {}).count() == 6
    hits = S.search(index, S.queries_from(spark, ["cat"]))
    flagged = S.apply_filters(hits, docs, S.wanted_map({"kind": "a"}))
    facets = A.facet_counts(flagged)
    counts = {r["value"]: (r["n_filtered"], r["n_total"]) for r in facets.collect()}
    assert counts == {"a": (2, 2), "b": (2, 3)}
    assert all(filtered <= total for filtered, total in counts.values())
    view = A.facet_view(facets, A.unfiltered_counts(flagged), "count-desc", selected=["b"]).orderBy("position")
    assert [(r["value"], r["n"]) for r in view.collect()] == [("All", 3), ("b", 3), ("a", 2)]


def test_requests_filter_and_sort_each_its_own_way(spark, index):
    rows = [
        (1, "cat", None, None, None), (2, "cat", {"kind": ["a"]}, "name", False), (3, "cat", {"kind": ["b"]}, "name", True),
        (4, None, {"kind": ["a", "b"]}, "absent", True), (5, "cat", {"absent": ["x"]}, None, None),
    ]
    requests = spark.createDataFrame(rows, "query_id int, term string, filters map<string,array<string>>, sort string, descending boolean")
    got = {}
    for r in S.search_requests(index, requests).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    best = [r["doc_id"] for r in S.top_hits(S.search(index, S.queries_from(spark, ["cat"])), 9).orderBy("rank").collect()]
    assert got == {1: best, 2: [5, 1], 3: [1, 2, 5], 4: [1, 3, 5]}


def test_order_and_pages(spark, index):
    hits = S.search(index, S.queries_from(spark, ["cat"]))
    ranked = S.sort_hits(hits, index.docs, {"name": "asc"}).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked] == [5, 2, 1]
    ranked = S.sort_hits(hits, index.docs, {"name": "desc"}, hot_rows=1).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked] == [1, 2, 5]
    with pytest.raises(ValueError):
        S.sort_hits(hits, index.docs, {"name": "up"})
    assert S.page_hits(hits, page=1, page_size=2).count() == 2
    assert S.page_hits(hits, page=2, page_size=2, max_results=3).count() == 3


def test_application_search(spark):
    catalog = spark.createDataFrame(
        [("1", "/emojis/meow.png", ["cat"], ["funny"]), ("2", "/emojis/x.png", ["dog"], ["cute"])],
        "id string, path string, categories array<string>, tags array<string>",
    ).withColumn("filename", F.substring_index("path", "/", -1)).withColumn("size", F.lit(1)).withColumn("created", F.lit("2024-01-01").cast("timestamp"))
    index = X.build_index(X.index_documents(catalog))
    chosen = catalog.where("id = '2'").select("id")

    def ids(*args):
        return sorted(r["id"] for r in S.app_search(catalog, *args).collect())

    assert ids(index, "  ") == ["1", "2"]
    assert ids(index, "kitten") == ["1"]
    assert ids(index, "kitten", chosen) == []
    assert ids(index, "", chosen) == ["2"]
    assert ids(None, "dog") == ["1", "2"]


def test_languages(spark):
    entries = spark.createDataFrame([("en", 5), ("de", 9)], "lang string, page_count bigint")
    asked = spark.createDataFrame([("en",), ("en-GB",), ("fr",)], "requested string")
    got = {r["requested"]: r["lang"] for r in S.route_language(asked, entries).collect()}
    assert got == {"en": "en", "en-GB": "en", "fr": "de"}
    with pytest.raises(Exception, match="no language"):
        S.route_language(asked, entries.where("false")).collect()


def test_summary(spark):
    rows = [(1, "x", 0), (2, "x", 1), (3, None, 2)]
    got = S.result_summary(spark.createDataFrame(rows, "query_id int, term string, n bigint")).orderBy("query_id")
    assert [r["summary"] for r in got.collect()] == ["0 results for x", "1 result for x", "2 results"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_words_finds_every_pair(spark):
    rng = random.Random(9)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 13))) for _ in range(250)})
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 13))) for _ in range(40)})
    pairs = Z.similar_words(spark.createDataFrame([(v,) for v in vocabulary], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(r["token"], r["word"]): r["distance"] for r in pairs.collect()}
    expected = {(v, w): levenshtein(v, w) for v in vocabulary for w in words if levenshtein(v, w) <= max(1, len(w) // 4)}
    assert got == expected


def test_similar_words_of_any_length_have_one_plan(spark):
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(400))
    changed = long[:50] + "xyz" + long[53:200] + long[205:] + "tail"
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    pairs = Z.similar_words(frame("token", [changed, long[:250], "short"]), frame("word", [long, "shirt", "x"]))
    assert {(r["token"], r["word"]): r["distance"] for r in pairs.collect()} == {(changed, long): levenshtein(changed, long), ("short", "shirt"): 1}
    size = lambda words: len(Z.similar_words(frame("token", ["a"]), frame("word", words))._jdf.queryExecution().optimizedPlan().toString())
    # Expression numbers in the text may grow by a digit.
    assert abs(size(["ab"]) - size(["a" * n for n in range(1, 60)])) < 100


def test_vectors_are_exact_however_queries_are_split(spark):
    rng = np.random.default_rng(10)
    rows = rng.normal(size=(300, 8)).round(1)
    rows[50] = rows[7]
    asked = rng.normal(size=(9, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id int, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, vector array<double>")
    expected = set()
    for q, v in enumerate(asked):
        far = np.sqrt(((rows - v) ** 2).sum(axis=1))
        expected |= {(q, int(i)) for i in np.lexsort((np.arange(300), far.round(9)))[:5]}
    for most in (1 << 20, 150):
        near = W.vector_topk(df, queries, 5, pass_bytes=most)
        assert {(r["query_id"], r["id"]) for r in near.collect()} == expected
    # One query of many vectors: each row counts with the nearest of them, in however many scans they go.
    same = queries.withColumn("query_id", F.lit(1))
    least = np.sqrt(((rows[:, None] - asked[None]) ** 2).sum(axis=2)).min(axis=1).round(9)
    near = W.vector_topk(df, same, 5, pass_bytes=150)
    assert [r["id"] for r in near.orderBy("rank").collect()] == np.lexsort((np.arange(300), least))[:5].tolist()
    assert W.vector_topk(df, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index(spark, tmp_path, metric):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 8))
    # A third of the rows are one vector, in one cell that is dealt out.
    points[:300] = points[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(9999, None)], "id int, vector array<double>")
    queries = spark.createDataFrame([(i, points[i * 17].tolist()) for i in range(40)], "query_id int, vector array<double>")
    W.write_vector_index(df, str(tmp_path), metric, cells=20, cell_rows=100)
    index = W.read_vector_index(spark, str(tmp_path), metric)
    assert index.rows.count() == 900 and index.cells.agg(F.max("parts")).first()[0] >= 3
    exact = W.vector_topk(df, queries, 5, metric)
    rounded = lambda df: sorted((r["query_id"], r["rank"], round(r["distance"], 7)) for r in df.collect())
    assert rounded(W.search_vectors(index, queries, 5, exact=True)) == rounded(exact)
    assert W.recall(W.search_vectors(index, queries, 5), exact).first()["recall"] >= 0.9


def test_rule_tables(spark):
    rules = spark.createDataFrame([(2, "cat", ["c"]), (1, "meow", ["m"]), (3, "a", ["x"])], "priority int, needle string, tags array<string>")
    assets = spark.createDataFrame([("/cat-meow",), ("/cat",), ("/bat",), ("/o",)], "path string")
    for most in (0, 100):
        got = {r["path"]: r["related"] for r in U.related_tags_from(assets, rules, most).collect()}
        assert got == {"/cat-meow": ["m"], "/cat": ["c"], "/bat": ["x"], "/o": []}
