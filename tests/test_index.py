"""Building and storing a text index: no shuffle per word, rows that share an id, frequent terms."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import index as X
from shelfmark.operators import search as S

SCHEMA = "doc_id int, lang string, content string"
TEXTS = ["été ÉTÉ a", "a​b  c ​ ​x", "한글 ẛ̣ İstanbul", "don't dont ́ ... _ a_b", "", None, "the cat, the cat", "क़ the﻿end"]


def reference(docs):
    """Postings from the words one by one."""
    words = X.document_terms(docs).groupBy("lang", "term", "term_exact", "doc_id")
    return words.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"), F.lit(1.0).alias("weight"))


@pytest.mark.parametrize("ids", [list(range(8)), [1, 1, 2, 2, 3, None, None, 7]])
def test_postings_are_those_of_the_words(spark, ids):
    docs = spark.createDataFrame(list(zip(ids, ["en"] * 8, TEXTS)), SCHEMA)
    got = [sorted(str(r) for r in rows.collect()) for rows in (X.build_postings(docs), reference(docs))]
    assert got[0] == got[1] and got[0]


def test_words_are_not_shuffled_one_by_one(spark):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEXTS)], SCHEMA)
    plan = X.build_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("hot_rows", [2_000_000, 30])
def test_stored_postings_and_dictionary(spark, tmp_path, hot_rows):
    texts = [f"the {'cat ' * (i % 3)}w{i}" for i in range(300)] + ["the dog"] * 2
    ids = [*range(300), None, 5]
    docs = spark.createDataFrame(list(zip(ids, ["en"] * 302, texts)), SCHEMA).repartition(3)
    X.write_index(X.build_index(docs), str(tmp_path), hot_rows=hot_rows)
    index = X.read_index(spark, str(tmp_path))
    terms = {r["term"]: r for r in index.terms.collect()}
    # Rows of one id are one document, and the one without an id counts as well.
    assert (terms["the"]["doc_frequency"], terms["the"]["occurrences"]) == (301, 302)
    assert (terms["cat"]["doc_frequency"], terms["cat"]["occurrences"]) == (200, 300)
    rows = index.postings.join(index.terms.select("term", "term_id", F.col("part").alias("own")), "term_id")
    assert rows.where("part != own").isEmpty()
    the = rows.where("term = 'the'").collect()
    # The document with two lengths stands there with both.
    assert sorted(r["doc_id"] for r in the) == sorted([*range(300), 5])
    assert {r["block"]: 0 for r in the}.keys() == {0, 1} and sum(r["block"] == 0 for r in the) == 128
    the = [r for r in the if r["doc_id"] != 5]
    best = max(r["n_terms"] for r in the if r["block"] == 0)
    assert best <= min(r["n_terms"] for r in the if r["block"] == 1)
    bounds = {r["block"]: r for r in index.blocks.where(F.col("term_id") == terms["the"]["term_id"]).collect()}
    assert [bounds[b]["n"] for b in (0, 1)] == [128, 173]
    found = S.search(index, S.queries_from(spark, ["cat"]), locations=False).count()
    assert found == 200


def test_lists_of_postings_hold_the_postings_of_the_rows(spark):
    texts = [*TEXTS, "the cat", "the the Cat", None, ""] * 40
    rows = [(i if i % 11 else None, [None, "en", "fr"][i % 3], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    bounds = X.term_bounds(docs, 1, 8)
    assert len(bounds) > 3 and bounds == sorted(set(bounds))
    lists = X.postings_by_range(docs, bounds).cache()
    columns = ["lang", "term", "term_exact", "doc_id", "n_terms", "tf", "positions"]
    row = lambda r: tuple(tuple(v) if isinstance(v, list) else v for v in r)
    got = sorted(row(r) for r in lists.select("lang", "term", "term_exact", F.inline("postings")).select(*columns).collect())
    wanted = X.postings_by_row(docs).where("lang IS NOT NULL AND doc_id IS NOT NULL").select(*columns)
    assert got == sorted(row(r) for r in wanted.collect())
    # A frequent term is shuffled as one row per task, language and spelling, and parts are in the order of terms.
    the = lists.where("term = 'the' AND lang = 'en'").collect()
    assert len(the) <= 2 * len({r["term_exact"] for r in the}) and sum(len(r["postings"]) for r in the) > 30
    ranges = sorted((r["part"], *(r[c].encode() for c in columns[:3])) for r in lists.collect())
    assert [r[1:] for r in ranges] == sorted(r[1:] for r in ranges) and ranges[-1][0] > 3


@pytest.mark.parametrize("hot_rows", [2_000_000, 30])
def test_an_index_from_lists_is_the_one_from_postings(spark, tmp_path, hot_rows):
    texts = [f"the {'cat ' * (i % 5)}w{i % 90} {'café' if i % 7 else 'cafe'}" for i in range(400)]
    rows = [(i, [None, "en", "fr"][min(i % 13, 2)], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "en", "the one without a name")], SCHEMA).repartition(3)
    built = X.build_index(docs)
    assert built.source is not None
    found = []
    for name, index in (("lists", built), ("rows", replace(built, source=None))):
        X.write_index(index, str(tmp_path / name), parts=8, hot_rows=hot_rows)
        stored = X.read_index(spark, str(tmp_path / name))
        terms = stored.terms.select("lang", "term", "term_exact", "term_id", "part", "doc_frequency", "occurrences")
        of = terms.select("term_id", "term", "term_exact")
        tables = [
            terms.drop("term_id", "part"), stored.blocks.join(of, "term_id").drop("term_id", "part"),
            stored.postings.join(of, "term_id").drop("term_id", "part").withColumn("positions", F.col("positions").cast("string")),
        ]
        found.append([sorted(tuple(r.asDict()[c] for c in sorted(t.columns)) for r in t.collect()) for t in tables])
        # Numbers follow the order of terms, but for those behind the ranges.
        cold = sorted((r["term_id"], r["lang"].encode(), r["term"].encode(), r["term_exact"].encode()) for r in terms.where("part < 8").collect())
        assert [r[1:] for r in cold] == sorted(r[1:] for r in cold)
    assert found[0] == found[1]


def test_writing_an_index_sorts_no_postings_to_count_blocks(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"the cat w{i}") for i in range(50)], SCHEMA)
    kind, seen = type(docs), []
    grouped = kind.groupBy

    def noted(self, *columns):
        seen.append(columns)
        return grouped(self, *columns)

    monkeypatch.setattr(kind, "groupBy", noted)
    X.write_index(X.build_index(docs), str(tmp_path))
    # With the strings as keys, all that is kept per block has a fixed width: it is counted by hashing.
    blocks = [columns for columns in seen if "block" in columns]
    assert blocks and all({"term", "term_exact"} <= set(columns) for columns in blocks)


def test_a_range_is_numbered_and_placed_without_windows_over_rows(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"the cat w{i}") for i in range(200)], SCHEMA)
    monkeypatch.setattr(X, "Window", None)
    X.write_index(X.build_index(docs), str(tmp_path))
    rows = {r["term"]: r for r in X.read_index(spark, str(tmp_path)).terms.collect()}
    assert (rows["the"]["doc_frequency"], rows["w7"]["occurrences"], len(rows)) == (200, 1, 202)


SETTLED = [
    " a  lead", "\ta\x0bb\x0cc\r\nd ", "L'Été, l’été «ÉTÉ» — ¡Ñandú! §3 ¶", "don't -- ... a_b a·b", "Straße ẞ ǅ ŉ", "Жук й И\u0486и \u0486 ё", "漢字、仮名ガ が 한글",
    "ΑΒΓ ώ", "x\xadz \xad", "", " ", "!", "Ǆ ½ x² ‰ ′a″",
]
UNSETTLED = ["ΟΔΟΣ ΟΔΟΣ. Σ", "İstanbul I", "a\xa0b\u2003c", "a\u0301 e\u0301\u0301 \u0301", "\U0001f600x \U0001f600 𝐀", "a\u200bb c\u200b", "\ufeffa\x85b\x1cc", "⸺a ፧ ﬁ №"]


@pytest.mark.parametrize("kept", [None, ["-", "'", "·", "’"]])
def test_words_taken_from_the_text_are_those_of_the_expressions(spark, kept):
    texts = [*SETTLED, *UNSETTLED]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    split = {r["doc_id"]: r["text"] is not None for r in X._split(docs, kept).collect()}
    assert [split[i] for i in range(len(texts))] == [True] * len(SETTLED) + [False] * len(UNSETTLED)
    columns = ["lang", "term", "term_exact", "doc_id", "tf", "positions"]
    words = X.document_terms(docs, kept).groupBy("lang", "term", "term_exact", "doc_id")
    wanted = words.agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    rows = X.postings_by_row(docs, kept).cache()
    assert sorted(map(str, rows.select(*columns).collect())) == sorted(map(str, wanted.select(*columns).collect()))
    lengths = {r["doc_id"]: r["n_terms"] for r in X.document_lengths(docs).collect()}
    assert {(r["doc_id"], r["n_terms"]) for r in rows.collect()} == {(r["doc_id"], lengths[r["doc_id"]]) for r in rows.collect()}
    # In slices of a few words, the same.
    sliced = X._split(docs, kept).mapInArrow(lambda batches: (part for b in batches for part in X.grouped_words(b, T.Spellings(kept), 8)), rows.schema)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, rows.collect()))


def test_rows_are_put_in_order_by_keys_of_any_width():
    rng = np.random.default_rng(5)
    for most in (3, 1 << 20, 1 << 45):
        keys = [rng.integers(0, most, 2_000) for _ in range(3)]
        keys[0] %= 5
        assert X._in_order(*keys).tolist() == np.lexsort(keys[::-1]).tolist()
    assert X._in_order(np.empty(0, np.int64)).tolist() == []
