"""Results that must not depend on sizes: of rule tables, batches, endings and numbers."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import labels, names
from shelfmark.operators import rules, skew, vectors


@pytest.mark.parametrize("inline", [0, 200])
def test_rules_answer_alike_at_any_number(spark, inline):
    table = spark.createDataFrame([(2, "", ["any"]), (1, "cat", ["cat"]), (1, "at", ["at"])], "priority int, needle string, tags array<string>")
    assets = spark.createDataFrame([("/x/zzz",), ("/cat",), ("",)], "path string")
    got = {r.path: r.related for r in rules.related_tags_from(assets, table, inline).collect()}
    assert got == {"/x/zzz": ["any"], "/cat": ["at"], "": ["any"]}


@pytest.mark.parametrize("limit", [3, 20])
def test_rows_without_a_cosine_are_left_out(spark, limit):
    rows = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(8)] + [(9, [1.0, 0.0])], "id bigint, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<double>")
    assert [r.id for r in vectors.vector_topk(rows, queries, limit, "cosine").collect()] == [9]


def test_long_endings_are_whole(column):
    assert column(["a." + "x" * 300], "string", names.mime_type) == ["image/" + "x" * 300]


def test_sizes_of_any_sign_and_length(spark):
    sizes = ["1234567890123456789", "-5", "+7", "12 KB", "99999999999999999999", "x", None]
    rows = spark.createDataFrame([(i, {"size": s}) for i, s in enumerate(sizes)], "i int, meta map<string,string>")
    record = labels.hit_record(F.lit("u"), F.lit("r"), F.lit("c"), F.col("meta"))
    assert [r["size"] for r in rows.select("i", *record).orderBy("i").collect()] == [1234567890123456789, -5, 7, 12, 0, 0, 0]


def test_any_number_of_lengths(spark):
    words = spark.range(1, 10_102).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("w"))
    lengths = skew.distinct_lengths(words, "w")
    assert lengths == list(range(1, 10_102))
    assert spark.range(1).select(F.size(skew.length_array(lengths)).alias("n")).first()["n"] == 10_101
