"""Every registered query at the smallest scale, and the shape of the plans that matter."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from shelfmark.operators import index as X
from shelfmark.operators import search as S
from shelfmark.plans import ORACLES, QUERIES
from shelfmark.plans import views as V

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def text(value):
    if value is None or value != value:
        return "null"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert "CartesianProduct" not in physical(df) and "BroadcastNestedLoopJoin" not in physical(df)
    columns = sorted(df.columns)
    got = sorted(tuple(text(v) for v in row) for row in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(text(row[i]) for i in places) for row in relation.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_stored_index_is_pruned(spark, tmp_path):
    X.write_index(X.build_index(V.corpus(spark, SF)), str(tmp_path))
    index = X.read_index(spark, str(tmp_path)).in_language("en")
    queries = S.queries_from(spark, ["the"])
    plan = physical(S.match_words(index, S.query_words(queries), prefix=True))
    # The dictionary names the folders of the postings; no word and no posting is taken apart on the way.
    scan = next(line for line in plan.splitlines() if "positions" in line and "FileScan" in line)
    assert "PartitionFilters: [isnotnull(lang" in scan and "part#" in scan.split("PartitionFilters")[1] and "Generate" not in plan
    held = index.terms.where("startswith(term, 'the')").select("part").distinct().count()
    assert held < index.terms.select("part").distinct().count()


def test_scans_read_only_their_columns(spark):
    plan = physical(X.language_entries(V.corpus(spark, SF)))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan or "ReadSchema: struct<lang:string>" in plan


def test_top_hits_limit_before_the_shuffle(spark):
    hits = spark.range(1000).selectExpr("id % 3 AS query_id", "id AS doc_id", "rand(1) AS score")
    assert "WindowGroupLimit" in physical(S.top_hits(hits, 5))


def test_duplicates_combine_before_the_shuffle(spark):
    from shelfmark.operators import imports as I

    files = V.blobs(spark, SF).selectExpr("filename", "doc_id", "sha2(content, 256) AS hash")
    plan = physical(I.dedupe_exact(files, ["filename", "doc_id"]))
    assert "partial_min_by" in plan and "Window" not in plan
