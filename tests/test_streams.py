from shelfmark.operators import index as X
from shelfmark.operators import search as S
from shelfmark.operators import segments as M
from shelfmark.streaming import ingest as G
from shelfmark.streaming import terms as D


def test_ingest_takes_every_file_once(spark, tmp_path):
    drop, table, check = tmp_path / "drop", str(tmp_path / "table"), str(tmp_path / "check")
    drop.mkdir()
    (drop / "01_Cat.png").write_bytes(b"cat")
    (drop / "cat.PNG").write_bytes(b"other")
    (drop / "copy.png").write_bytes(b"cat")
    (drop / "notes.txt").write_bytes(b"no")
    labels = spark.createDataFrame([(0, "cat.gif", ["animal"], ["cat"])], "pos int, filename string, categories array<string>, tags array<string>")

    def run():
        G.ingest_stream(spark, str(drop), table, check, labels=labels).awaitTermination()
        return sorted((r["source"], r["filename"], tuple(r["categories"])) for r in G.read_records(spark, table).collect())

    first = [("01_Cat.png", "cat.png", ("animal",)), ("cat.PNG", "cat-1.png", ())]
    assert run() == first
    assert run() == first
    (drop / "again.png").write_bytes(b"cat")
    (drop / "Cat.png").write_bytes(b"third")
    assert run() == sorted(first + [("Cat.png", "cat-2.png", ())])
    index = G.read_ingested(spark, table)
    assert {r["term"] for r in index.terms.collect()} >= {"animal", "cat"} and index.docs.count() == 3
    found = S.search(index, S.queries_from(spark, ["animal"]))
    # The path of each says that it is one.
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["id"] for r in G.read_records(spark, table).collect())


def test_settled_terms_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t + dt.timedelta(milliseconds=ms), i, term) for i, (ms, term) in enumerate([(0, "c"), (100, "ca"), (200, "cat"), (900, "dog"), (60_000, "end")])]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp, seq bigint, term string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id bigint, ts timestamp, seq bigint, term string").parquet(str(tmp_path / "in"))
    D.write_settled(D.settled_terms(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["cat", "dog"]
    # The burst at the end stays in the state until it is asked for.
    assert sorted(r["term"] for r in D.read_settled(spark, str(tmp_path / "out"), str(tmp_path / "check")).collect()) == ["cat", "dog", "end"]


def test_segments_equal_a_one_shot_index(spark, tmp_path):
    root = str(tmp_path / "index")
    texts = {i: f"common word{i % 4} " + "pad " * (i % 5) for i in range(40)}
    docs = lambda rows: spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id int, lang string, content string")
    queries = S.queries_from(spark, ["common", "word1", "word2 pad", '"common word3"', "new", "gone"])

    def found(index):
        hits = S.search(index, queries, prefix=False)
        best = S.best_hits(index, queries, 3, prefix=False)
        assert sorted(map(tuple, best.select("query_id", "doc_id", "score", "rank").collect())) == sorted(
            map(tuple, S.top_hits(hits, 3).select("query_id", "doc_id", "score", "rank").collect())
        )
        return sorted((r["query_id"], r["doc_id"], r["score"], str(r["weighted_locations"])) for r in hits.collect())

    batches = [[(i, texts[i]) for i in range(0, 15)], [(i, texts[i]) for i in range(15, 30)], [(i, texts[i]) for i in range(30, 40)] + [(3, "new common")]]
    assert [M.add_segment(spark, root, f"b{n}", docs(batch)) for n, batch in enumerate(batches)] == [True] * 3
    # A repeated batch changes nothing, and one that was written but not published is not seen.
    assert not M.add_segment(spark, root, "b1", docs([(100, "gone")]))
    X.write_index(X.build_index(docs([(101, "gone")])), f"{root}/segments/b9")
    M.remove_documents(spark, root, docs([(7, "")]))
    live = {**texts, 3: "new common"}
    del live[7]
    want = found(X.build_index(docs(live.items())))
    assert found(M.open_index(spark, root)) == want
    assert M.compact(spark, root) == "merged-5" and found(M.open_index(spark, root)) == want
    assert M.open_index(spark, root).terms.groupBy("term", "term_exact").count().where("count > 1").count() == 0
    # After it, the index goes on growing.
    M.add_segment(spark, root, "b4", docs([(7, "common gone")]))
    assert (6, 7) in {r[:2] for r in found(M.open_index(spark, root))}
