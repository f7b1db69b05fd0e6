"""Nearest vectors and vector copies against brute force, with hot cells, ties, repeated rows and invalid vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import collisions, knn

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, class string"
BAD = [None, [None, 1.0], [math.nan, 1.0], [math.inf, 0.0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("spread", [3, 0.05])
def test_nearest_are_those_of_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(0, spread, (400, 6)), 1)
    # A third of all rows share one vector.
    points[:130] = points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = knn.quantized(frame(spark, rows + [(1000 + i, v) for i, v in enumerate(BAD)] + [(None, [1.0] * 6), rows[3]]))
    got = sorted(tuple(r) for r in knn.search(vectors, F.col("vec_id") % 50 == 0, pivots=7, block=3, slice_rows=60).collect())
    whole = np.floor(256 * points.astype(np.float32).astype(float)).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(400) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_large_components_are_exact(spark):
    rows = [(0, [2_000_000.0, 1.0]), (1, [1_000_000.0, 2.0]), (2, [3_000_000.0, 0.0]), (50, [-1.0, 1_500_000.0]), (3, [2_000_000.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = sorted(tuple(r) for r in knn.search(knn.quantized(df), F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(want) and [r[2] for r in got[:4]][0] == 2
    with pytest.raises(Exception, match="64 bits"):
        knn.search(knn.quantized(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id bigint, embedding array<float>")), F.col("vec_id") % 50 == 0).collect()


def test_nearest_of_few_and_none(spark):
    few = knn.quantized(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 0.0]), (2, [1.0, 2.0, 3.0])]))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in knn.search(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert knn.search(knn.quantized(frame(spark, [])), F.col("vec_id") % 50 == 0).collect() == []


def brute(rows, threshold=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = {}
    for start in sorted(range(len(ids)), key=lambda k: ids[k]):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = ids[start]
                todo += list(np.flatnonzero(linked[k]))
    return {ids[k]: (int(linked[k].sum()), root[k]) for k in range(len(ids))}


def test_vector_copies_are_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for group in range(60):
        centre = rng.normal(size=32)
        for _ in range(6):
            # Cosines of about 0.95 to the centre's other copies, and some groups of equal vectors.
            noise = 0.0 if group < 10 else 0.22
            rows.append((len(rows), [float(x) for x in centre + noise * rng.normal(size=32)]))
    rows += [(1000 + i, rows[0][1]) for i in range(180)]
    bad = [(5000 + i, v) for i, v in enumerate([*BAD, [0.0] * 32, []])]
    got = {r.vec_id: r for r in collisions.near_duplicates(frame(spark, rows + bad)).collect()}
    want = brute(rows)
    assert set(got) == set(want) | {i for i, _ in bad}
    found, all_links = sum(got[i].n_links for i in want), sum(n for n, _ in want.values())
    assert 0.97 * all_links <= found <= all_links
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.98 * len(want)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    assert collisions.near_duplicates(frame(spark, [])).collect() == []


def test_large_cells_are_cut_without_loss(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.ones(8) + 0.02 * rng.normal(size=8)]) for i in range(120)]
    _, distinct = collisions.classes(frame(spark, rows))
    whole, cut = (
        {r["class"]: r.n for r in collisions.link_classes(distinct, block=b).groupBy("class").agg(F.sum("links").alias("n")).collect()} for b in (4096, 25)
    )
    assert whole == cut and set(whole.values()) == {119}


def test_vectors_visit_in_rounds_without_loss_and_are_not_shuffled_per_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) + (9 * (i % 4), 1, 0)]) for i in range(200)]
    rows += [(1000 + i, [1.0, float(i)]) for i in range(30)]
    _, distinct = collisions.classes(frame(spark, rows))
    moved, kind = [], type(distinct)
    shuffled = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *args: moved.append(self.count()) or shuffled(self, *args))
    monkeypatch.setattr(kind, "groupBy", lambda self, *keys, own=kind.groupBy: moved.append("vec" in map(str, keys)) or own(self, *keys))
    found = [collisions.link_classes(distinct, block=b, round_bytes=r) for b, r in ((4096, 1 << 25), (7, 500))]
    # Each vector moves once, however many blocks there are.
    assert moved == [False, 230, False, 230]
    monkeypatch.undo()
    totals = [{r["class"]: r.n for r in t.groupBy("class").agg(F.sum("links").alias("n")).where("n > 0").collect()} for t in found]
    assert totals[0] == totals[1] and len(totals[0]) > 150
    roots = [{(r.node, r.root) for r in collisions.components(t.where("class != root").selectExpr("class AS a", "root AS b")).collect()} for t in found]
    assert roots[0] == roots[1]
