"""Nearest rows to query vectors: by exact distance in one scan, or through a stored index of cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

# Bytes of query vectors that one pass over the table takes along, hence shipped to every task.
PASS_BYTES = 64 << 20
# Query vectors compared at once, and candidates held before they are cut to the best.
QUERIES_AT_ONCE, MOST_HELD = 256, 1 << 20

# Cells of an index: as many as the root of the rows within these bounds. Their centres are fitted on so many rows per
# cell at most, in so many rounds; every row is then placed.
LEAST_CELLS, MOST_CELLS, SAMPLE_PER_CELL, ROUNDS = 4, 4_096, 32, 8
# Cells read per query where an approximate result is enough: as many as held this share of the CALIBRATED nearest rows
# of so many rows, measured when the index is written.
RECALL, CALIBRATED_ROWS, CALIBRATED = 0.95, 256, 10
# Rows of a cell that one task compares: larger cells are dealt out.
CELL_ROWS = 200_000


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    products = queries @ rows.T
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - products / norms
    squares = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * products, 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The ``limit`` nearest ids per query number, ties to smaller ids."""

    def __init__(self, n: int, limit: int):
        self.limit, self.bar = limit, np.full(n, np.inf)
        self.query, self.ids, self.distance, self.fresh = np.empty(0, np.int64), None, np.empty(0), 0

    def offer(self, first: int, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, metric: str) -> None:
        """Compare ``queries``, numbered from ``first``, with rows."""
        found = _distances(queries, rows, metric)
        found[np.isnan(found)] = np.inf
        bar = self.bar[first : first + len(queries)]
        if found.shape[1] > self.limit:
            # Everything up to the limit-th distance, ties included.
            bar = np.minimum(bar, np.partition(found, self.limit - 1, axis=1)[:, self.limit - 1])
        i, j = np.nonzero((found <= bar[:, None]) & np.isfinite(found))
        self.query = np.concatenate([self.query, i + first])
        self.ids = ids[j] if self.ids is None else np.concatenate([self.ids, ids[j]])
        self.distance = np.concatenate([self.distance, found[i, j]])
        self.fresh += len(i)
        if self.fresh > MOST_HELD:
            self.cut()

    def cut(self) -> None:
        if self.ids is None:
            return
        order = np.lexsort((self.ids, self.distance, self.query))
        query = self.query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.limit]
        self.query, self.ids, self.distance, self.fresh = self.query[order], self.ids[order], self.distance[order], 0
        last = np.flatnonzero(place[place < self.limit] == self.limit - 1)
        self.bar[self.query[last]] = self.distance[last]


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist()) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _ranked(near: DataFrame, limit: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def vector_topk(rows: DataFrame, queries: DataFrame, limit: int, metric: str = "l2", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, id, distance, rank) of the ``limit`` nearest rows per query.

    ``rows`` has id and vector, ``queries`` has query_id and vector. Every task reduces its rows to its own best per
    query, so only limit x queries x tasks rows are shuffled. All queries go along in one scan as long as they take
    ``pass_bytes``; more are dealt to as many scans as their bytes need. Rows and queries without a vector, and rows without a distance (a zero vector has no
    cosine) are left out. Several vectors of one query_id stand for one query: a row counts with the nearest of them.
    """
    numbered = stored(queries.where("vector IS NOT NULL").select("query_id", "vector", F.monotonically_increasing_id().alias("__row")), "queries")
    size = numbered.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    types = dict(rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    near = None
    for number in range(passes):
        mine = numbered.where(F.pmod(F.xxhash64("__row"), F.lit(passes)) == number) if passes > 1 else numbered
        table = mine.select("query_id", "vector").toArrow()
        shipped = rows.sparkSession.sparkContext.broadcast((table.column("query_id").combine_chunks(), _matrix(table.column("vector"))))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            query_ids, asked = shipped.value
            best = Best(len(asked), limit)
            for batch in batches:
                if batch.num_rows and len(asked):
                    ids, own = _ids(batch.column("id")), _matrix(batch.column("vector"))
                    for first in range(0, len(asked), QUERIES_AT_ONCE):
                        best.offer(first, asked[first : first + QUERIES_AT_ONCE], ids, own, metric)
            best.cut()
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(best.query)), pa.array(best.ids), pa.array(best.distance)], names=["query_id", "id", "distance"])

        part = rows.where("vector IS NOT NULL").select("id", "vector").mapInArrow(run, f"query_id {types[1]}, id {types[0]}, distance double")
        near = part if near is None else near.unionByName(part)
    return _ranked(near.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), limit)


# ---- stored index -------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (cell, part, id, vector), a folder per cell, ``cells`` (cell, centre, n, parts, radius), and how many cells
    hold the share RECALL of a query's nearest rows."""

    rows: DataFrame
    cells: DataFrame
    probes: int
    metric: str = "l2"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _fitted(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds, from its first different rows."""
    centre = np.unique(sample, axis=0)
    centre = centre[np.random.default_rng(0).permutation(len(centre))[:cells]].copy()
    for _ in range(rounds):
        nearest = _distances(sample, centre, "l2").argmin(1)
        n = np.bincount(nearest, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, sample)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def write_vector_index(rows: DataFrame, path: str, metric: str = "l2", cells: int | None = None, cell_rows: int = CELL_ROWS) -> None:
    """Store ``rows`` (id, vector) by cells of near vectors. For the cosine, cells hold vectors of a similar direction.

    The centres come from at most SAMPLE_PER_CELL rows per cell, chosen by a hash of the id. Every row is placed; rows
    without a vector are left out.
    """
    spark = rows.sparkSession
    rows = rows.where("vector IS NOT NULL")
    total = rows.count()
    cells = cells or int(min(MOST_CELLS, max(LEAST_CELLS, total**0.5)))
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE_PER_CELL).select("vector").toArrow().column("vector"))
    centre = _fitted(_unit(sample) if metric == "cosine" else sample, cells, ROUNDS) if len(sample) else sample
    shipped = spark.sparkContext.broadcast(centre)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column("vector"))
                away = _distances(_unit(own) if metric == "cosine" else own, shipped.value, "l2")
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=["id", "vector", "cell", "away"])

    kinds = dict(rows.dtypes)
    placed = stored(rows.select("id", "vector").mapInArrow(place, f"id {kinds['id']}, vector {kinds['vector']}, cell int, away double"), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int"))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centre)], "cell int, centre array<double>")
    centres.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")
    parts = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = placed.join(spark.read.parquet(f"{path}/cells").select("cell", "parts"), "cell").select("cell", parts.alias("part"), "id", "vector")
    dealt.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATED_ROWS).select(F.col("id").alias("query_id"), "vector")
    asked = stored(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    exact = vector_topk(rows, asked, CALIBRATED, metric).select("query_id", "id").join(placed.select("id", "cell"), "id")
    places = _near_cells(VectorIndex(rows, spark.read.parquet(f"{path}/cells"), 0, metric), asked).select("query_id", "cell", "place")
    needed = exact.join(places, ["query_id", "cell"]).agg(F.ceil(F.percentile("place", F.lit(RECALL)) + 1).cast("int").alias("probes"))
    needed.write.mode("overwrite").parquet(f"{path}/probes")


def read_vector_index(spark: SparkSession, path: str, metric: str = "l2") -> VectorIndex:
    probes = spark.read.parquet(f"{path}/probes").first()[0] or 1
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), probes, metric)


def _near_cells(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, vector, cell, parts, away, radius) for every query and cell; cells are few, by their bound."""
    table = index.cells.select("cell", "parts", "radius", "centre").toArrow()
    names, parts, radius = (table.column(c).to_numpy() for c in ("cell", "parts", "radius"))
    metric = index.metric
    shipped = queries.sparkSession.sparkContext.broadcast((names, parts, radius, _matrix(table.column("centre"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, radius, centre = shipped.value
        for whole in batches:
            for first in range(0, whole.num_rows, QUERIES_AT_ONCE):
                batch = whole.slice(first, QUERIES_AT_ONCE)
                asked = _matrix(batch.column("vector"))
                away = _distances(_unit(asked) if metric == "cosine" else asked, centre, "l2")
                order = np.argsort(away, axis=1, kind="stable")
                at = pa.array(np.repeat(np.arange(len(asked)), len(names)))
                flat = order.ravel()
                columns = [batch.column("query_id").take(at), batch.column("row").take(at), pa.array(names[flat]), pa.array(parts[flat]), pa.array(np.take_along_axis(away, order, 1).ravel()), pa.array(radius[flat]), pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(asked)))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "row", "cell", "parts", "away", "radius", "place"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.mapInArrow(run, f"query_id {kind}, row bigint, cell int, parts int, away double, radius double, place int")


def _searched(index: VectorIndex, queries: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` nearest rows of the ``chosen`` cells (row, cell, parts) for each query; other folders are not read."""
    cells = [row["cell"] for row in chosen.select("cell").distinct().collect()]
    rows = index.rows.where(F.col("cell").isin(cells))
    asked = chosen.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).join(queries, "row")
    asked = asked.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), "query_id", F.col("vector").alias("asked"))
    metric = index.metric

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(left.num_rows, limit)
        if left.num_rows and right.num_rows:
            questions, ids, own = _matrix(left.column("asked")), _ids(right.column("id").combine_chunks()), _matrix(right.column("vector"))
            for first in range(0, len(questions), QUERIES_AT_ONCE):
                best.offer(first, questions[first : first + QUERIES_AT_ONCE], ids, own, metric)
            best.cut()
        if best.ids is None:
            return pa.table([pa.array([], left.schema.field("query_id").type), pa.array([], right.schema.field("id").type), pa.array([], pa.float64())], names=["query_id", "id", "distance"])
        return pa.table([left.column("query_id").combine_chunks().take(pa.array(best.query)), pa.array(best.ids), pa.array(best.distance)], names=["query_id", "id", "distance"])

    types = dict(rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    found = asked.groupBy("q_cell", "q_part").cogroup(rows.groupBy("cell", "part")).applyInArrow(run, f"query_id {types[1]}, id {types[0]}, distance double")
    return _ranked(found.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), limit)


def search_vectors(index: VectorIndex, queries: DataFrame, limit: int, exact: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the nearest rows that the index holds.

    Reads the ``probes`` cells nearest to each query, by default as many as the index was calibrated to. An ``exact``
    search goes on from there: the distances found bound those of the result, and then every cell is read that can
    hold a row as near, by the distance of its centre and its radius.
    """
    numbered = stored(queries.where("vector IS NOT NULL").select("query_id", "vector", F.monotonically_increasing_id().alias("row")), "queries")
    near = stored(_near_cells(index, numbered), "cells")
    first = near.where(F.col("place") < (probes or index.probes))
    found = _searched(index, numbered, first.select("row", "cell", "parts"), limit)
    if not exact:
        return found
    bars = found.where(F.col("rank") == limit).select("query_id", F.col("distance").alias("bar"))
    # A chord of the unit sphere for the cosine; a little more, as distances are rounded.
    bar = F.sqrt(2 * F.col("bar")) if index.metric == "cosine" else F.col("bar")
    may = near.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("away") - F.col("radius") <= bar * (1 + 1e-9) + 1e-9))
    return _searched(index, numbered, may.select("row", "cell", "parts"), limit)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, recall): the share of the exact results that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def mean_vectors(rows: DataFrame, by: str) -> DataFrame:
    """(query_id, vector): the mean vector per value of ``by``, as query vectors."""
    parts = rows.select(by, F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One short list per value: as long as the vectors are.
    listed = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return listed.select(F.col(by).alias("query_id"), F.transform("v", lambda p: p["x"]).alias("vector"))
