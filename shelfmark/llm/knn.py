"""Exact top-k search by inner product as a Voronoi join.

Every row belongs to the cell of its nearest pivot. A cell's summary is its size and the distances of its nearest rows
to the pivot. For a query q, a row x of cell j has q.p_j - |q||x - p_j| <= q.x <= q.p_j + |q||x - p_j|: from the
summaries follows a score that k rows reach for certain, and from that the distance to the pivot from which on a row
of a cell can matter to a block of queries. Only such rows are sent to the block, where they are scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import stored

# Pivots, queries per block, rows that one task scores for a block at a time.
PIVOTS = 128
BLOCK = 512
SLICE = 16_384
# Bounds are floating point: rows this near (in relation) to a bound are sent, too.
SLACK = 1e-9


def quantized(rows: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``vec_id``, ``vec``): floor(scale * x) per component of valid vectors.

    Left out: rows without id, and vectors that are null or hold null or non-finite components. Components are whole
    numbers in double precision, of any size.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Beyond 2^53 a double has no fraction, and the SQL function would stop at 64 bits.
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) >= 2.0**53, v * scale).otherwise(F.floor(v * scale).cast("double")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("bigint").alias("vec_id"), whole.alias("vec"))


def _matrix(batch: pa.RecordBatch, column: str = "vec") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums are whole numbers below 2^53, in 64 bits, or in Python's integers.

    A product that needs more than 64 bits is an error.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return a.dot(b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64).dot(b.T.astype(np.int64))
    whole = np.frompyfunc(int, 1, 1)
    found = whole(a).dot(whole(b).T)
    if max(-found.min(), found.max() + 1) > 2**63:
        raise OverflowError("a score needs more than 64 bits")
    return found.astype(np.int64)


def best_of(queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the ``k`` best candidates with another id, ties to smaller ids, each id once."""
    order = np.argsort(candidates, kind="stable")
    candidates, vectors = candidates[order], vectors[order]
    first = np.flatnonzero(np.r_[True, candidates[1:] != candidates[:-1]])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 128):
        scores = _products(queries[at : at + 128], vectors)
        if len(first) < len(candidates):
            scores = np.maximum.reduceat(scores, first, axis=1)
        names = candidates[first]
        lowest = np.iinfo(np.int64).min
        scores[ids[at : at + 128, None] == names[None, :]] = lowest
        keep = min(k, scores.shape[1])
        bar = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        for i in range(len(scores)):
            near = np.flatnonzero(scores[i] >= bar[i])
            # Candidates stand in order of their ids, so a stable sort breaks ties rightly.
            near = near[np.argsort(-scores[i][near], kind="stable")][:keep]
            near = near[scores[i][near] > lowest]
            out.append((np.full(len(near), ids[at + i]), names[near], scores[i][near]))
    return tuple(np.concatenate(c) if out else np.empty(0, np.int64) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row of ``quantized`` that ``is_query``, its ``k`` best.

    ``is_query`` is a condition on vec_id. Rows that share a vec_id are one candidate and one query with the best of
    their scores, and never their own candidate. Vectors are compared with those of the same length only. Fewer than
    ``k`` candidates give fewer rows; an empty table gives none. The pivots are a bounded number of rows, chosen by a
    hash; they decide what is sent, never what is found.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, score bigint"
    kept = stored(vectors.withColumn("dim", F.size("vec")), "vectors")
    dims = [row["dim"] for row in kept.where(is_query).select("dim").distinct().collect()]
    parts = [_search_dim(kept.where(F.col("dim") == dim), is_query, k, pivots, block, slice_rows, schema) for dim in dims]
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.union(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_dim(rows: DataFrame, is_query, k: int, pivots: int, block: int, slice_rows: int, schema: str) -> DataFrame:
    # The pivots: at most ``pivots`` different vectors.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    centre = np.array(list(dict.fromkeys(tuple(row["vec"]) for row in sample))[:pivots], float)
    if centre.shape[1] == 0:
        centre = np.zeros((1, 0))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch) if centre.shape[1] else np.zeros((batch.num_rows, 0))
                square = np.maximum((x**2).sum(1)[:, None] - 2 * x.dot(centre.T) + (centre**2).sum(1)[None, :], 0)
                cell = square.argmin(1)
                away = np.sqrt(((x - centre[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["vec_id", "vec", "cell", "away"])

    placed = stored(rows.select("vec_id", "vec").mapInArrow(place, "vec_id bigint, vec array<double>, cell int, away double"), "cells")
    # Summaries: k + 1 rows per cell (one may be the query's own) and the sizes. Bounded by the pivots.
    nearest = placed.groupBy("cell", "vec_id").agg(F.max("away").alias("away"))
    by_distance = Window.partitionBy("cell").orderBy("away", "vec_id")
    summary = nearest.withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= k + 1).select("cell", "vec_id", "away").toPandas()
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q"), F.max("away").alias("far")).toPandas()
    total = int(sizes["n"].sum())

    # Blocks: neighbouring cells together until a block is full, a large cell in several blocks.
    asked = np.zeros(len(centre), np.int64)
    asked[sizes["cell"]] = sizes["q"]
    far = np.full(len(centre), -1.0)
    far[sizes["cell"]] = sizes["far"]
    first_block, parts_of, current, filled = np.zeros(len(centre), np.int64), np.ones(len(centre), np.int64), 0, 0
    for cell in np.lexsort((np.arange(len(centre)), _chain(centre))):
        if filled and filled + asked[cell] > block:
            current, filled = current + 1, 0
        first_block[cell], parts_of[cell] = current, max(1, -(-int(asked[cell]) // block))
        current, filled = current + parts_of[cell] - 1, asked[cell] if parts_of[cell] == 1 else block
    blocks = F.array(*[F.lit(int(x)) for x in first_block])
    split = F.array(*[F.lit(int(x)) for x in parts_of])
    own = F.get(blocks, F.col("cell")) + F.pmod(F.xxhash64("vec_id"), F.get(split, F.col("cell")).cast("bigint"))
    queries = placed.where(is_query).withColumn("block", own.cast("int"))
    sure_cell, sure_id, sure_away = summary["cell"].to_numpy(), summary["vec_id"].to_numpy(), summary["away"].to_numpy()

    def bounds(batches):
        lowest: dict[tuple[int, int], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch) if centre.shape[1] else np.zeros((batch.num_rows, 0))
            ids, block_of = batch.column("vec_id").to_numpy(), batch.column("block").to_numpy()
            to_pivot, norm = q.dot(centre.T), np.sqrt((q**2).sum(1))
            sure = to_pivot[:, sure_cell] - norm[:, None] * sure_away[None, :]
            need = np.empty(len(q))
            for i in range(len(q)):
                other = sure_id != ids[i]
                each: dict[int, float] = {}
                for name, value in zip(sure_id[other], sure[i][other]):
                    each[name] = max(each.get(name, -np.inf), value)
                top = sorted(each.values(), reverse=True)
                need[i] = top[k - 1] if len(top) >= k else -np.inf
            slack = SLACK * (1 + np.abs(to_pivot) + norm[:, None] * np.maximum(far, 1)[None, :])
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (need[:, None] - to_pivot - slack) / norm[:, None]
            least[~(least > 0)] = 0.0
            for b in np.unique(block_of):
                for cell, value in enumerate(least[block_of == b].min(0)):
                    if value <= far[cell]:
                        lowest[b, cell] = min(lowest.get((b, cell), np.inf), value)
        keys = list(lowest)
        yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in keys], pa.int32()), "cell": pa.array([c for _, c in keys], pa.int32()), "least": pa.array([lowest[x] for x in keys], pa.float64())})

    needed = queries.select("vec_id", "vec", "block").mapInArrow(bounds, "block int, cell int, least double")
    # One row per block and cell at most; the join takes whichever way this size allows.
    limits = stored(needed.groupBy("block", "cell").agg(F.min("least").alias("least")), "limits")
    sent = placed.join(limits, "cell").where("away >= least")
    parts = max(1, -(-total // slice_rows))
    data = sent.select("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "vec")
    asking = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*[F.col(c).alias(f"q_{c}") for c in ("block", "part", "vec_id", "vec")])

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dim = centre.shape[1]
        q, x = (np.array(v.tolist(), float).reshape(len(v), dim) for v in (left["q_vec"], right["vec"]))
        a, b, c = best_of(q, left["q_vec_id"].to_numpy(), right["vec_id"].to_numpy(), x, k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return asking.groupBy("q_block", "q_part").cogroup(data.groupBy("block", "part")).applyInPandas(solve, schema)


def _chain(centre: np.ndarray) -> np.ndarray:
    """A place for each pivot, so that near ones stand near each other: from one to the nearest that is left."""
    place, at = np.zeros(len(centre), np.int64), 0
    left = np.ones(len(centre), bool)
    for n in range(len(centre)):
        place[at], left[at] = n, False
        if left.any():
            away = ((centre - centre[at]) ** 2).sum(1)
            at = int(np.where(left, away, np.inf).argmin())
    return place
