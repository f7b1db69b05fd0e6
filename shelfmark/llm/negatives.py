"""Hard negatives by a vertical scan of the vectors (branch and bound on decomposed data).

Rows are cut into fragments, ranges of (length, label, hash of the id) of bounded size, and each fragment is stored by
columns: one array per dimension with its least and greatest value. An anchor reads the columns of a fragment in the
descending order of its own magnitudes. What the columns not read yet can still add to a score lies between two sums of
their least and greatest values, so that each row has a range its score must lie in; rows whose range cannot matter any
more leave the bitmap of candidates, and only those left are read on. The same scan finds the positives (best rows of
the anchor's label, from fragments that hold it) and then the negatives (rows of other labels within the windows that
the positives' scores open).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import stored

# Rows per fragment and anchors per block, at most: what one task compares.
FRAGMENT, BLOCK = 4_096, 2_048
# Columns read before candidates are looked through again.
STEP = 8
# Positives per anchor, negatives per positive, and the window as shares of the positive's score.
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = (80, 100), (100, 100)


def usable(rows: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(``vec_id``, ``label``, ``vec``): scale * x per component, in double precision, of rows that take part.

    Left out: rows without id or label, and vectors that are null or hold null or non-finite components. Other columns
    are not looked at.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    valid = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    taken = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & valid)
    return taken.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), x.alias("vec"))


def fragments(rows: DataFrame, size: int) -> DataFrame:
    """Rows (``vec_id``, ``label``, ``vec``, ``number``, ``bars``) as fragments of up to ``size`` rows with vectors of one length, stored by columns.

    ``vec`` is rounded down here. A label with very many rows is dealt to several fragments by the ids.
    """
    parts = max(1, -(-rows.count() // size))
    by = ["dim", "label", "hash", "vec_id"]
    hashed = rows.withColumn("dim", F.size("vec")).withColumn("hash", F.xxhash64("vec_id", "vec"))
    dealt = hashed.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def packed(held: list[tuple]) -> dict:
        ids, labels, vectors, numbers, bars = zip(*held)
        x = np.floor(np.array(vectors, float).reshape(len(held), -1))
        names = np.array(labels, np.int64)
        return {
            "dim": x.shape[1], "labels": np.unique(names).tolist(), "ids": np.array(ids, np.int64).tobytes(), "label_of": names.tobytes(),
            "number_of": np.array(numbers, np.int64).tobytes(), "bars": list(bars), "columns": [x[:, d].tobytes() for d in range(x.shape[1])],
        }

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vec", "number", "bars"))):
                if held and (len(held) == size or len(held[0][2]) != len(row[2])):
                    yield pa.RecordBatch.from_pylist([packed(held)], schema=schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([packed(held)], schema=schema)

    schema = pa.schema(
        [("dim", pa.int32()), ("labels", pa.list_(pa.int64())), ("ids", pa.binary()), ("label_of", pa.binary()), ("number_of", pa.binary()),
         ("bars", pa.list_(pa.list_(pa.int64()))), ("columns", pa.list_(pa.binary()))]
    )
    made = dealt.mapInArrow(run, "dim int, labels array<bigint>, ids binary, label_of binary, number_of binary, bars array<array<bigint>>, columns array<binary>")
    return stored(made.withColumn("at", F.monotonically_increasing_id()), "fragments")


class Fragment:
    """One stored fragment: ``columns`` (dimension, row), ids, labels and what else its rows carry."""

    def __init__(self, row: dict):
        self.ids, self.labels, self.numbers = (np.frombuffer(row[c], np.int64) for c in ("ids", "label_of", "number_of"))
        held = row["columns"]
        self.columns = np.stack([np.frombuffer(c, np.float64) for c in held]) if held else np.zeros((0, len(self.ids)))
        self.bars = row["bars"]

    def exact_with(self, other: Fragment) -> tuple[np.ndarray, np.ndarray]:
        """Columns of both in the fastest numbers that hold every sum of products: floating point, 64-bit, or Python's integers."""
        most = float(np.abs(self.columns).max(initial=0)) * float(np.abs(other.columns).max(initial=0)) * max(1, len(self.columns))
        if most < 2.0**53:
            return self.columns, other.columns
        if most < 2.0**62:
            return self.columns.astype(np.int64), other.columns.astype(np.int64)
        whole = np.frompyfunc(int, 1, 1)
        return whole(self.columns), whole(other.columns)


def descend(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, greatest: np.ndarray, alive: np.ndarray, keep, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of ``alive`` that are left when all columns are read, their exact scores, and how many values were read.

    ``keep`` says from the least and the greatest score that rows can still have which of them stay.
    """
    order = np.argsort(-np.abs(anchor).astype(float), kind="stable")
    ends = np.stack([anchor * least, anchor * greatest])[:, order]
    # What the columns from each place of the order on can add.
    none = np.zeros(1, anchor.dtype)
    low = np.concatenate([np.cumsum(ends.min(0)[::-1])[::-1], none])
    high = np.concatenate([np.cumsum(ends.max(0)[::-1])[::-1], none])
    score, read = np.zeros(len(alive), anchor.dtype), 0
    for at in range(0, len(order), step):
        stays = keep(score + low[at], score + high[at])
        alive, score = alive[stays], score[stays]
        if not len(alive):
            break
        some = order[at : at + step]
        score = score + anchor[some] @ columns[some][:, alive]
        read += len(some) * len(alive)
    return alive, score, read


def best_rows(k: int):
    """Rows that can be among the ``k`` best."""
    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.sort(low)[-k]

    return keep


def best_in_windows(windows: list[tuple[int, int]], k: int):
    """Rows that can be among the ``k`` best of some window of scores (both ends belong to it)."""
    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for first, last in windows:
            may = (high >= first) & (low <= last)
            sure = low[may & (low >= first) & (high <= last)]
            stays |= may & (high >= np.sort(sure)[-k]) if len(sure) >= k else may
        return stays

    return keep


def ordered(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def _long(score) -> int:
    if not -(2**63) <= int(score) < 2**63:
        raise OverflowError("a score needs more than 64 bits")
    return int(score)


def window_of(score: int, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH) -> tuple[int, int]:
    """The whole scores s with low * score <= s <= high * score, as fractions."""
    return -(-score * low[0] // low[1]), score * high[0] // high[1]


def _solved(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` (a block of anchors, a fragment) per pair (``block``, ``at``)."""
    names = ["ids", "label_of", "number_of", "bars", "columns"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        made = solve(Fragment(left.select(names).to_pylist()[0]), Fragment(right.select(names).to_pylist()[0])) if left.num_rows and right.num_rows else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(types), types)], names=columns)

    columns = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int64()] * len(columns)
    left = pairs.join(anchors.withColumnRenamed("at", "block"), "block").select("block", "at", *names)
    right = pairs.join(rows, "at").select(F.col("block").alias("b"), F.col("at").alias("f"), *names)
    return left.groupBy("block", "at").cogroup(right.groupBy("b", "f")).applyInArrow(run, schema)


def _ends(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (columns.min(1), columns.max(1)) if columns.shape[1] else (np.zeros(len(columns)),) * 2


def _positives(k: int):
    def solve(block: Fragment, held: Fragment) -> list[tuple]:
        mine, theirs = block.exact_with(held)
        out, keep = [], best_rows(k)
        for label in np.intersect1d(block.labels, held.labels):
            same = np.flatnonzero(held.labels == label)
            # Rows of a label are close to each other: their own ends are the sharper ones.
            least, greatest = _ends(theirs[:, same])
            for i in np.flatnonzero(block.labels == label):
                alive, score, _ = descend(mine[:, i], theirs, least, greatest, same[held.ids[same] != block.ids[i]], keep)
                for j in ordered(score, held.ids[alive], k):
                    out.append((int(block.numbers[i]), int(block.ids[i]), int(held.ids[alive[j]]), _long(score[j])))
        return out

    return solve


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def solve(block: Fragment, held: Fragment) -> list[tuple]:
        mine, theirs = block.exact_with(held)
        least, greatest = _ends(theirs)
        out = []
        for i in range(len(block.ids)):
            windows = {score: window_of(score, low, high) for score in block.bars[i]}
            windows = {score: w for score, w in windows.items() if w[0] <= w[1]}
            if not windows:
                continue
            other = np.flatnonzero((held.labels != block.labels[i]) & (held.ids != block.ids[i]))
            alive, score, _ = descend(mine[:, i], theirs, least, greatest, other, best_in_windows(sorted(set(windows.values())), k))
            for positive, (first, last) in windows.items():
                inside = np.flatnonzero((score >= first) & (score <= last))
                for j in inside[ordered(score[inside], held.ids[alive[inside]], k)]:
                    out.append((int(block.numbers[i]), positive, int(held.ids[alive[j]]), _long(score[j])))
        return out

    return solve


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH,
    fragment: int = FRAGMENT, block: int = BLOCK,
) -> DataFrame:
    """(``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``) for the ``usable`` rows that are anchors.

    An anchor's positives are its best other rows of the same label by inner product, ties to smaller ids; its negatives
    for a positive are the best rows of other labels whose score lies between ``low`` and ``high`` times the positive's.
    Vectors are compared with those of the same length. A row that is repeated as a whole counts once; different rows
    that share an id stand each for itself, but never for each other's candidates. Fewer rows give fewer results, an
    empty table none. Scores are exact; one that needs more than 64 bits is an error.
    """
    distinct = stored(rows.distinct(), "distinct")
    plain = distinct.withColumn("number", F.lit(0).cast("bigint")).withColumn("bars", F.array().cast("array<bigint>"))
    data = fragments(plain, fragment)
    chosen = stored(distinct.where(is_anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    anchors = fragments(chosen.withColumn("bars", F.array().cast("array<bigint>")), block)

    holding = data.select("at", "dim", F.explode("labels").alias("label"))
    asking = anchors.select(F.col("at").alias("block"), "dim", F.explode("labels").alias("label"))
    near = _solved(
        asking.join(holding, ["dim", "label"]).select("block", "at").distinct(), anchors, data, _positives(positives),
        "number bigint, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    first = Window.partitionBy("number").orderBy(F.desc("positive_score"), "positive_id")
    best = stored(near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "positives")

    bars = best.groupBy("number").agg(F.collect_set("positive_score").alias("bars"))
    barred = fragments(chosen.join(bars, "number"), block)
    # Every block of anchors meets every fragment with vectors of its length: the stated queries against all rows.
    pairs = barred.select(F.col("at").alias("block"), "dim").join(data.select("at", "dim"), "dim").select("block", "at")
    found = _solved(pairs, barred, data, _negatives(negatives, low, high), "number bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    by_score = Window.partitionBy("number", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    return best.join(ranked, ["number", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
