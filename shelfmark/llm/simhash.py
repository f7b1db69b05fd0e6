"""SimHash near-duplicates by anchor-point covering.

Bits 0-22 and 23-45 of a fingerprint are covered by the perfect Golay code of length 23 and radius 3, the other 18
bits by the empty word alone. The product of both codes gives the anchors: each fingerprint lies within the radius
of one anchor in each half, its home. A fingerprint that differs in at most ``distance`` bits lies within the radius
plus its share of the distance in each half, so it is sent to every anchor for which these shares fit, and meets the
other one at its home. Per anchor, homes are compared with all that came.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.graph import components, local_stars
from shelfmark.llm.texts import as_bytes, let_go, slices, words_of
from shelfmark.session import stored

SEED = 42
SHINGLE = 3
DISTANCE = 2
HALF = 23
RADIUS = 3
# Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
# Rows (a fingerprint at an anchor) that one task compares; homes of one anchor above HOT_HOMES are dealt out.
TASK_ROWS = 400_000
# Anchors per fingerprint, on average, at a distance of 2: only the number of tasks rests on it.
ANCHORS_EACH = 61
HOT_HOMES = 20_000
PAIRS_AT_ONCE = 2_000_000

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)


def shingle_hashes(text: bytes | None, n: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of all runs of ``n`` words, repeats included; of the whole text if it has fewer; none without words."""
    words = words_of(text)
    if not words:
        return []
    whole, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [hashed(whole, seed)]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends]]
    return [hashed(whole[a:b], seed) for a, b in zip(starts, ends[n - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set where it is set in over half of the hashes."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    result = 0
    for byte in range(8):
        # A count per byte value costs one pass, whatever the number of hashes.
        set_in = np.bincount(columns[:, byte], minlength=256).astype(np.float64) @ BITS
        for bit in np.flatnonzero(2 * set_in > len(hashes)):
            result |= 1 << (8 * byte + int(bit))
    return result


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(``key``, ``fp``): the fingerprint as a signed 64-bit number; null, empty and blank texts have 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, text):
            found = np.zeros(batch.num_rows, np.uint64)
            for i, value in enumerate(as_bytes(batch, text)):
                hashes = shingle_hashes(value, n, seed)
                if hashes:
                    found[i] = majority(np.array(hashes, np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], names=[key, "fp"])

    rows = docs.select(key, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} {kind}, fp bigint")


def _remainders() -> np.ndarray:
    """Remainder of each of the 23 single bits by the generator: those of any word are sums of these."""
    found = []
    value = 1
    for _ in range(HALF):
        found.append(value)
        value <<= 1
        if value >> (HALF - 12):
            value ^= GOLAY if value >> 11 & 1 else 0
    return np.array(found, np.int64)


class Code:
    """For each remainder, the error patterns of up to RADIUS + DISTANCE bits that lead from a word to a codeword."""

    def __init__(self, distance: int = DISTANCE):
        single = _remainders()
        table = np.zeros((3, 256), np.int64)
        for part in range(3):
            for bit in range(8):
                if part * 8 + bit < HALF:
                    table[part] ^= np.where(np.arange(256) >> bit & 1, single[part * 8 + bit], 0)
        self.table, self.distance = table, distance
        patterns, weights = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        last, tops = patterns[0], np.array([-1])
        for weight in range(1, RADIUS + distance + 1):
            grown = [(last[tops < bit] | (1 << bit), bit) for bit in range(HALF)]
            last, tops = np.concatenate([g for g, _ in grown]), np.concatenate([np.full(len(g), bit) for g, bit in grown])
            patterns.append(last)
            weights.append(np.full(len(last), weight))
        pattern, weight = np.concatenate(patterns), np.concatenate(weights)
        remainder = self.remainder(pattern)
        order = np.lexsort((weight, remainder))
        self.pattern, self.extra = pattern[order], np.maximum(weight[order] - RADIUS, 0)
        self.first = np.searchsorted(remainder[order], np.arange(1 << 11))
        self.count = np.bincount(remainder, minlength=1 << 11)

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.table[0][words & 255] ^ self.table[1][words >> 8 & 255] ^ self.table[2][words >> 16]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``fp``, anchor, whether it is the home) for all anchors that a fingerprint goes to."""
        mask = (1 << HALF) - 1
        low, high = fp & mask, fp >> HALF & mask
        at_low, at_high = self.remainder(low), self.remainder(high)
        index = np.repeat(np.arange(len(fp)), self.count[at_low])
        within = np.arange(len(index)) - np.repeat(np.cumsum(self.count[at_low]) - self.count[at_low], self.count[at_low])
        choice_low = self.first[at_low][index] + within
        # Patterns are in order of weight: of the second half only those are listed for which bits are left.
        left = self.distance - self.extra[choice_low]
        reach = np.stack([np.bincount(self.remainder(self.pattern[self.extra <= k]), minlength=1 << 11) for k in range(self.distance + 1)])
        sizes = reach[left, at_high[index]]
        second = np.repeat(np.arange(len(index)), sizes)
        nth = np.arange(len(second)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index, choice_low = index[second], choice_low[second]
        choice_high = self.first[at_high][index] + nth
        anchor = (low[index] ^ self.pattern[choice_low]) | (high[index] ^ self.pattern[choice_high]) << HALF
        home = (choice_low == self.first[at_low][index]) & (choice_high == self.first[at_high][index])
        return index, anchor, home


def close_pairs(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and all others of the same anchor, reduced to stars."""
    order = np.lexsort((~home, anchor))
    anchor, fp, home = anchor[order], fp[order], home[order]
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1))
    found_a, found_b = [], []
    # Homes with the anchors' members, in runs of a bounded number of pairs; one home against a huge anchor is a run.
    todo = np.cumsum(sizes[group[homes]])
    at = 0
    while at < len(homes):
        done = todo[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(todo, done + PAIRS_AT_ONCE, "right")))
        some = homes[at:to]
        n = sizes[group[some]]
        left = np.repeat(some, n)
        right = np.repeat(starts[group[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
        linked = (differ > 0) & (differ <= distance)
        if linked.any():
            a, b = local_stars(fp[left[linked]], fp[right[linked]])
            found_a.append(a)
            found_b.append(b)
        at = to
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return local_stars(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, distance: int = DISTANCE, task_rows: int = TASK_ROWS, hot_homes: int = HOT_HOMES) -> DataFrame:
    """(``a``, ``b``): links that connect just what fingerprints (column ``fp``, each once) within ``distance`` connect.

    All links of an anchor are looked at; what leaves the task is a star per connected set of them.
    """
    def spread(reach: int):
        def run(batches):
            let_go()
            code = Code(reach)
            for batch in batches:
                values = batch.column("fp").to_numpy(zero_copy_only=False)
                for at in range(0, len(values), 5_000):
                    part = values[at : at + 5_000]
                    index, anchor, home = code.anchors(part)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index]), pa.array(home)], names=["anchor", "fp", "home"])

        return distinct.mapInArrow(run, "anchor bigint, fp bigint, home boolean")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = close_pairs(frame["anchor"].to_numpy(), frame["fp"].to_numpy(), frame["home"].to_numpy(), distance)
        return pd.DataFrame({"a": a, "b": b})

    placed = spread(distance)
    points = distinct.count()
    # Anchors that are home to very many near copies are dealt out by home; all that visit them go to each part.
    hot = None
    if points > hot_homes:
        hot = stored(spread(0).groupBy("anchor").count().where(F.col("count") > hot_homes), "anchors")
    if hot is not None and not hot.isEmpty():
        parts = F.coalesce(F.ceil(F.col("count") / hot_homes), F.lit(1)).cast("int")
        own = F.array(F.pmod(F.xxhash64("fp"), parts).cast("int"))
        marked = placed.join(hot, "anchor", "left").withColumn("parts", parts)
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        mine = marked.withColumn("part", each).withColumn("home", F.col("home") & (F.col("part") == own[0]))
        placed = mine.withColumn("place", F.xxhash64("anchor", "part")).select("anchor", "fp", "home", "place")
    else:
        placed = placed.withColumn("place", F.xxhash64("anchor"))
    tasks = max(1, -(-points * ANCHORS_EACH // task_rows))
    dealt = placed.withColumn("task", F.pmod("place", F.lit(tasks))).select("task", "anchor", "fp", "home")
    return dealt.groupBy("task").applyInPandas(compare, "a bigint, b bigint")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(``key``, ``fp``, ``component``): each row's fingerprint and the smallest key that links reach from it.

    Equal fingerprints are one point, so a group of copies of any size costs one row. Null and empty texts have
    fingerprint 0 and are linked like any other. Rows without a key take their group's smallest key, null if it has
    none; repeated rows stay. An empty table gives an empty result; other columns are not looked at.
    """
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    points = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(points.select("fp"), distance))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select(F.col("fp").alias("point"), "component")
    return marked.join(named, marked["fp"] == named["point"]).select(key, "fp", "component")
