"""Near copies by SimHash and exact Jaccard similarity of word shingles.

First, SimHash by anchor-point covering (``simhash``) over the five-word shingles brings together the sets whose
fingerprints differ in few bits; each of its links is compared exactly before it holds. Near copies by the bound below
differ in more bits than any covering can afford, so what the fingerprints leave apart goes on to MinHash bands.

Candidates there come from MinHash bands: BANDS times ROWS minima per set of shingles, sets that agree in all minima of a
band share a bucket. A pair of similarity s shares none with a chance of (1 - s^ROWS)^BANDS, 3 in a million at 0.8 and
less above. Each candidate pair that is not connected yet is compared exactly before it is linked. A bucket first
compares one of its sets with all others, so that large groups of near copies cost a few rows each. Sets that then still
share a bucket without being connected go through an exact filter: sets of similarity s or more share one of their rarest
shingles, as many as may differ, and from the first one they share on, both hold enough that others hold, too. Families
of texts with a common passage, alike but not alike enough, have too few shingles from there on and meet nobody.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.graph import components
from shelfmark.llm.simhash import links, majority, shingle_hashes
from shelfmark.llm.texts import as_bytes, let_go, slices
from shelfmark.session import stored

# Words per shingle, and the least similarity of a link as a fraction: compared in whole numbers.
SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
# Bands of the first round, and rounds in which one set per bucket is compared with the others before the filter.
FIRST_BANDS, STAR_ROUNDS = 4, 3
AT_ONCE = 512
# Sizes within this factor are one class when sets of a fitting size are looked up.
SIZE_STEP = 1.02

_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
FLIP, FACTOR = _DRAWN[0] << np.uint64(1) ^ _DRAWN[1], _DRAWN[1] | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def name_of(values: np.ndarray) -> int:
    """A set's own number: texts of equal sets are one point; 0 for texts without words."""
    return xxhash.xxh64_intdigest(values.tobytes()) if len(values) else 0


def bands(values: np.ndarray) -> np.ndarray:
    """A key per band: hash of the minima of its rows."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(values), AT_ONCE):
        np.minimum(least, ((values[None, at : at + AT_ONCE] ^ FLIP) * FACTOR).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches SIMILARITY."""
    up, down = SIMILARITY
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * down >= up * (len(a) + len(b) - both)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``point``, ``n``, ``fp``, ``bands``): the set's number, size and fingerprint, and its bands, none for texts without words."""
    def run(batches):
        let_go()
        for batch in slices(batches, text):
            sets = [shingles(value) for value in as_bytes(batch, text)]
            columns = [batch.column(key), pa.array(np.array([name_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32())]
            columns.append(pa.array(np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)))
            columns.append(pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "point", "n", "fp", "bands"])

    rows = docs.select(key, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, point bigint, n int, fp bigint, bands array<bigint>")


def fingerprint_pairs(points: DataFrame) -> DataFrame:
    """(``a``, ``b``) of ``points`` (``point``, ``n``, ``fp``): sets of one fingerprint, and of fingerprints that SimHash links.

    As many pairs as sets, at most: one set stands for all of its fingerprint, and links come as stars.
    """
    own = points.where("n > 0").select("fp", "point")
    named = stored(own.groupBy("fp").agg(F.min("point").alias("first")), "fingerprints")
    same = own.join(named, "fp").where("point != first").select(F.col("first").alias("a"), F.col("point").alias("b"))
    near = stored(links(named.select("fp")), "close").distinct()
    left, right = named.select(F.col("fp").alias("a"), F.col("first").alias("p")), named.select(F.col("fp").alias("b"), F.col("first").alias("point"))
    return same.unionByName(_met(near.join(left, "a").join(right, "b").select("p", "point"), None))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``linked``) for ``pairs`` (``a``, ``b``) of points. The set of an ``a`` is sent once."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"a": [], "b": [], "linked": []})
        own = np.frombuffer(right["own"].iloc[0], np.uint64)
        linked = [similar(own, np.frombuffer(x, np.uint64)) for x in left["held"]]
        return pd.DataFrame({"a": left["a"], "b": left["b"], "linked": linked})

    # Sets of very many others are dealt out over several tasks.
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    sent = dealt.join(sets.withColumnRenamed("point", "b"), "b").select("a", "part", "b", "held")
    owners = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("point", "a"), "a").select("a", "part", "held").toDF("owner", "of", "own")
    return sent.groupBy("a", "part").cogroup(owners.groupBy("owner", "of")).applyInPandas(run, "a bigint, b bigint, linked boolean")


def _open(buckets: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The buckets' rows with their root, and the buckets whose sets are not all connected."""
    rows = buckets.withColumn("root", F.col("point"))
    if roots is not None:
        rows = buckets.join(roots, buckets["point"] == roots["node"], "left").select("bucket", "point", "n", "crowd", F.coalesce("root", "point").alias("root"))
    spans = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rows, spans.where("low < high").select("bucket")


def _met(pairs: DataFrame, checked: DataFrame | None) -> DataFrame:
    """(``a``, ``b``), a < b, once each and without those that are compared already."""
    pairs = pairs.select(F.least("point", "p").alias("a"), F.greatest("point", "p").alias("b")).distinct()
    return pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti")


def _stars(buckets: DataFrame, roots: DataFrame | None, checked: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of one set of each open bucket, another one in each turn, with the bucket's sets that are not connected to it.

    The first is the set that shares buckets with the most others: of a family of copies of one text, the one with the
    fewest changes, which is similar to many that are not similar to each other.
    """
    rows, open_ones = _open(buckets, roots)
    best = F.struct("crowd", "point") if turn == 0 else F.struct(F.xxhash64("point", F.lit(turn)), "point")
    first = rows.groupBy("bucket").agg(F.max_by(F.struct("point", "n", "root"), best).alias("first"))
    other = first.join(open_ones, "bucket").select("bucket", F.col("first.point").alias("p"), F.col("first.n").alias("m"), F.col("first.root").alias("r"))
    up, down = SIMILARITY
    # Sets whose sizes alone rule the similarity out are not sent.
    met = rows.join(other, "bucket").where("root != r").where(F.least("n", "m") * down >= F.greatest("n", "m") * up)
    return _met(met, checked)


def _unpacked(sets: DataFrame) -> DataFrame:
    """(``point``, ``token``): the shingles of the sets, one per row."""
    def run(batches):
        let_go()
        for batch in slices(batches, "held", 1 << 22):
            held = [np.frombuffer(x, np.int64) for x in batch.column("held").to_pylist()]
            points = np.repeat(batch.column("point").to_numpy(), [len(x) for x in held])
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.concatenate(held) if held else np.empty(0, np.int64))], names=["point", "token"])

    return sets.mapInArrow(run, "point bigint, token bigint")


def rare_pairs(points: DataFrame, sets: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """(``a``, ``b``): all pairs of ``points`` (``point``, ``n``, ``root``) with another root that can be similar enough.

    Of a set's n shingles, those that no other of these sets holds cannot be common to a pair: ``m`` are left. A pair
    of similarity u / d has at least (n + n') * u / (u + d) in common. In one order of all shingles, the rarest first, what
    two sets share stands from their first common shingle on, so the m of both must reach that number counted from there:
    a pair meets at its first common shingle or not at all, and texts that share one passage and little else do not. The smaller
    set of a pair looks for sizes from its own up to the largest that its m allows.
    """
    up, down = SIMILARITY
    tokens = stored(_unpacked(sets.join(points.select("point"), "point", "left_semi")), "tokens")
    several = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = stored(tokens.join(several, "token"), "shared")
    fitting = shared.groupBy("point").agg(F.count("*").alias("m")).join(points, "point").where(F.col("m") * down >= F.col("n") * up)
    # The place up to which a set's rarest shingles count, those of its own being the first.
    last = F.col("m") - F.ceil(F.col("n") * up / F.lit(float(down))) + 1
    rarest = Window.partitionBy("point").orderBy("df", "token")
    rows = shared.join(fitting.select("point", "n", "m", "root", last.alias("last")), "point").withColumn("place", F.row_number().over(rarest))
    # From a shingle on, so many of a set's shingles are left.
    rows = rows.where("place <= last").select("token", "point", "n", (F.col("m") - F.col("place") + 1).alias("m"), "root")
    rows = stored(rows, "rarest")
    size = lambda n: F.floor(F.log(SIZE_STEP, n)).cast("int")
    largest = F.least(F.col("n") * down / F.lit(float(up)), F.col("m") * (up + down) / F.lit(float(up)) - F.col("n"))
    asking = rows.where(largest >= F.col("n")).withColumn("size", F.explode(F.sequence(size(F.col("n").cast("double")), size(largest + 1e-6))))
    held = rows.select("token", size(F.col("n").cast("double")).alias("size"), F.col("point").alias("p"), F.col("n").alias("k"), F.col("m").alias("l"), F.col("root").alias("r"))
    met = asking.join(held, ["token", "size"]).where("root != r AND (n < k OR n = k AND point < p)")
    return _met(met.where((F.col("n") + F.col("k")) * up <= F.least("m", "l") * (up + down)), checked)


def _left(buckets: DataFrame, sets: DataFrame, roots: DataFrame | None, checked: DataFrame | None) -> DataFrame:
    """Pairs among all sets in buckets that are still open."""
    rows, open_ones = _open(buckets, roots)
    points = stored(rows.join(open_ones, "bucket", "left_semi").select("point", "n", "root").distinct(), "open")
    return rare_pairs(points, sets, checked)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``component``): the smallest key that links reach from each row; links join texts of similarity 0.8 or more.

    Texts of equal shingles are one point, so a group of copies costs one row; null, empty and blank texts are copies
    of each other. SimHash's links come first, what they leave apart goes through the bands. ``docs`` is read twice, so
    its ``key`` must be stored.
    """
    marked = stored(signatures(docs, key, text), "signatures")
    points = stored(marked.groupBy("point").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")), "points")
    near = stored(fingerprint_pairs(points.select("point", "n", "fp")), "pairs")
    banded = marked.groupBy("point").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    placed = banded.select("point", "n", F.posexplode("bands").alias("band", "bucket"))
    full = placed.groupBy("bucket").count().where("count > 1")
    held = stored(placed.join(full, "bucket"), "held")
    crowds = held.groupBy("point").agg(F.sum("count").alias("crowd"))
    buckets = stored(held.drop("count").join(crowds, "point"), "buckets")
    met = buckets.select("point").union(near.select("a")).union(near.select("b")).distinct()
    wanted = points.join(met, "point", "left_semi").select("point", F.col("least").alias(key))

    def hold(batches):
        let_go()
        for batch in slices(batches, text):
            held = [shingles(value).tobytes() for value in as_bytes(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array(held, pa.binary())], names=["point", "held"])

    texts = docs.select(key, F.col(text).cast("string").alias(text)).join(wanted, key).select("point", text)
    sets = stored(texts.mapInArrow(hold, "point bigint, held binary"), "sets")

    found, roots = [], None
    for turn in range(-1, STAR_ROUNDS + 1):
        some = buckets.where(F.col("band") < FIRST_BANDS) if turn == 0 else buckets
        checked = reduce(DataFrame.union, [f.select("a", "b") for f in found]) if found else None
        if turn < 0:
            pairs = near
        else:
            pairs = stored(_stars(some, roots, checked, turn) if turn < STAR_ROUNDS else _left(buckets, sets, roots, checked), "pairs")
        if pairs.isEmpty():
            continue
        found.append(stored(_compared(pairs, sets), "compared"))
        roots = components(reduce(DataFrame.union, [f.where("linked").select("a", "b") for f in found]))
    least = points.select("point", "least")
    if roots is not None:
        rooted = least.join(roots, least["point"] == roots["node"], "left").select("point", "least", F.coalesce("root", "point").alias("root"))
        low = rooted.groupBy("root").agg(F.min("least").alias("component"))
        named = rooted.join(low, "root").select("point", "component")
    else:
        named = least.withColumnRenamed("least", "component")
    return marked.select(key, "point").join(named, "point").select(key, "component")


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest key, and of its copies the first row."""
    # The number of a row depends on how a scan is split, so numbered rows are written once and only read from there.
    at = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"))
    numbered = stored(docs.withColumn("__at", at), "numbered")
    chosen = groups(numbered, "__at", text).where(F.col("__at") == F.col("component")).select("__at")
    return numbered.join(chosen, "__at", "left_semi").drop("__at")
