"""Mixing sources to target weights, in native functions only.

Words are summed per source, targets are set by weight, and each document is taken floor(rate) times
plus once more when a hash of its id, read as a number in [0, 1), lies below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import count_words
from shelfmark.operators.skew import rank_in_group
from shelfmark.session import stored

# Weights of the sources in code point order, repeating; share of all words that the mix takes; most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a key, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of (source, size).

    A target is the source's part of ``share`` times all words by weight, at most ``most`` times what the
    source has; what is cut off goes to the others by weight, again until no target is too large. Each round
    is one sum over the small table of sources, and no round follows once none is newly cut.
    """
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    ordered = sums.withColumns({"last": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    # One row per source from here on.
    ranked = rank_in_group(stored(ordered, "sources"), [], [("last", True), ("name", True)], "n")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(kinds, (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")

    total, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, cap = share * (total or 0), F.col("source_size") * F.lit(most)
    rest, rest_weight = wanted, all_weight or 0.0
    while rest_weight:
        over = cap < F.col("weight") * F.lit(rest) / F.lit(rest_weight)
        cut, cut_weight = table.agg(F.sum(F.when(over, cap)), F.sum(F.when(over, F.col("weight")))).first()
        left, left_weight = wanted - (cut or 0), all_weight - (cut_weight or 0)
        if left_weight == rest_weight:
            break
        rest, rest_weight = left, left_weight
    fair = F.col("weight") * F.lit(float(rest)) / F.lit(float(rest_weight or 1))
    return table.select("source", "source_size", F.least(cap, fair).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **targets) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words taken, repeats counted).

    A null text has size 0; a null source is a source of its own, after all others; a null key draws like an
    empty one. Rows that share a key share their draw. A source without words has target 0 and none of its
    documents is taken. An empty table gives an empty result. Columns of ``docs`` named like results are replaced.
    The table of sources is joined by whichever way its size allows; a hot source is split as a skewed join.
    """
    sized = docs.withColumn("size", count_words(text))
    table = source_targets(sized.select(F.col(source).alias("source"), "size"), **targets)
    goals = table.select(F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target")))
    joined = sized.join(goals, sized[source].eqNullSafe(goals["__source"]), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(sized[key]) < rate - F.floor(rate)).cast("bigint")
    result = joined.withColumns(
        {"source_size": F.col("__source_size"), "target": F.col("__target"), "copies": copies}
    ).withColumn("taken", F.col("copies") * F.col("size"))
    return result.drop("__source", "__source_size", "__target")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
