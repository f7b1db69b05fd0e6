"""Related tags from a rule table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import related_tags
from .skew import distinct_lengths, length_array, pin_small

# Rules up to this number become one expression evaluated per row.
MAX_INLINE_RULES = 200


def related_tags_from(assets: DataFrame, rules: DataFrame, max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """Add ``related``: the tags of the first rule (priority, needle, tags) whose needle is in ``path``.

    An empty needle is in every path; rules of one priority go by needle.

    Many rules are matched by an equi-join: a path is cut into all pieces as long as some needle.
    """
    pinned = pin_small(rules, max_inline)
    if pinned is not None:
        listed = [(r["needle"], r["tags"]) for r in pinned.orderBy("priority", "needle").collect()]
        return assets.withColumn("related", related_tags(F.col("path"), listed))
    lengths = length_array(distinct_lengths(rules, "needle"))
    pieces = F.flatten(
        F.transform(
            F.filter(lengths, lambda n: n <= F.length("path")),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("path") - n + 1), lambda at: F.substring(F.col("path"), at, n)
            ),
        )
    )
    paths = assets.select("path").distinct()
    cut = paths.select("path", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(pieces))).alias("needle"))
    first = cut.join(rules, "needle").groupBy("path").agg(F.min_by("tags", F.struct("priority", "needle")).alias("related"))
    return assets.join(first, "path", "left").withColumn(
        "related", F.coalesce("related", F.array().cast("array<string>"))
    )
