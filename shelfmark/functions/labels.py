"""Category and tag columns: derivation, joining and parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS

# First matching path part decides the added tags.
RELATED_TAG_RULES = [
    ("meow", ["cat", "kitten", "animal"]),
    ("cat", ["meow", "kitten", "animal"]),
    ("dog", ["dog", "animal"]),
    ("roo", ["animal", "panda"]),
]

# The fence a reply may come in.
FENCE = f"^```json[{BLANKS}]*|[{BLANKS}]*```$"



def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def related_tags(path: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """Tags of the first rule whose needle occurs in ``path`` (rules are few and ordered)."""
    rules = RELATED_TAG_RULES if rules is None else rules
    return reduce(
        lambda rest, rule: F.when(path.contains(rule[0]), _strings(rule[1])).otherwise(rest),
        reversed(rules),
        _strings([]),
    )


def join_labels(categories: Column, tags: Column, related: Column) -> Column:
    return F.array_join(F.concat(categories, tags, related), ", ")


def distinct_labels(name: Column, categories: Column, tags: Column, related: Column) -> Column:
    """Every label once, in lower case, in the order of first appearance."""
    every = F.concat(F.array(name), categories, tags, related)
    return F.array_join(F.array_distinct(F.transform(every, F.lower)), ", ")


def parse_label_reply(reply: Column) -> Column:
    """Labels from a labeller's reply, fenced or bare JSON; null where it is not JSON."""
    bare = F.regexp_replace(reply, FENCE, "")
    bare = F.regexp_replace(bare, f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    parsed = F.from_json(
        bare,
        "categories array<string>, tags array<string>, broken string",
        {"columnNameOfCorruptRecord": "broken"},
    )
    nothing = F.array().cast("array<string>")
    labels = F.struct(
        F.coalesce(parsed["categories"], nothing).alias("categories"),
        F.coalesce(parsed["tags"], nothing).alias("tags"),
    )
    readable = reply.isNotNull() & (bare != "") & parsed["broken"].isNull()
    return F.when(readable, labels)


def has_labels(labels: Column) -> Column:
    return (F.coalesce(F.size(labels["categories"]), F.lit(0)) > 0) | (
        F.coalesce(F.size(labels["tags"]), F.lit(0)) > 0
    )


def hit_record(url: Column, raw_url: Column, content: Column, meta: Column, trim: bool = True) -> list[Column]:
    """A search hit as an asset record; labels come back from the joined content."""
    categories = F.split(content, ",")
    if trim:
        categories = F.transform(categories, lambda c: F.trim(c))
    digits = F.regexp_extract(F.trim(meta["size"]), r"^([+-]?\d+)", 1)
    return [
        F.coalesce(meta["id"], F.lit("")).alias("id"),
        F.coalesce(url, F.lit("")).alias("filename"),
        F.when(F.coalesce(raw_url, F.lit("")) == "", url).otherwise(raw_url).alias("path"),
        F.coalesce(categories, F.array().cast("array<string>")).alias("categories"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("").alias("created"),
        F.coalesce(digits.try_cast("bigint"), F.lit(0)).alias("size"),
    ]
