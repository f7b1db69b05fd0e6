"""Approximate lookup of words in catalog fields by edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import field_tokens
from .skew import pin_small


def allowed_distance(length: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / 4)).cast("int")


def with_pieces(rows: DataFrame) -> DataFrame:
    """Add edits, number, start and size of the pieces that a word of ``n`` letters is cut into, one row per piece.

    A word has one piece more than edits are allowed, so at least one piece survives in every
    word within that distance, moved by no more places than there are edits.
    """
    pieces, number = F.col("edits") + 1, F.col("number")
    small = F.floor(F.col("n") / pieces).cast("int")
    # The last pieces take one letter more each until all letters are dealt.
    longer_from = pieces - F.col("n") % pieces
    rows = rows.withColumn("edits", allowed_distance(F.col("n")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("number"))
    return rows.withColumns({
        "start": (number * small + F.greatest(F.lit(0), number - longer_from)).cast("int"),
        "size": (small + F.when(number >= longer_from, 1).otherwise(0)).cast("int"),
    })


def similar_words(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, distance) of all pairs within the allowed distance.

    ``vocabulary`` has distinct tokens, ``words`` distinct query words. Pairs are found by an
    equi-join on pieces that must be equal; the distance is computed for those only. Pieces and the places they may
    have moved to are rows, made from the lengths of the words: the plan is the same for any words.
    """
    own = with_pieces(words.select("word", F.length("word").alias("n")).where("n > 0"))
    right = own.select("word", "n", "number", F.expr("substring(word, start + 1, size)").alias("piece"))
    # Which lengths a token may be looked up as: a row per length of a word and of a token near it.
    lengths = words.select(F.length("word").alias("n")).where("n > 0").distinct().withColumn("edits", allowed_distance(F.col("n")))
    near = lengths.select("n", F.explode(F.expr("sequence(greatest(n - edits, 1), n + edits)")).alias("length"))
    tokens = vocabulary.select("token", F.length("token").alias("length")).join(near, "length")
    places = with_pieces(tokens).select(
        "token", "n", "number", "size", F.explode(F.expr("sequence(greatest(start - edits, 0), start + edits)")).alias("at"), "length"
    ).where("at + size <= length")
    left = places.select("token", "n", "number", F.expr("substring(token, at + 1, size)").alias("piece"))
    pairs = left.join(right, ["n", "number", "piece"]).select("token", "word").distinct()
    limit = allowed_distance(F.length("word"))
    return pairs.withColumn("distance", F.levenshtein("token", "word")).where(F.col("distance") <= limit)


def fuzzy_lookup(fields: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, distance, field): records whose fields hold every query word approximately.

    ``fields`` is a field index (id, field, value), ``queries`` has query_id and term. A word's
    distance is that of its best token in any field; a record's is the sum over the words.
    """
    asked = queries.select("query_id", F.array_distinct(field_tokens(F.col("term"))).alias("words"))
    asked = asked.select("query_id", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    tokens = fields.select("id", "field", F.explode(F.array_distinct(field_tokens(F.col("value")))).alias("token"))
    similar = similar_words(tokens.select("token").distinct(), asked.select("word").distinct())
    wanted = similar.join(asked, "word")
    pinned = pin_small(wanted)
    matched = tokens.join(wanted if pinned is None else F.broadcast(pinned), "token")
    per_word = matched.groupBy("query_id", "n_words", "id", "word").agg(
        F.min(F.struct("distance", "field")).alias("best")
    )
    hits = per_word.groupBy("query_id", "n_words", "id").agg(
        F.sum("best.distance").alias("distance"), F.min("best.field").alias("field"), F.count(F.lit(1)).alias("found")
    )
    return hits.where("found = n_words").select("query_id", "id", "distance", "field")
