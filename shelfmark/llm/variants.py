"""Spelling variants by asymmetric chunks.

Two words are near if one inserted, deleted or replaced letter turns one into the other. A word is cut into disjoint
chunks: one edit spoils one of them, and all others keep their places, shifted by at most one behind the edit. So one
word of a pair names itself by its chunks, the other, as long or one letter longer, by its positional grams of the same
sizes, and both meet in a key. Two chunks would put all words with a common beginning into one group, so each half is
cut once more before words are joined; groups that are still large are cut again, until a single letter is left open and
all pairs of a group are near.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, slices
from shelfmark.session import stored

# Fixed: letters of a word; A-Z are lower-cased before.
LETTERS = r"[a-zÀ-ÿ]"
# A word has this many letters and occurs this often, at least.
LEAST_LETTERS, LEAST_COUNT = 6, 5
# A form is this many times as frequent as the word, at least.
RATIO = 5
# One of SPOILED words, by a hash of document and word, lacks a letter.
SPOILED = 199
# Pairs that a key's group may have before it is cut again; different words kept by a task before it sends them on.
GROUP_PAIRS, MOST_KEPT = 2_000, 300_000


def spoiled(word: str, name: bytes) -> str:
    """The word as it stands in the document ``name``: without its letter h % length if SPOILED divides the crc32 h of both."""
    h = zlib.crc32(b"%b:%b" % (name, word.encode()))
    if h % SPOILED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(``word``, ``n``): the words of all texts with at least ``letters`` letters and ``least`` occurrences."""
    # A longest run with fewer letters yields no word that counts, whether it loses one or not.
    run_of = regex.compile(f"{LETTERS}{{{letters},}}")

    def sent(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for batch in slices(batches, "text"):
            for name, value in zip(as_bytes(batch, "key"), as_bytes(batch, "text")):
                for word, n in Counter(run_of.findall((value or b"").lower().decode())).items():
                    word = spoiled(word, name)
                    if len(word) >= letters:
                        found[word] += n
            if len(found) > MOST_KEPT:
                yield sent(found)
                found.clear()
        yield sent(found)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its open letters kept, and with the second."""
    middle = F.expr("(low + high) DIV 2").cast("int")
    halves = F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high")))
    return rows.withColumn("half", F.explode(halves)).select("word", "n", "longer", "size", F.col("half.low").alias("low"), F.col("half.high").alias("high"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: the letters before and behind the open ones, ``low`` to ``high`` of the ``size`` letters of the shorter word."""
    return rows.withColumn("key", F.concat(F.expr("substring(word, 1, low)"), F.lit("\0"), F.expr("substring(word, high + longer + 1)")))


def near(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(``a``, ``n_a``, ``b``, ``n_b``): all pairs of ``words`` (``word`` once, ``n``) that differ by exactly one edit; ``b`` is longer, or later."""
    own = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).withColumn("size", F.char_length("word") - F.col("longer"))
    whole = own.where("size > 0").withColumn("low", F.lit(0)).withColumn("high", F.col("size"))
    on = ["size", "low", "high", "key"]
    found = None
    rows = _keyed(_cut(_cut(whole))).distinct()
    while True:
        rows = stored(rows, "chunks")
        shorter, longer = F.sum(1 - F.col("longer")), F.sum("longer")
        groups = rows.groupBy(*on).agg(shorter.alias("s"), longer.alias("l")).withColumn("pairs", F.expr("s * (s - 1) / 2 + s * l")).where("pairs > 0")
        # Pairs of words that differ in one open letter are near: there are no more of them than results.
        wide = F.col("high") - F.col("low") > 1
        groups = stored(groups.select(*on, ((F.col("pairs") > group_pairs) & wide).alias("large")), "groups")
        meet = rows.join(groups.where("NOT large").select(*on), on, "left_semi")
        a = meet.where("longer = 0").select(*on, F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = meet.select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        pairs = a.join(b, on).where((F.col("longer") == 1) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        found = pairs if found is None else found.union(pairs)
        large = groups.where("large")
        if large.isEmpty():
            # A pair may keep several chunks.
            return found.distinct()
        rows = _keyed(_cut(rows.join(large.select(*on), on, "left_semi"))).distinct()


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """(``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``) for every word of the texts that ``counts``.

    ``form`` is the word's most frequent near word, of equal ones the smallest, if it is ``ratio`` times as frequent; else
    null. ``root`` is where following forms ends. Rows that share a ``key``, or have none, count each; null, empty and
    blank texts hold no words. Other columns are not looked at. An empty table gives an empty result. Texts are read
    whole; a task keeps a bounded number of different words and one slice of texts.
    """
    words = stored(counts(docs, key, text), "words")
    pairs = stored(near(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "n_b", "a", "n_a"))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other")))
    linked = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.m") >= ratio * F.col("n")
    linked = stored(linked.select("word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")), "linked")
    # Every step multiplies the count, so chains are short; each round doubles the steps that are followed.
    steps = stored(linked.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(max(most, 2), ratio) + 1))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "steps")
    joined = words.join(linked, "word", "left").join(steps, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
