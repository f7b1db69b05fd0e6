"""Searching an index: matching, scoring, filtering, ordering and paging of hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from .index import TextIndex
from .skew import HOT_ROWS, any_of, rank_in_group

# Below the bar of a top-k search, scores differ by more than rounding.
SLACK = 1e-6
# A search for the best hits sets its bar from the blocks up to this number.
BAR_BLOCKS = 1


@dataclass(frozen=True)
class Ranking:
    """Weights of the score; the defaults are those of published Okapi BM25."""

    term_similarity: float = 1.0
    page_length: float = 0.75
    term_saturation: float = 1.2
    term_frequency: float = 1.0
    diacritic_similarity: float = 0.8
    meta_weights: dict[str, float] = field(default_factory=dict)


def queries_from(spark: SparkSession, terms: list[str | None]) -> DataFrame:
    """Terms as a queries table, numbered from 1."""
    return spark.createDataFrame(
        [(i, t) for i, t in enumerate(terms, 1)], "query_id int, term string"
    )


def process_terms(queries: DataFrame, process: Callable[[Column], Column]) -> DataFrame:
    """Queries with a caller's function applied to the term before it is normalized."""
    return queries.withColumn("term", process(F.col("term")))


def process_results(rows: DataFrame, **columns: Callable[[Column], Column]) -> DataFrame:
    """Result rows with a caller's function applied to each named column."""
    return rows.withColumns({name: process(F.col(name)) for name, process in columns.items()})


def is_phrase(term: Column) -> Column:
    return term.rlike(r'(?s)^\s*".+"\s*$')


def normalize_queries(queries: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Queries with the term as compared, with and without accents, and the phrase flag."""
    return queries.select(
        "*",
        is_phrase(F.col("term")).alias("phrase"),
        T.normalize_exact(F.col("term"), kept).alias("term_exact"),
        T.normalize_term(F.col("term"), kept).alias("normalized"),
    )


def query_words(queries: DataFrame, distinct: bool = True, kept: list[str] | None = None) -> DataFrame:
    """Words per query: query_id, place, word, word_exact, n_words. Blank queries have none."""
    split = f"[{T.BLANKS}]+"
    normal = normalize_queries(queries, kept).where("normalized <> ''")
    pairs = F.arrays_zip(F.split("normalized", split).alias("word"), F.split("term_exact", split).alias("word_exact"))
    if distinct:
        pairs = F.array_distinct(pairs)
    words = normal.select("query_id", F.size(pairs).alias("n_words"), F.posexplode(pairs).alias("place", "pair"))
    return words.select("query_id", "n_words", "place", "pair.word", "pair.word_exact").where("word <> ''")


def match_terms(index: TextIndex, words: DataFrame, prefix: bool = True, exact_diacritics: bool = False) -> DataFrame:
    """The terms of the dictionary that match query words, each word by equality or as the beginning of a term.

    Adds term_id, part, doc_frequency, length_bonus = length of word / length of term, and same_accents. Beginnings meet
    in joins on the first one, two or three characters, as many as the word has; longer ones are compared behind it.
    """
    # Stored, a list of words has a known size: next to a few of them the dictionary is not shuffled.
    words = stored(words, "words")
    word_side, term_side = ("word_exact", "term_exact") if exact_diacritics else ("word", "term")
    terms = index.stored.terms.select("term", "term_exact", "term_id", "part", "doc_frequency")
    if not prefix:
        joined = terms.withColumn("__key", F.col(term_side)).join(words.withColumn("__key", F.col(word_side)), "__key")
    else:
        joined = None
        for n in (1, 2, 3):
            own = words.where(F.length(word_side) == n if n < 3 else F.length(word_side) >= n)
            begun = terms.withColumn("__key", F.substring(term_side, 1, n)).join(own.withColumn("__key", F.substring(word_side, 1, n)), "__key")
            begun = begun.where(F.col(term_side).startswith(F.col(word_side)))
            joined = begun if joined is None else joined.unionByName(begun)
    return joined.drop("__key").withColumn("length_bonus", F.length("word") / F.length("term")).withColumn(
        "same_accents", F.col("term_exact").startswith(F.col("word_exact"))
    )


def in_parts(table: DataFrame, found: DataFrame, blocks: bool = False) -> DataFrame:
    """``table`` cut to the folders that hold terms of ``found``: a list as long as there are folders, at most."""
    names = ["part", "block"] if blocks else ["part"]
    parts = found.select(*names).distinct().collect()
    if not blocks:
        return table.where(F.col("part").isin([row["part"] for row in parts]))
    held = {block: [row["part"] for row in parts if row["block"] == block] for block in {row["block"] for row in parts}}
    return table.where(any_of([(F.col("block") == block) & F.col("part").isin(own) for block, own in sorted(held.items())]))


def match_words(
    index: TextIndex, words: DataFrame, prefix: bool = True, exact_diacritics: bool = False, whole_phrases: bool = False
) -> DataFrame:
    """Postings that match query words: the dictionary says which terms they are, and only their folders are read.

    With ``whole_phrases``, words marked as ``quoted`` match whole terms only.
    """
    found = match_terms(index, words, prefix, exact_diacritics)
    if whole_phrases:
        found = found.where(~F.col("quoted") | (F.col("word_exact") == F.col("term_exact") if exact_diacritics else F.col("word") == F.col("term")))
    return postings_of(index, stored(found, "matched-terms"))


def postings_of(index: TextIndex, found: DataFrame) -> DataFrame:
    return in_parts(index.stored.postings, found).drop("part", "block").join(found.drop("part"), "term_id")


def score_words(index: TextIndex, matches: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """BM25 with its parts, one row per query, word and document."""
    # The places of words are not needed here: they join the hits that are shown.
    per_word = matches.groupBy("query_id", "word", "n_words", "doc_id").agg(
        F.sum("tf").alias("raw_tf"),
        F.sum(F.col("tf") * strength_of(ranking)).alias("weighted_term_frequency"),
        F.max("length_bonus").alias("length_bonus"),
        F.first("n_terms").alias("document_length"),
    )
    # Counting documents and scoring them both read these rows.
    per_word = stored(per_word, "word-matches")
    frequency = per_word.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("pages_containing_term"))
    return bm25(index, per_word.join(frequency, ["query_id", "word"]), ranking)


def strength_of(ranking: Ranking) -> Column:
    """What an occurrence of a matched term counts."""
    accents = F.when(F.col("same_accents"), F.lit(1.0)).otherwise(F.lit(ranking.diacritic_similarity))
    return F.col("weight") * F.pow("length_bonus", F.lit(ranking.term_similarity)) * accents


def corpus_size(index: TextIndex) -> Column:
    """How many documents there are and how long they are on average, as one value."""
    return index.stored.lengths.agg(
        F.struct(F.count(F.lit(1)).alias("total_pages"), F.avg("n_terms").alias("average_page_length"))
    ).scalar()


def bm25(index: TextIndex, rows: DataFrame, ranking: Ranking) -> DataFrame:
    rows = rows.withColumn("__corpus", corpus_size(index))
    rows = rows.select(
        "*", F.col("__corpus.total_pages").alias("total_pages"),
        F.col("__corpus.average_page_length").alias("average_page_length"),
    ).drop("__corpus")
    k1, b = F.lit(ranking.term_saturation), F.lit(ranking.page_length)
    df, tf = F.col("pages_containing_term"), F.col("weighted_term_frequency")
    length_part = 1 - b + b * F.col("document_length") / F.col("average_page_length")
    blend = F.lit(ranking.term_frequency)
    return (
        rows.withColumn("idf", F.log(1 + (F.col("total_pages") - df + 0.5) / (df + 0.5)))
        .withColumn("saturating_tf", tf * (k1 + 1) / (tf + k1 * length_part))
        .withColumn("blended_tf", blend * F.col("saturating_tf") + (1 - blend) * tf)
        .withColumn("score", F.col("idf") * F.col("blended_tf"))
    )


def combine_words(scored: DataFrame, match_all: bool = True) -> DataFrame:
    """Hits per query and document with their score. ``match_all`` keeps documents that hold every word of the query."""
    hits = scored.groupBy("query_id", "doc_id", "n_words").agg(
        # Rounded, so that copies of a text tie whatever order their parts were added in.
        F.round(F.sum("score"), 9).alias("score"),
        F.count(F.lit(1)).alias("words_found"),
    )
    return hits.where("words_found = n_words") if match_all else hits


def with_locations(hits: DataFrame, matches: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Hits with weighted_locations, the places of the words they matched: read for these hits alone."""
    spots = F.transform("positions", lambda at: F.struct(at.alias("location"), F.col("strength").alias("balanced_score")))
    placed = matches.select("query_id", "doc_id", strength_of(ranking).alias("strength"), "positions")
    placed = placed.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    located = placed.groupBy("query_id", "doc_id").agg(F.sort_array(F.flatten(F.collect_list(spots))).alias("weighted_locations"))
    return hits.join(located, ["query_id", "doc_id"], "left").withColumn(
        "weighted_locations", F.coalesce("weighted_locations", F.array().cast(located.schema["weighted_locations"].dataType))
    )


def search(
    index: TextIndex,
    queries: DataFrame,
    ranking: Ranking = Ranking(),
    prefix: bool = True,
    match_all: bool = True,
    exact_diacritics: bool = False,
    locations: bool = True,
) -> DataFrame:
    """Hits (query_id, doc_id, score, weighted_locations) of every query; without ``locations``, the first three alone.

    A quoted term hits documents in which its words follow each other, each matched whole. A blank term
    has no hits here; a null term is a filter-only search and hits every document with score zero.
    """
    words = query_words(queries.where("term is not null"))
    quoted = queries.where(is_phrase(F.col("term")))
    phrased = not quoted.isEmpty()
    if phrased:
        marks = quoted.select("query_id").distinct().withColumn("quoted", F.lit(True))
        words = words.join(marks, "query_id", "left").withColumn("quoted", F.coalesce("quoted", F.lit(False)))
    matches = match_words(index, words, prefix, exact_diacritics, whole_phrases=phrased)
    scored = score_words(index, matches, ranking)
    hits = combine_words(scored, match_all)
    if phrased:
        placed = query_words(quoted, distinct=False).select("query_id", "word", "word_exact", "place", F.col("n_words").alias("n_placed"))
        held = matches.where("quoted").select("query_id", "word", "word_exact", "doc_id", "positions").join(placed, ["query_id", "word", "word_exact"])
        runs = phrase_starts(held.withColumnRenamed("n_placed", "n_words")).select("query_id", "doc_id").distinct().withColumn("__run", F.lit(True))
        hits = hits.join(marks, "query_id", "left").join(runs, ["query_id", "doc_id"], "left").where("quoted IS NULL OR __run")
    hits = hits.select("query_id", "doc_id", "score")
    if ranking.meta_weights:
        hits = boost_by_meta(index, hits, words, scored, ranking.meta_weights)
    unworded = queries.where("term is null")
    if not unworded.isEmpty():
        # One short list: the numbers of the queries without a term.
        numbers = unworded.agg(F.collect_set("query_id")).scalar()
        every = index.docs.select("doc_id").withColumn("__numbers", numbers).select(
            F.explode("__numbers").alias("query_id"), "doc_id", F.lit(0.0).alias("score")
        )
        hits = hits.unionByName(every)
    return with_locations(hits, matches, ranking) if locations else hits


def boost_by_meta(
    index: TextIndex, hits: DataFrame, words: DataFrame, scored: DataFrame, weights: dict[str, float]
) -> DataFrame:
    """Raise scores of documents whose weighted meta fields hold query words.

    A field adds weight * (idf of the query words it holds / idf of all query words).
    """
    idf = scored.groupBy("query_id", "word").agg(F.max("idf").alias("idf"))
    totals = idf.groupBy("query_id").agg(F.sum("idf").alias("total_idf"))
    pairs = F.explode(F.map_filter("meta", lambda k, v: k.isin(list(weights)))).alias("field", "value")
    fields = index.docs.select("doc_id", pairs)
    split = T.split_words(F.col("value"))
    held = fields.select("doc_id", "field", F.explode(F.array_distinct(F.transform(split, lambda w: T.normalize_term(w)))).alias("word"))
    matched = held.join(idf, "word").groupBy("query_id", "doc_id", "field").agg(F.sum("idf").alias("matched_idf"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field"))
    boosts = matched.join(totals, "query_id").groupBy("query_id", "doc_id").agg(
        F.sum(weight * F.col("matched_idf") / F.col("total_idf")).alias("boost")
    )
    return hits.join(boosts, ["query_id", "doc_id"], "left").withColumn(
        "score", F.col("score") * (1 + F.coalesce("boost", F.lit(0.0)))
    ).drop("boost")


def filter_only_search(docs: DataFrame, wanted: dict[str, list[str]], mode: str = "all") -> DataFrame:
    """Every document that passes the filters, unscored."""
    return docs.where(passes(F.col("filters"), wanted_map(wanted), mode)).select("doc_id", F.lit(0.0).alias("score"))


def phrase_search(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, start) wherever the words of a quoted term follow each other."""
    quoted = query_words(queries.where(is_phrase(F.col("term"))), distinct=False)
    return phrase_starts(match_words(index, quoted, prefix=False))


def phrase_starts(matches: DataFrame) -> DataFrame:
    """(query_id, doc_id, start) from the ``positions`` of each word and its ``place`` in the phrase of ``n_words``."""
    placed = matches.select(
        "query_id", "n_words", "doc_id", "place", F.explode("positions").alias("position")
    ).withColumn("start", F.col("position") - F.col("place"))
    # Each word of the phrase stands at most once at its place behind a start.
    runs = placed.groupBy("query_id", "n_words", "doc_id", "start").agg(F.count(F.lit(1)).alias("n"))
    return runs.where("n = n_words").select("query_id", "doc_id", "start")


# ---- filters ------------------------------------------------------------------------------


def parse_filter_pills(pills: list[str]) -> dict[str, list[str]]:
    """``name:value`` choices as a filter request; the first colon splits."""
    wanted: dict[str, list[str]] = {}
    for pill in pills:
        name, colon, value = pill.partition(":")
        if colon:
            wanted.setdefault(name, []).append(value)
    return wanted


def wanted_map(wanted: dict[str, str | list[str]]) -> Column:
    """A filter request as a map column; a single value counts as a list of one."""
    pairs = [
        part
        for name, values in wanted.items()
        for part in (F.lit(name), F.array(*[F.lit(v) for v in ([values] if isinstance(values, str) else values)]))
    ]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,array<string>>")


def passes(filters: Column, wanted: Column, mode: str = "all") -> Column:
    """Whether a document's filters satisfy every name of a request, with all or any of its values."""
    def satisfied(entry: Column) -> Column:
        own = F.coalesce(F.element_at(filters, entry["key"]), F.array().cast("array<string>"))
        if mode == "all":
            return F.size(F.array_except(entry["value"], own)) == 0
        return (F.size(entry["value"]) == 0) | F.arrays_overlap(entry["value"], own)

    return F.forall(F.map_entries(wanted), satisfied)


def apply_filters(hits: DataFrame, docs: DataFrame, wanted: Column, mode: str = "all") -> DataFrame:
    """Hits with their documents' filters and whether they pass; nothing is dropped yet."""
    joined = hits.join(docs.select("doc_id", "filters"), "doc_id")
    return joined.withColumn("passes", passes(F.col("filters"), wanted, mode))


def with_category(catalog: DataFrame, category: str) -> DataFrame:
    return catalog.where(F.array_contains("categories", category))


def distinct_categories(catalog: DataFrame) -> DataFrame:
    """The categories in use, blanks left out, one row each."""
    return catalog.select(F.explode("categories").alias("category")).where("trim(category) <> ''").distinct()


# ---- order and pages ----------------------------------------------------------------------


def sort_direction(sort: dict[str, str]) -> tuple[str, bool] | None:
    """The one sort key that counts and whether it ascends; None means by score."""
    for key, direction in sort.items():
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown direction {direction!r} for sort key {key!r}: use asc or desc")
        return key, direction == "asc"
    return None


def sort_hits(hits: DataFrame, docs: DataFrame, sort: dict[str, str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``rank`` within each query, by a sort key of the documents or by score."""
    chosen = sort_direction(sort or {})
    if chosen is None:
        ordered = hits.withColumn("__by", F.col("score"))
        return rank_in_group(
            ordered, ["query_id"], [("__by", False), ("doc_id", True)], "rank", hot_rows
        ).drop("__by")
    key, ascending = chosen
    keys = docs.select("doc_id", F.coalesce(F.element_at("sort", key), F.lit("")).alias("sort_value"))
    return rank_in_group(
        hits.join(keys, "doc_id"), ["query_id"], [("sort_value", ascending), ("doc_id", True)], "rank", hot_rows
    )


def search_requests(index: TextIndex, requests: DataFrame, ranking: Ranking = Ranking(), mode: str = "all", hot_rows: int = HOT_ROWS, **options) -> DataFrame:
    """(query_id, doc_id, score, rank): the hits of each request that pass its filters, in the order it asks for.

    ``requests`` has query_id, term, filters (a map of wanted values by name, or null), sort (a sort key of the documents,
    or null for the score) and descending. Ties go to smaller doc_ids. All requests are searched, filtered and ranked
    together; ``options`` are those of ``search``.
    """
    hits = search(index, requests.select("query_id", "term"), ranking, locations=False, **options)
    none = F.create_map().cast("map<string,array<string>>")
    asked = requests.select(
        "query_id", F.coalesce("filters", none).alias("__wanted"), F.col("sort").alias("__key"), F.coalesce("descending", F.lit(False)).alias("__down")
    )
    rows = hits.join(asked, "query_id").join(index.docs.select("doc_id", "filters", "sort"), "doc_id")
    rows = rows.where(passes(F.col("filters"), F.col("__wanted"), mode))
    value = F.coalesce(F.try_element_at("sort", "__key"), F.lit(""))
    # A request sorts in one direction: in the column of the other one all its hits are alike.
    by_key = F.col("__key").isNotNull()
    ordered = rows.select(
        "query_id", "doc_id", "score",
        F.when(by_key & ~F.col("__down"), value).otherwise("").alias("__up"), F.when(by_key & F.col("__down"), value).otherwise("").alias("__low"),
        F.when(by_key, F.lit(0.0)).otherwise(F.col("score")).alias("__score"),
    )
    order = [("__up", True), ("__low", False), ("__score", False), ("doc_id", True)]
    return rank_in_group(ordered, ["query_id"], order, "rank", hot_rows).select("query_id", "doc_id", "score", "rank")


def top_hits(hits: DataFrame, limit: int, by: str = "score", ascending: bool = False) -> DataFrame:
    """The first ``limit`` hits per query with their rank. Tasks keep only their own best rows."""
    order = F.asc(by) if ascending else F.desc(by)
    window = Window.partitionBy("query_id").orderBy(order, "doc_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def page_hits(hits: DataFrame, page: int = 1, page_size: int = 5, max_results: int | None = None) -> DataFrame:
    """Hits shown once ``page`` pages have been asked for: each "more" adds a page."""
    shown = page * page_size
    return top_hits(hits, shown if max_results is None else min(shown, max_results))


def bounded_blocks(index: TextIndex, words: DataFrame, found: DataFrame, ranking: Ranking) -> DataFrame:
    """The blocks of the terms ``found`` with ``bound``, the most that their word can add to a score by a document in them,
    and ``others``, the most that the query's other words can.

    A word may match several terms: a document in this block may hold all of them as often as any document does.
    """
    blocks = in_parts(index.stored.blocks, found).select("term_id", "part", "block", "n", "most", "shortest")
    matched = blocks.join(found.drop("part"), "term_id").withColumn("weight", F.lit(1.0))
    matched = matched.withColumn("__strength", F.col("most") * strength_of(ranking))
    per_term = matched.groupBy("query_id", "word", "term_id").agg(F.max("__strength").alias("__top"))
    per_word = per_term.groupBy("query_id", "word").agg(F.sum("__top").alias("__sum"))
    rows = matched.join(per_term, ["query_id", "word", "term_id"]).join(per_word, ["query_id", "word"])
    rows = rows.withColumn("weighted_term_frequency", F.col("__sum") - F.col("__top") + F.col("__strength"))
    rows = rows.withColumnRenamed("shortest", "document_length").join(words, ["query_id", "word"])
    bounded = bm25(index, rows, ranking).withColumnRenamed("score", "bound")
    tops = bounded.groupBy("query_id", "word").agg(F.max("bound").alias("__top"))
    total = tops.groupBy("query_id").agg(F.sum("__top").alias("__total"))
    return bounded.select("query_id", "word", "n_words", "term_id", "part", "block", "n", "bound").join(tops, ["query_id", "word"]).join(
        total, "query_id"
    ).withColumn("others", F.col("__total") - F.col("__top")).drop("__top", "__total")


def best_hits(
    index: TextIndex, queries: DataFrame, limit: int, ranking: Ranking = Ranking(), prefix: bool = True, skipped: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``limit`` best hits that ``search`` has for each query, by bounds of blocks.

    A first pass scores what the first blocks of the words' terms hold; the ``limit``-th of those scores is the bar. A block
    is read in the second pass only if a document in it can reach the bar with all other words at their most. Quoted
    and missing terms take the whole way. ``skipped`` is shown the bounded blocks with the bar (``read``: whether it is).
    """
    plain = queries.where(F.col("term").isNotNull() & ~is_phrase(F.col("term")))
    found = stored(match_terms(index, query_words(plain), prefix), "matched-terms")
    # How many documents hold a word: of one term, the dictionary knows; of several, their document numbers are counted, and so
    # they are where documents have been removed.
    several = found.groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"), F.max("doc_frequency").alias("df"))
    many = found.join(several.where(F.lit(not index.stored.counted) | (F.col("n") > 1)).select("query_id", "word"), ["query_id", "word"], "left_semi")
    counted = postings_of(index, many.select("query_id", "word", "term_id", "part")).groupBy("query_id", "word").agg(F.countDistinct("doc_id").alias("pages"))
    words = several.join(counted, ["query_id", "word"], "left").select("query_id", "word", F.coalesce("pages", "df").alias("pages_containing_term"))
    words = stored(words, "word-frequencies")
    blocks = stored(bounded_blocks(index, words, found, ranking), "bounds")

    def scored(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select("query_id", "word", "term_id", "part", "block").distinct()
        rows = in_parts(index.stored.postings, chosen, blocks=True).select("term_id", "block", "doc_id", "tf", "weight", "n_terms")
        matched = rows.join(chosen.drop("part"), ["term_id", "block"]).join(found.drop("part"), ["query_id", "word", "term_id"])
        per_word = matched.groupBy("query_id", "word", "n_words", "doc_id").agg(
            F.sum(F.col("tf") * strength_of(ranking)).alias("weighted_term_frequency"), F.first("n_terms").alias("document_length")
        )
        return combine_words(bm25(index, per_word.join(words, ["query_id", "word"]), ranking)).select("query_id", "doc_id", "score")

    # What the first blocks hold of a document is the least it can score.
    first = top_hits(scored(blocks.where(F.col("block") <= BAR_BLOCKS)), limit).where(F.col("rank") == limit)
    bars = first.select("query_id", (F.col("score") - SLACK).alias("bar"))
    held = stored(blocks.join(bars, "query_id", "left").withColumn("read", F.col("bar").isNull() | (F.col("bound") + F.col("others") >= F.col("bar"))), "barred")
    if skipped is not None:
        skipped(held)
    hits = scored(held.where("read"))
    rest = queries.where(F.col("term").isNull() | is_phrase(F.col("term")))
    if not rest.isEmpty():
        hits = hits.unionByName(search(index, rest, ranking, prefix, locations=False))
    return top_hits(hits, limit)


def full_text_topk(index: TextIndex, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Text, address and score of the best documents; wide columns join only after the cut."""
    return best_hits(index, queries, limit).join(index.docs.select("doc_id", "url", F.col("content").alias("text")), "doc_id")


# ---- around a search ----------------------------------------------------------------------


def merge_indexes(parts: list[tuple[DataFrame, float, dict[str, str]]]) -> DataFrame:
    """Hits of several indexes as one list: scores weighted, each index's own filter values added.

    Every part has hits (query_id, doc_id, score, filters), a weight and constant filters.
    """
    merged = None
    for number, (hits, weight, constants) in enumerate(parts):
        filters = F.col("filters")
        if constants:
            added = wanted_map(constants)
            filters = F.map_zip_with(
                filters, added,
                lambda k, own, more: F.concat(
                    F.coalesce(own, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))
                ),
            )
        part = hits.withColumn("score", F.col("score") * weight).withColumn("filters", filters)
        part = part.withColumn("index_number", F.lit(number))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def route_language(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The index language for each requested one: itself, its primary part, else the largest."""
    largest = entries.agg(F.max_by("lang", F.struct("page_count", F.col("lang")))).scalar()
    exact = entries.select(F.col("lang").alias("requested"), F.col("lang").alias("__exact"))
    primary = entries.select(F.col("lang").alias("__main"), F.col("lang").alias("__primary"))
    found = (
        requests.join(exact, "requested", "left")
        .withColumn("__main", F.split("requested", "-")[0])
        .join(primary, "__main", "left")
        .withColumn("__largest", largest)
    )
    routed = F.coalesce("__exact", "__primary", "__largest")
    missing = F.raise_error(F.lit("no language indexes found")).cast("string")
    return found.withColumn("lang", F.when(routed.isNull(), missing).otherwise(routed)).drop(
        "__exact", "__primary", "__main", "__largest"
    )


def selected_only(hits: DataFrame, selection: DataFrame, on: str = "doc_id") -> DataFrame:
    return hits.join(selection.select(on), on, "left_semi")


def app_search(
    catalog: DataFrame, index: TextIndex | None, term: str, selection: DataFrame | None = None
) -> DataFrame:
    """Catalog rows for a term as the application shows them.

    No index or a blank term shows everything; a given selection narrows the rows to itself.
    """
    if index is None:
        return catalog
    rows = catalog
    if term.strip() != "":
        queries = queries_from(catalog.sparkSession, [term.strip()])
        found = search(index, queries).select(F.col("doc_id").alias("id"))
        rows = catalog.join(found, "id", "left_semi")
    return rows if selection is None else selected_only(rows, selection, "id")


def result_summary(counts: DataFrame) -> DataFrame:
    """Wording for (query_id, term, n): how many results, and for which term if there is one."""
    n = F.col("n").cast("string")
    noun = F.when(F.col("n") == 1, " result").otherwise(" results")
    with_term = F.concat(n, noun, F.lit(" for "), F.col("term"))
    blank = F.coalesce(F.trim("term"), F.lit("")) == ""
    return counts.withColumn("summary", F.when(blank, F.concat(n, noun)).otherwise(with_term))


def count_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits per query, zero included."""
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(counted, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
