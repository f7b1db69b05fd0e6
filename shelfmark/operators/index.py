"""Search indexes as plain tables: documents, postings, term statistics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import names as N
from ..functions import text as T
from ..session import scratch_path, stored
from .skew import HOT_ROWS, hot_keys, rank_in_group

# Postings in the first block of a term; each further block ends at so many times the place where the one before ends.
FIRST_BLOCK, BLOCK_GROWTH = 128, 8
# Ranges of terms, at least: a search reads the files of the ranges that hold its terms.
LEAST_PARTS = 32
# Words of the documents per range: a task sorts the postings of one, in memory.
PART_WORDS = 1_500_000
# Bytes of the texts whose words are grouped at once.
SLICE_BYTES = 1 << 22
# What the first posting of a block carries of it.
KNOWN = ["__n", "__most", "__shortest", "__tf"]
# Rows of a batch that goes back to Spark.
ROWS_OUT = 1 << 16
# Words of the documents that the bounds of the ranges are taken from; a posting weighs as much as so many words.
BOUND_WORDS, POSTING_WORDS = 1_000_000, 20


@dataclass(frozen=True)
class TextIndex:
    """Postings (lang, term, term_exact, doc_id, tf, positions, weight), documents, their lengths.

    Lengths (lang, doc_id, n_terms) are a narrow table of their own; postings may carry ``n_terms``, too. A stored index has ``terms``, its dictionary, too,
    and ``blocks``: there postings name their term by ``term_id`` and carry the length of their document. ``counted`` says
    that the dictionary knows how many documents of the index hold a term. ``source`` are the documents of which each row
    is one, if the postings are just their words, with the characters ``kept``: they can then be grouped for a shuffle where they are read.
    """

    postings: DataFrame
    docs: DataFrame
    lengths: DataFrame
    terms: DataFrame | None = None
    blocks: DataFrame | None = None
    counted: bool = True
    source: DataFrame | None = None
    kept: list[str] | None = None

    def in_language(self, lang: str) -> TextIndex:
        tables = {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}
        return replace(self, **{name: table.where(F.col("lang") == lang) for name, table in tables.items()})

    @cached_property
    def stored(self) -> TextIndex:
        """This index as tables: itself, or written once to the shared folder on the first search."""
        if self.terms is not None:
            return self
        path = scratch_path(self.docs.sparkSession, "index")
        write_index(self, path)
        return read_index(self.docs.sparkSession, path)


def index_documents(catalog: DataFrame) -> DataFrame:
    """Catalog records as documents: labels are the content, the rest is kept as meta and sort keys."""
    path = F.col("path")
    related = L.related_tags(path)
    day = N.created_day(F.col("created"))
    return catalog.select(
        F.col("id").alias("doc_id"),
        F.lit("en").alias("lang"),
        path.alias("url"),
        L.join_labels(F.col("categories"), F.col("tags"), related).alias("content"),
        F.create_map(
            F.lit("id"), F.col("id"),
            F.lit("size"), F.col("size").cast("string"),
            F.lit("filename"), F.col("filename"),
            F.lit("fileBaseName"), N.base_name(path),
            F.lit("path"), path,
            F.lit("created"), day,
        ).alias("meta"),
        F.create_map(F.lit("created"), day, F.lit("filename"), F.col("filename")).alias("sort"),
    )


def full_text_documents(catalog: DataFrame) -> DataFrame:
    """Catalog records as rows of the full-text table: one deduplicated label text each."""
    path = F.col("path")
    labels = L.distinct_labels(F.col("filename"), F.col("categories"), F.col("tags"), L.related_tags(path))
    return catalog.select(
        "id", path.alias("url"), labels.alias("text"), "filename", F.col("size").cast("string").alias("size"), "path",
        F.to_date("created").alias("created"), "categories", N.base_name(path).alias("file_base_name"),
    )


def field_index(catalog: DataFrame) -> DataFrame:
    """(id, field, value, n_tokens) for the fields fuzzy lookup compares: address and labels."""
    path = F.col("path")
    content = L.join_labels(F.col("categories"), F.col("tags"), L.related_tags(path))
    wide = catalog.select("id", path.alias("url"), content.alias("content"))
    tall = wide.unpivot("id", ["url", "content"], "field", "value")
    return tall.withColumn("n_tokens", F.size(field_tokens(F.col("value"))).cast("bigint"))


def field_tokens(value: Column) -> Column:
    """Lower-case letter and digit runs of a field."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"([\p{L}\p{N}]+)"), 1)


def document_terms(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """One row per word: doc_id, lang, position, term_exact, term. Words without substance are left out.

    Texts are normalized as a whole, which is far cheaper than word by word. Dropped characters
    leave a stand-in behind, so that a word they make up still counts as a position.
    """
    content = F.col("content")
    texts = docs.select(
        "doc_id", "lang", content.rlike(r"[^\x00-\x7F]").alias("accented"),
        F.lower(T.strip_punctuation(content, kept, T.STAND_IN)).alias("exact"),
    )
    folded = T.decompose(F.col("exact"), T.STAND_IN)
    texts = texts.select("doc_id", "lang", "exact", F.when(F.col("accented"), folded).alias("folded"))
    exact_words, folded_words = T.split_words(F.col("exact")), T.split_words(F.col("folded"))
    pairs = F.arrays_zip(exact_words.alias("exact"), F.coalesce(folded_words, exact_words).alias("folded"))
    words = texts.select("doc_id", "lang", F.posexplode(pairs).alias("position", "word"))

    def clean(word: Column) -> Column:
        bare = F.replace(word, F.lit(T.STAND_IN), F.lit(""))
        # Blanks inside a word occur only where another character delimits words.
        return F.when(bare.rlike(f"[{T.BLANKS}]"), T.merge_blanks(bare)).otherwise(bare)

    pair = F.struct(clean(F.col("word.exact")).alias("term_exact"), clean(F.col("word.folded")).alias("term"))
    # A generator of one row: filters on a term stop above it instead of repeating its computation.
    return words.select("doc_id", "lang", "position", F.inline(F.array(pair))).where("term <> ''")


def postings_by_row(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` and spelling of a term: doc_id, lang, n_terms, term, term_exact, tf, positions.

    A row's words are grouped where the row is read, so nothing is shuffled, and different words of many texts are
    normalized once. Words are those of ``document_terms``.
    """
    def run(batches):
        spellings = T.Spellings(kept)
        for batch in batches:
            yield from grouped_words(batch, spellings)

    kind, lang = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang"))
    schema = f"doc_id {kind}, lang {lang}, n_terms bigint, term string, term_exact string, tf bigint, positions array<int>"
    return _split(docs, kept).mapInArrow(run, schema)


def postings_by_range(docs: DataFrame, bounds: list[tuple[bytes, bytes, bytes]], kept: list[str] | None = None) -> DataFrame:
    """The rows of ``postings_by_row`` that have a language and a doc_id, as lists ``postings`` per ``part``, lang, term and term_exact.

    ``part`` is the range between ``bounds`` (lang, term, term_exact) that a term falls into. A task makes one list per
    term of 4 MB of text.
    """
    def run(batches):
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), opened(batch)):
                columns = [pa.array(np.full(held.num_rows, part, np.int32)), *held.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["part", *held.schema.names])

    kind, lang = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang"))
    posting = f"struct<doc_id:{kind},n_terms:bigint,tf:bigint,positions:array<int>>"
    return runs_by_range(docs, bounds, kept).mapInArrow(run, f"part int, lang {lang}, term string, term_exact string, postings array<{posting}>")


def runs_by_range(
    docs: DataFrame, bounds: list[tuple[bytes, bytes, bytes]], kept: list[str] | None = None, without: list[tuple[bytes, bytes, bytes]] | None = None
) -> DataFrame:
    """The lists of ``postings_by_range``, those of a ``part`` and a task's 4 MB of text together as one Arrow stream ``run``.

    So a frequent term is shuffled as few lists, and no posting is a row of its own. Terms of ``without`` (lang, term,
    term_exact) are left out.
    """
    def run(batches):
        spellings, left_out = T.Spellings(kept), set(without or [])
        for batch in batches:
            yield from packed_words(batch, spellings, bounds, left_out)

    placed = _split(docs, kept).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    return placed.mapInArrow(run, "part int, run binary")


def _split(docs: DataFrame, kept: list[str] | None) -> DataFrame:
    """doc_id, lang and the ``text`` of each row; of texts that are not settled, n_terms and the ``words`` instead."""
    content = F.col("content")
    settled = F.coalesce(content.rlike(T.SETTLED), F.lit(False))
    texts = docs.select(
        "doc_id", "lang", F.when(settled, content).alias("text"), F.when(~settled, T.count_terms(content).cast("bigint")).alias("n_terms"),
        F.when(~settled, F.lower(T.strip_punctuation(content, kept, T.STAND_IN))).alias("exact"),
    )
    return texts.select("doc_id", "lang", "text", "n_terms", T.split_words(F.col("exact")).alias("words"))


def _word_slices(batch: pa.RecordBatch, most_bytes: int, spellings: T.Spellings) -> Iterator[tuple]:
    """In slices of texts of about ``most_bytes``: (row, code, position, n_terms, exact, term) of the words in order, n_terms per row of the batch.

    ``code`` is the place of the word's spelling in ``exact`` and ``term``. Words without substance are left out, but they
    have positions.
    """
    settled = pc.is_valid(batch.column("text")).to_numpy(zero_copy_only=False)
    n_terms = pc.fill_null(batch.column("n_terms"), 0).to_numpy(zero_copy_only=False).copy()
    for kind, column, width in ((True, "text", 1), (False, "words", 8)):
        rows = np.flatnonzero(settled == kind)
        values = batch.column(column).take(pa.array(rows))
        size = pc.binary_length(values) if kind else pc.fill_null(pc.list_value_length(values), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64) * width)
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most_bytes, "right")))
            lists = values.slice(first, last - first)
            # Blanks before the first word end an empty one, as in the source's split.
            lists = pc.ascii_split_whitespace(lists) if kind else lists
            held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code, exact, term, solid = spellings.forms(lists.flatten(), kind)
            place = np.repeat(np.arange(first, last), held)
            position = np.arange(len(place)) - np.repeat(np.cumsum(held) - held, held)
            if kind:
                # What the regular expression of ``count_terms`` finds in a settled text.
                n_terms[rows[first:last]] = np.bincount(place[solid[code]] - first, minlength=last - first)
            some = pc.not_equal(term, "").to_numpy(zero_copy_only=False)[code]
            yield rows[place[some]], code[some], position[some], n_terms, exact, term
            first = last


def _in_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by whole numbers from 0 on, the first key foremost; rows with equal keys stay in theirs."""
    n = len(keys[0])
    widths = [int(key.max()).bit_length() if n else 0 for key in keys]
    place = max(1, n.bit_length())
    if sum(widths) + place > 62:
        if len(keys) == 1:
            return np.argsort(keys[0], kind="stable")
        later = _in_order(*keys[1:])
        return later[_in_order(keys[0][later])]
    packed = np.zeros(n, np.int64)
    for key, width in zip(keys, widths):
        packed = (packed << width) | key
    packed = (packed << place) | np.arange(n)
    packed.sort()
    return packed & ((1 << place) - 1)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    changes = [key[1:] != key[:-1] for key in keys]
    return np.flatnonzero(np.r_[True, np.logical_or.reduce(changes)])


def _runs(row: np.ndarray, code: np.ndarray, position: np.ndarray) -> tuple:
    """(row, code, tf, places) per row and spelling, from words in order of spelling and row."""
    starts = _starts(row, code)
    tf = np.diff(np.r_[starts, len(row)])
    places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(position, pa.int32()))
    return row[starts], code[starts], pa.array(tf, pa.int64()), places


def grouped_words(batch: pa.RecordBatch, spellings: T.Spellings, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``postings_by_row`` for rows of ``_split``, in slices of texts of about ``most_bytes``."""
    for row, code, position, n_terms, exact, term in _word_slices(batch, most_bytes, spellings):
        # Words are in order of rows and positions: both stay in theirs.
        order = _in_order(code)
        row, code, tf, places = _runs(row[order], code[order], position[order])
        own = batch.select(["doc_id", "lang"]).take(pa.array(row))
        code = pa.array(code)
        columns = [*own.columns, pa.array(n_terms[row], pa.int64()), term.take(code), exact.take(code), tf, places]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_terms", "term", "term_exact", "tf", "positions"])


def packed_words(
    batch: pa.RecordBatch, spellings: T.Spellings, bounds: list[tuple[bytes, bytes, bytes]], without: set[tuple[bytes, bytes, bytes]], most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``runs_by_range`` for rows of ``_split``, in slices of texts of about ``most_bytes``."""
    coded = batch.column("lang").dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    for row, code, position, n_terms, exact, term in _word_slices(batch, most_bytes, spellings):
        order = _in_order(number[row], code)
        row, code, position = row[order], code[order], position[order]
        starts = _starts(number[row], code)
        names = [coded.dictionary.take(pa.array(number[row[starts]])), term.take(pa.array(code[starts])), exact.take(pa.array(code[starts]))]
        keys = zip(*(column.cast(pa.binary()).to_pylist() for column in names))
        part = np.array([-1 if key in without else bisect_right(bounds, key) for key in keys], np.int64)
        # Lists by range, each as it stands.
        chosen = _in_order(part + 1)
        chosen = chosen[part[chosen] >= 0]
        if not len(chosen):
            continue
        size = np.diff(np.r_[starts, len(row)])[chosen]
        moved = np.arange(size.sum()) + np.repeat(starts[chosen] - np.cumsum(size) + size, size)
        row, code, position, part = row[moved], code[moved], position[moved], part[chosen]
        row, code, tf, places = _runs(row, code, position)
        held = pa.StructArray.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(n_terms[row], pa.int64()), tf, places], names=["doc_id", "n_terms", "tf", "positions"]
        )
        starts = _starts(number[row], code)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), held)
        columns = [name.take(pa.array(chosen)) for name in names]
        all_parts = pa.RecordBatch.from_arrays([*columns, lists], names=["lang", "term", "term_exact", "postings"])
        edges = np.r_[_starts(part), len(part)]
        runs = [_closed(all_parts.slice(a, b - a)) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(runs, pa.binary())], names=["part", "run"])


def _closed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The lists of each ``run``."""
    for run in batch.column("run"):
        with pa.ipc.open_stream(run.as_buffer()) as reader:
            yield from reader


def _ranks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Place of each value among the different ones in order, bytes by bytes where they are strings, and those."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def ranked_range(runs: list[pa.RecordBatch], part: int, average: float | None) -> Iterator[pa.RecordBatch]:
    """The postings of one range as they are stored, from its lists: in order of language, block, term and document.

    ``term_id`` is the range and the place of the term's first posting in it, by order of terms and impact. The first
    posting of a block carries the names of its term and what is known of the block, the others nulls.
    """
    table = pa.Table.from_batches(runs).combine_chunks()
    (by_lang, langs), (by_term, terms), (by_exact, exacts) = (_ranks(table.column(c).combine_chunks()) for c in ("lang", "term", "term_exact"))
    keys, group = np.unique((by_lang * len(terms) + by_term) * len(exacts) + by_exact, return_inverse=True)
    lists = table.column("postings").combine_chunks()
    group = np.repeat(group, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ids, lengths, counts, positions = lists.flatten().flatten()
    doc, _ = _ranks(ids)
    n_terms, tf = lengths.to_numpy(zero_copy_only=False), counts.to_numpy(zero_copy_only=False)
    strength = tf.astype(np.float64)
    impact = strength / (strength + 1.2 * (0.25 + 0.75 * n_terms / average))
    # Places of the different impacts, the highest first.
    _, weaker = np.unique(-impact, return_inverse=True)
    order = _in_order(group, weaker, doc)
    first = np.cumsum(np.bincount(group, minlength=len(keys))) - np.bincount(group, minlength=len(keys))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place -= first[group]
    limits = FIRST_BLOCK * BLOCK_GROWTH ** np.arange(12)
    block = np.searchsorted(limits, place, "right")
    lang = keys // (len(terms) * len(exacts))
    order = _in_order(lang[group], block, group, doc)
    group, block, tf, n_terms, strength = group[order], block[order], tf[order], n_terms[order], strength[order]
    heads = _starts(block, group)
    mark = np.full(len(order), -1)
    mark[heads] = np.arange(len(heads))
    mark = pa.array(mark, mask=mark < 0)
    key = keys[group[heads]]
    size = np.diff(np.r_[heads, len(order)])
    known = [
        terms.take(pa.array(key // len(exacts) % len(terms))), exacts.take(pa.array(key % len(exacts))), pa.array(size), pa.array(np.maximum.reduceat(strength, heads)),
        pa.array(np.minimum.reduceat(n_terms, heads)), pa.array(np.add.reduceat(tf, heads)),
    ]
    names = ["lang", "part", "term_id", "block", "doc_id", "n_terms", "tf", "positions", "term", "term_exact", "__n", "__most", "__shortest", "__tf"]
    for at in range(0, len(order), ROWS_OUT):
        some = slice(at, at + ROWS_OUT)
        take, of = pa.array(order[some]), mark.slice(at, ROWS_OUT)
        columns = [
            langs.take(pa.array(lang[group[some]])), pa.array(np.full(len(take), part, np.int32)), pa.array((part << 33) + first[group[some]]),
            pa.array(block[some], pa.int32()), ids.take(take), pa.array(n_terms[some]), pa.array(tf[some]), positions.take(take), *[c.take(of) for c in known],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def ranges_in_order(runs: DataFrame, kind: str, average: float | None) -> DataFrame:
    """The postings of runs that lie with their range, one range per task, as ``ranked_range`` makes them."""
    def run(batches: Iterable[pa.RecordBatch]):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for part, lists in zip(batch.column("part").to_pylist(), opened(batch)):
                held.setdefault(part, []).append(lists)
        for part in sorted(held):
            yield from ranked_range(held.pop(part), part, average)

    known = "term string, term_exact string, __n bigint, __most double, __shortest bigint, __tf bigint"
    return runs.mapInArrow(run, f"lang string, part int, term_id bigint, block int, doc_id {kind}, n_terms bigint, tf bigint, positions array<int>, {known}")


def term_bounds(docs: DataFrame, words: int, parts: int, kept: list[str] | None = None) -> list[tuple[bytes, bytes, bytes]]:
    """(lang, term, term_exact) at which ranges of terms begin, but the first: about as much to sort in each.

    They are taken from the postings of documents of about BOUND_WORDS. Any bounds give the same index; how even its
    ranges are rests on them.
    """
    every = max(1, words // BOUND_WORDS)
    some = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & F.col("lang").isNotNull())
    found = postings_by_row(some, kept).groupBy("lang", "term", "term_exact").agg((F.sum("tf") + POSTING_WORDS * F.count(F.lit(1))).alias("n"))
    table = found.toArrow().sort_by([(c, "ascending") for c in ("lang", "term", "term_exact")])
    if not table.num_rows:
        return []
    upto = np.cumsum(table.column("n").to_numpy())
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
    columns = [table.column(c).take(pa.array(at[at > 0])).cast(pa.binary()).to_pylist() for c in ("lang", "term", "term_exact")]
    return list(zip(*columns))


def _repeated(docs: DataFrame) -> DataFrame | None:
    """The doc_ids, null among them, that several rows have; None if there are none."""
    found = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    return None if found.isEmpty() else found


def build_postings(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """One row per document and spelling of a term, with its word positions.

    Rows that share a doc_id are one document; where there are none, nothing is shuffled.
    """
    return _merged(postings_by_row(docs, kept).drop("n_terms"), _repeated(docs))


def _merged(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    columns = ["lang", "term", "term_exact", "doc_id", "tf", "positions", "weight"]
    once = rows.withColumn("weight", F.lit(1.0))
    if repeated is None:
        return once.select(*columns)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    several = once.join(repeated, same, "left_semi").groupBy("lang", "term", "term_exact", "doc_id").agg(
        F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.lit(1.0).alias("weight")
    )
    return once.join(repeated, same, "left_anti").select(*columns).unionByName(several.select(*columns))


def build_index(docs: DataFrame, kept: list[str] | None = None) -> TextIndex:
    """Documents need doc_id, lang and content; other columns stay beside the index."""
    lengths = document_lengths(docs)
    rows = postings_by_row(docs, kept)
    repeated = _repeated(docs)
    if repeated is None:
        # Each posting knows the length of its document: no join needs to bring it.
        return TextIndex(rows.withColumn("weight", F.lit(1.0)), docs, lengths, source=docs, kept=kept)
    return TextIndex(_merged(rows.drop("n_terms"), repeated), docs, lengths)


def block_number(place: Column) -> Column:
    """The block of a posting by its place in its term, from 1: 0 up to FIRST_BLOCK, then ever longer ones."""
    beyond = F.floor(F.log(float(BLOCK_GROWTH), (place - 1) / FIRST_BLOCK) + F.lit(1e-9)) + 1
    return F.when(place <= FIRST_BLOCK, 0).otherwise(beyond).cast("int")


def write_index(index: TextIndex, path: str, parts: int | None = None, hot_rows: int = HOT_ROWS) -> None:
    """Store an index so that a search reads only the files of the ranges, and blocks, that can matter to it.

    Terms are numbered in the order of language, term and spelling, so terms with a common beginning have numbers that
    follow each other; ``part`` is the range of terms a number belongs to. A term's postings stand in the order of their
    impact, what they can add to a score: many occurrences in a short document first. Its blocks hold the highest number
    of occurrences and the shortest document of their postings. Postings are shuffled once, by ranges of terms that one
    task sorts in memory; if ``source`` is known, as lists per term, and the task numbers and places them as columns. Those
    of terms with more than ``hot_rows`` are ranked by several tasks.
    """
    tables = {"docs": index.docs, "lengths": index.lengths}
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/{name}")
    spark = index.docs.sparkSession
    lengths = spark.read.parquet(f"{path}/lengths")
    words, average, longest = _totals(lengths)
    parts = parts or max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PART_WORDS))
    packed = index.source is not None
    postings = index.postings if packed else stored(index.postings, "postings")
    placed = postings.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    # Of a document with several lengths, each posting stands there once per length, and counts once.
    if "n_terms" in postings.columns:
        placed = placed.withColumn("again", F.lit(False))
    else:
        each = lengths.groupBy("doc_id").agg(F.collect_list("n_terms").alias("__lengths"))
        placed = placed.join(each, "doc_id").select("*", F.posexplode("__lengths").alias("__at", "n_terms")).withColumn("again", F.col("__at") > 0).drop("__at", "__lengths")
    strength = F.col("tf") * F.col("weight")
    # The default ranking's saturation; any order gives the same results, this one the tightest blocks.
    impact = strength / (strength + 1.2 * (0.25 + 0.75 * F.col("n_terms") / F.lit(average)))
    term = ["lang", "term", "term_exact"]
    hot = hot_keys(postings, term, hot_rows) if longest > hot_rows else None
    block = ["lang", "part", "block"]
    if packed:
        without = [] if hot is None else [tuple(name.encode() for name in row) for row in hot.select(*term).collect() if None not in tuple(row)]
        runs = runs_by_range(index.source, term_bounds(index.source, words, parts, index.kept), index.kept, without)
        kind = index.source.schema["doc_id"].dataType.simpleString()
        blocked = ranges_in_order(runs.repartitionById(parts, F.col("part")), kind, average).withColumn("weight", F.lit(1.0)).withColumn("again", F.lit(False))
    else:
        dealt = placed if hot is None else placed.join(F.broadcast(hot), term, "left_anti")
        in_order = dealt.repartitionByRange(parts, *term).withColumn("impact", impact).sortWithinPartitions(*term, F.desc("impact"), "doc_id")
        # A term has the number of its first row, so a row's place follows from its own.
        upto = Window.partitionBy(*term).orderBy(F.desc("impact"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = in_order.withColumn("__row", F.monotonically_increasing_id()).withColumn("term_id", F.first("__row").over(upto))
        ranked = numbered.withColumn("part", F.shiftright("term_id", 33).cast("int")).withColumn("place", F.col("__row") - F.col("term_id") + 1)
        blocked = ranked.withColumn("block", block_number(F.col("place"))).drop("impact", "place", "__row")
    blocked.sortWithinPartitions(*block, "term_id", "doc_id").write.mode("overwrite").partitionBy(*block).parquet(f"{path}/postings")
    if hot is not None:
        # Ranges of their own behind the others.
        ids = hot.withColumn("part", (F.row_number().over(Window.orderBy(*term)) + parts - 1).cast("int"))
        ids = stored(ids.withColumn("term_id", F.shiftleft(F.col("part").cast("bigint"), 33)), "hot-terms")
        held = stored(placed.withColumn("impact", impact).join(F.broadcast(ids), term), "hot-postings")
        spread = rank_in_group(held, term, [("impact", False), ("doc_id", True)], "place", hot_rows, known=(hot,))
        spread = spread.withColumn("block", block_number(F.col("place"))).drop("impact", "place")
        if packed:
            spread = spread.withColumns({c: F.lit(None).cast(blocked.schema[c].dataType) for c in KNOWN})
        by_term = spread.repartitionByRange("part", "block", "term_id", "doc_id").sortWithinPartitions(*block, "term_id", "doc_id")
        by_term.write.mode("append").partitionBy(*block).parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    if packed:
        # Rows that carry what is known of their block stand for all of it, rows of hot terms for themselves.
        written = written.where("term IS NOT NULL")
        once = {"n": F.coalesce("__n", F.lit(1)), "most": F.coalesce("__most", strength), "shortest": F.coalesce("__shortest", "n_terms"), "tf": F.coalesce("__tf", "tf")}
    else:
        once = {"n": F.lit(1), "most": strength, "shortest": F.col("n_terms"), "tf": F.col("tf")}
    # With the strings as keys, blocks are counted without sorting the postings once more.
    bounds = written.groupBy("lang", "part", "term_id", "block", "term", "term_exact").agg(
        F.sum(once["n"]).alias("n"), F.max(once["most"]).alias("most"), F.min(once["shortest"]).alias("shortest"),
        F.sum(F.when(F.col("again"), 0).otherwise(once["n"])).alias("doc_frequency"), F.sum(F.when(~F.col("again"), once["tf"])).alias("occurrences"),
    )
    bounds.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy(*term, "term_id", "part").agg(F.sum("doc_frequency").alias("doc_frequency"), F.sum("occurrences").alias("occurrences"))
    # Documents without an id have no postings here, yet they hold their terms.
    if not lengths.where("doc_id IS NULL").isEmpty():
        nameless = postings.where("doc_id IS NULL")
        more = nameless.groupBy(*term).agg(F.count(F.lit(1)).alias("__n"), F.sum("tf").alias("__tf"))
        terms = terms.join(more, term, "left").select(
            *term, "term_id", "part", (F.col("doc_frequency") + F.coalesce("__n", F.lit(0))).alias("doc_frequency"),
            (F.col("occurrences") + F.coalesce("__tf", F.lit(0))).alias("occurrences"),
        )
    terms.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/terms")


def _totals(lengths: DataFrame) -> tuple[int, float | None, int]:
    """Words in all, per document on average, and the rows of the language that has most: no term has more postings."""
    rows = lengths.groupBy("lang").agg(F.sum("n_terms").alias("words"), F.count(F.lit(1)).alias("rows"))
    return rows.agg(F.coalesce(F.sum("words"), F.lit(0)), F.sum("words") / F.sum("rows"), F.coalesce(F.max("rows"), F.lit(0))).first()


def read_index(spark: SparkSession, path: str) -> TextIndex:
    postings, docs, lengths, terms, blocks = [spark.read.parquet(f"{path}/{table}") for table in ("postings", "docs", "lengths", "terms", "blocks")]
    return TextIndex(
        postings.drop("term", "term_exact", "again", *KNOWN), docs, lengths, terms, blocks.drop("term", "term_exact", "doc_frequency", "occurrences")
    )


def term_statistics(postings: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    # A document holds a term once per spelling: reduce to documents first.
    per_doc = postings.groupBy("lang", "term", "doc_id").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("lang", "term").agg(
        F.count(F.lit(1)).alias("doc_frequency"), F.sum("tf").alias("occurrences")
    )


def document_lengths(docs: DataFrame) -> DataFrame:
    """Terms per document, counted in the text without splitting it."""
    return docs.select("lang", "doc_id", T.count_terms(F.col("content")).cast("bigint").alias("n_terms"))


def document_statistics(lengths: DataFrame) -> DataFrame:
    """Number of documents and their average length in terms."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))


def language_entries(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("page_count"))
