"""Benchmark decontamination by Wu-Manber search for many strings at once.

Every run of WORDS words of a test item is a test string. Strings are sorted into classes by their number of words and
the power of two of their length. A class looks at the first ``reach`` bytes of its strings: its shift table says for a
hashed block of a few bytes how far the block's next possible place from the end of the reach is, so that a scan over a
text leaps over places where no string can be. Where the shift is 0, a hash over the blocks of the reach names the
bucket of strings that may stand here; buckets that hold none are known by a bit table. Both tables are of bounded size
and are all that tasks get; the strings stay a Spark table. What the scan leaves is joined with it by bucket, and the
words themselves are compared there.

Texts and items are compared as words in A-Z lower-cased; a word is a longest run without the ASCII characters that are
neither digits nor letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, slices, with_row
from shelfmark.session import stored

WORDS = 10
# Bytes of a string that the tables of its class look at, and bytes per block, at most.
REACH, BLOCK = 128, 8
# Sizes of the tables as powers of two: they follow the number of strings within these bounds. Only speed rests on it.
LEAST_BITS, SHIFT_BITS, BUCKET_BITS = 12, 22, 24
# Bytes of text that one lane of a scan walks over.
LANE = 2048
# Tasks that share a string found in very many texts.
SALTS = 16
ROWS_AT_ONCE = 20_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_PLAIN = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain(text: bytes | None) -> bytes:
    """A text as its words with a blank before, between and behind them; empty if it has none."""
    words = text.translate(_PLAIN).split() if text else []
    return b" %b " % b" ".join(words) if words else b""


def strings_of(text: bytes, words: int) -> Iterator[tuple[bytes, int]]:
    """The test strings of a plain text and their numbers of words: all runs of ``words`` words, or the text if it has fewer."""
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    size = min(words, len(blanks) - 1)
    if size > 0:
        for first, last in zip(blanks[:-size].tolist(), blanks[size:].tolist()):
            yield text[first : last + 1], size


@dataclass(frozen=True)
class Kind:
    """One class of strings: ``words`` words, of which the tables look at ``reach`` bytes in blocks of ``block``."""

    words: int
    power: int
    reach: int

    @property
    def block(self) -> int:
        return min(BLOCK, (self.reach + 1) // 2)

    @property
    def most(self) -> int:
        return self.reach - self.block + 1


class Blocks:
    """The blocks of a buffer by their first byte, as numbers."""

    def __init__(self, data: bytes, size: int):
        padded = data + b"\0" * 8
        self.each = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        self.mask = np.uint64((1 << 8 * size) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.each[places] & self.mask


def slot(blocks: np.ndarray, bits: int) -> np.ndarray:
    return ((blocks * FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


def bucket(blocks: Blocks, starts: np.ndarray, kind: Kind) -> np.ndarray:
    """Hash over all blocks of the reach, the last one first."""
    places = [kind.reach - kind.block, *range(0, kind.reach - kind.block, kind.block)]
    found = np.full(len(starts), np.uint64(kind.words << 8 | kind.power))
    for place in places:
        found = (found ^ blocks.at(starts + place)) * FACTOR
        found ^= found >> np.uint64(29)
    return found


@dataclass
class Strings:
    """``table`` (``string``, ``words``, ``bucket``, ``number``), ``owners`` (``number``, ``item``) and the tables of the scan."""

    table: DataFrame
    owners: DataFrame
    kinds: list[Kind]
    shifts: list[np.ndarray]
    buckets: list[np.ndarray]


def _cut(items: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(``item``, ``string``, ``words``, ``power``) for all test strings of all items."""
    schema = pa.schema([("item", pa.string()), ("string", pa.binary()), ("words", pa.int32()), ("power", pa.int32())])

    def run(batches):
        rows: list[tuple] = []
        for batch in slices(batches, "text"):
            for name, value in zip(batch.column("item").to_pylist(), as_bytes(batch, "text")):
                for string, size in strings_of(plain(value), words):
                    rows.append((name, string, size, len(string).bit_length() - 1))
                    if len(rows) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(run, "item string, string binary, words int, power int")


def fit(items: DataFrame, key: str = "item_id", text: str = "text", words: int = WORDS) -> Strings:
    """The test strings of ``items`` and the tables to search for them.

    Rows that share a ``key`` are one item, null keys share the name ''. Items without words have no strings. An empty
    table has none either, and then nothing is found.
    """
    cut = stored(_cut(items, key, text, words), "cut").distinct()
    distinct = cut.groupBy("string", "words", "power").agg(F.count("*").alias("n"))
    numbered = stored(with_row(distinct.drop("n"), "number"), "strings")
    owners = stored(cut.join(numbered.select("string", "number"), "string").select("number", "item"), "owners")
    # One row per class: WORDS times the powers of two below the longest text.
    sizes = numbered.groupBy("words", "power").agg(F.min(F.length("string")).alias("least"), F.count("*").alias("n")).orderBy("words", "power").collect()
    kinds = [Kind(row["words"], row["power"], min(row["least"], REACH)) for row in sizes]
    bits = [max(LEAST_BITS, (int(row["n"]) * 16).bit_length()) for row in sizes]
    shift_bits, bucket_bits = [min(b, SHIFT_BITS) for b in bits], [min(b, BUCKET_BITS) for b in bits]
    by_class = {(kind.words, kind.power): i for i, kind in enumerate(kinds)}

    def prepare(batches):
        """Slots of both tables (``number`` null) and, per string, its bucket."""
        for batch in slices(batches, "string", 1 << 20):
            strings, number = batch.column("string").to_pylist(), batch.column("number").to_numpy()
            of = np.array([by_class[c] for c in zip(batch.column("words").to_pylist(), batch.column("power").to_pylist())])
            for i in np.unique(of):
                kind, mine = kinds[i], np.flatnonzero(of == i)
                # The reaches of the strings one behind the other.
                blocks = Blocks(b"".join(strings[j][: kind.reach] for j in mine), kind.block)
                starts = np.arange(len(mine)) * kind.reach
                low = np.full(1 << shift_bits[i], kind.most, np.uint8)
                for place in range(kind.most):
                    low[slot(blocks.at(starts + place), shift_bits[i])] = kind.most - 1 - place
                used = np.flatnonzero(low < kind.most)
                named = bucket(blocks, starts, kind)
                full = np.unique(slot(named, bucket_bits[i]))
                for table, at, value in ((0, used, low[used]), (1, full, np.zeros(len(full)))):
                    yield _slots(i, table, at, value.astype(np.int32), None, None)
                yield _slots(i, 2, None, None, named.view(np.int64), number[mine])

    made = stored(numbered.mapInArrow(prepare, "kind int, table int, slot bigint, value int, bucket bigint, number bigint"), "slots")
    merged = made.where("table < 2").groupBy("kind", "table", "slot").agg(F.min("value").alias("value")).toArrow()
    of, table, at, value = (merged.column(c).to_numpy() for c in ("kind", "table", "slot", "value"))
    shifts, buckets = [], []
    for i, kind in enumerate(kinds):
        shift = np.full(1 << shift_bits[i], kind.most, np.uint8)
        mine = (of == i) & (table == 0)
        shift[at[mine]] = value[mine]
        known = np.zeros(1 << bucket_bits[i], bool)
        known[at[(of == i) & (table == 1)]] = True
        shifts.append(shift)
        buckets.append(np.packbits(known, bitorder="little"))
    bucketed = numbered.join(made.where("table = 2").select("number", "bucket"), "number").select("string", "words", "bucket", "number")
    return Strings(stored(bucketed, "bucketed"), owners, kinds, shifts, buckets)


def _slots(kind: int, table: int, at, value, named, number) -> pa.RecordBatch:
    n = len(at if at is not None else named)
    nothing = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, table, np.int32)), nothing(at, pa.int64()), nothing(value, pa.int32()), nothing(named, pa.int64()), nothing(number, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "table", "slot", "value", "bucket", "number"])


def leaps(data: bytes, kind: Kind, shift: np.ndarray, known: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of ``data`` where a string of the class may begin, sorted, their buckets, and how many places were looked at.

    Lanes walk over the data side by side, each from its first byte to that of the next lane.
    """
    blocks, last = Blocks(data, kind.block), len(data) - kind.reach + 1
    shift_bits, bucket_bits = len(shift).bit_length() - 1, (8 * len(known)).bit_length() - 1
    at = np.arange(0, max(last, 0), lane)
    until = np.minimum(at + lane, last)
    found, looked = [np.empty(0, np.int64)], 0
    while len(at):
        looked += len(at)
        step = shift[slot(blocks.at(at + (kind.reach - kind.block)), shift_bits)]
        here = at[step == 0]
        if len(here):
            found.append(here)
        at = at + np.maximum(step, 1)
        more = at < until
        at, until = at[more], until[more]
    places = np.sort(np.concatenate(found))
    named = bucket(blocks, places, kind)
    slots = slot(named, bucket_bits)
    maybe = (known[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
    return places[maybe], named[maybe], looked


def scan(docs: DataFrame, strings: Strings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (``row``, ``key``, ``n_words``) per row of ``docs``, and one (``row``, ``at``, ``words``, ``bucket``, ``string``) per place
    where a test string may begin: ``string`` are the words from word ``at`` on. ``docs`` is read once, whole."""
    tables = docs.sparkSession.sparkContext.broadcast((strings.kinds, strings.shifts, strings.buckets))
    names = ["row", "key", "n_words", "at", "words", "bucket", "string"]

    def run(batches):
        kinds, shifts, buckets = tables.value
        for batch in slices(batches, "text"):
            texts = [plain(value) for value in as_bytes(batch, "text")]
            row, keys = batch.column("row").to_numpy(), batch.column("key")
            words = np.array([max(0, t.count(b" ") - 1) for t in texts], np.int64)
            nothing = [pa.nulls(len(row), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), keys, pa.array(words), *nothing], names=names)
            data, blanks, ends = b"".join(texts), None, np.cumsum([len(t) for t in texts])
            for kind, shift, known in zip(kinds, shifts, buckets):
                places, named, _ = leaps(data, kind, shift, known)
                if not len(places):
                    continue
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
                    begin = np.searchsorted(blanks, ends - [len(t) for t in texts])
                # A string begins with a blank, and as many words follow in the same text.
                of, first = np.searchsorted(ends, places, side="right"), np.searchsorted(blanks, places)
                at = first - begin[of]
                fits = np.flatnonzero((blanks[np.minimum(first, len(blanks) - 1)] == places) & (at + kind.words <= words[of]))
                for some in np.split(fits, range(ROWS_AT_ONCE, len(fits), ROWS_AT_ONCE)):
                    held = [data[a : b + 1] for a, b in zip(places[some].tolist(), blanks[first[some] + kind.words].tolist())]
                    columns = [row[of[some]], pa.nulls(len(some), keys.type), pa.nulls(len(some), pa.int64()), at[some].astype(np.int32), np.full(len(some), kind.words, np.int32), named[some].view(np.int64), pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    rows = with_row(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"row bigint, key {docs.schema[key].dataType.simpleString()}, n_words bigint, at int, words int, bucket bigint, string binary")


def _salted(big: DataFrame, small: DataFrame, on: list[str], by: list[str], salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small``, which is repeated, so that a key with very many rows in ``big`` is dealt to several tasks."""
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*on, "__salt"]).drop("__salt")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """(``key``, ``n_words``, ``ranges``, ``items``) for every row of ``docs``.

    ``ranges`` are the longest ranges (``start``, ``end``, of words, end exclusive) that occurrences of test strings cover or
    touch, in order; ``items`` are the names of all items that have a string in the text, sorted. Rows that share a key,
    or have none, are texts of their own. Null, empty and wordless texts have no ranges. Other columns, whatever their
    names, are not looked at. An empty table gives an empty result. A text is read whole, at any length; what is kept of
    it are its occurrences.
    """
    strings = fit(items, item_key, item_text, words)
    found = stored(scan(docs, strings, key, text), "scanned")
    maybe = found.where("at IS NOT NULL").select("row", "at", "words", "bucket", "string")
    # Comparison of the words themselves.
    hits = stored(_salted(maybe, strings.table, ["bucket", "string", "words"], ["row", "at"]).select("row", "at", (F.col("at") + F.col("words")).alias("end"), "number"), "hits")
    return _summed(found, hits, strings.owners, key)


def _summed(found: DataFrame, hits: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.col("at") > F.max("end").over(before), 1).otherwise(0)
    in_order = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = hits.select("row", "at", "end", begins.alias("begins")).withColumn("part", F.sum("begins").over(in_order))
    merged = parts.groupBy("row", "part").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    ranges = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    # Texts with the same strings have the same items: those are put together once per set of strings.
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("number")).alias("numbers")).withColumn("name", F.sha2(F.concat_ws(",", "numbers"), 256))
    sets = stored(sets, "sets")
    once = sets.groupBy("name").agg(F.first("numbers").alias("numbers")).select("name", F.explode("numbers").alias("number"))
    items = _salted(once, owners, ["number"], ["name"]).groupBy("name").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = _salted(sets.select("row", "name"), items, ["name"], ["row"]).select("row", "items").join(ranges, "row")
    nothing = found.where("n_words IS NOT NULL").select("row", F.col("key").alias(key), "n_words").join(known, "row", "left")
    return nothing.select(
        key, "n_words",
        F.coalesce("ranges", F.array().cast("array<struct<start:int,end:int>>")).alias("ranges"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(ranges: Column) -> Column:
    """How many words ranges hold."""
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, r: n + (r["end"] - r["start"]).cast("bigint"))
