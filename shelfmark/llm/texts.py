"""What several operators share: words, row numbers and Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: a word is a longest run without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column | str) -> Column:
    """How many words a text has, in native functions; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased; bytes.split() cuts at just those six characters."""
    return text.lower().split() if text else []


def with_row(df: DataFrame, name: str = "row") -> DataFrame:
    """A number per row of a scan: the same whenever the same files are read again, unlike any column's value."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut batches where the texts of ``column`` pass ``most_bytes``, so that a task holds few long texts at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


# What this worker holds from task to task, by name.
_KEPT: dict = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The worker's own object ``name``, made on its first use; there is one at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Free what the worker holds, and what was freed before but not given back to the system.

    Spark hands a worker on: what one stage kept would stay through all later ones. For the start of a task.
    """
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return batch.column(column).cast(kind).to_pylist()
