"""Cost-balanced packing of documents into training sequences.

Attention cost of a piece is linear plus quadratic in its length. Documents are dealt into groups of bounded
bytes. Within a group each document first fills whole sequences; the rests then go, longest first, to the
cheapest sequence with room for them. A group has just as many places as tokens: full sequences and, for what
is left over, sequences of powers of two, which need no padding. A rest that fits nowhere is cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, slices, with_row
from shelfmark.llm.tokens import word_ids

CAPACITY = 2048
END_ID = 1
# Bytes of text per group: what one task packs at a time, beside its longest document.
GROUP_BYTES = 1 << 24
# Cost of a piece of n tokens: LINEAR * n + n * n.
LINEAR = 1024.0


def places(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Sizes of the sequences that hold just ``total`` tokens: full ones, then falling powers of two."""
    rest = total % capacity
    halves = [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([capacity] * (total // capacity) + halves, np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given numbers of tokens."""
    lengths = np.asarray(lengths, np.int64)
    whole, rests = lengths // capacity, lengths % capacity
    pieces, sequence = [], 0
    for document in np.flatnonzero(whole):
        for chunk in range(whole[document]):
            pieces.append((int(document), chunk * capacity, capacity, sequence, 0))
            sequence += 1
    room = places(int(rests.sum()), capacity)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for document in np.argsort(-rests, kind="stable"):
        start, left = int(whole[document]) * capacity, int(rests[document])
        while left:
            fits = room >= left
            target = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            length = min(left, int(room[target]))
            pieces.append((int(document), start, length, sequence + target, int(used[target])))
            room[target] -= length
            used[target] += length
            cost[target] += linear * length + length * length
            start, left = start + length, left - length
    return pieces


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text", end: int = END_ID) -> DataFrame:
    """(``doc_id``, ``row``, ``ids``): each document's ids as 32-bit little-endian numbers; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = word_ids(tokenizer)
        for batch in slices(batches, text):
            ids = encoder.encode([value or b"" for value in as_bytes(batch, text)], end)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = with_row(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "row", F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (binary).

    Every document has at least its end id. Rows that share a doc_id, or have none, are documents of their own.
    Documents are dealt to groups by row, so that copies spread; an empty table gives no pieces. Columns other
    than doc_id and the text are not looked at. Nothing is dropped: each id lies in one piece.
    """
    volume = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    groups = max(1, -(-volume // group_bytes))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        # A shuffle brings rows in any order; packing must not depend on it.
        group = group.sort_values("row", kind="stable")
        blobs = group["ids"].tolist()
        lengths = np.fromiter((len(x) // 4 for x in blobs), np.int64, len(blobs))
        pieces = np.array(assign(lengths, capacity), np.int64).reshape(-1, 5)
        document, start, length, sequence, offset = pieces.T
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"].astype("Int64").array[document], "start": start, "length": length,
                "doc_tokens": lengths[document], "sequence_id": (int(key[0]) << 36) + sequence, "offset": offset,
                "ids": [blobs[d][4 * s : 4 * (s + n)] for d, s, n in zip(document, start, length)],
            }
        )

    # Shuffled ids are held as written: Spark compresses them on the way.
    dealt = tokenized(docs, tokenizer, text).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return dealt.groupBy("group").applyInPandas(run, schema)
