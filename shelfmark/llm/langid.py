"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, counted on a bounded sample of labelled documents and
then frozen. A byte that a context has seen costs -log2(n / (total + kinds)); all others share the escape
probability kinds / (total + kinds) in the proportions of the next shorter context, down to equal shares of all 256
bytes. So each context's probabilities sum to one, and a text's cost is its exact code length. The shortest wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, slices
from shelfmark.session import stored

# Bounds of the fit: labelled documents per language, and cells (contexts x symbols x languages) of the tables.
SAMPLE = 400
CELLS = 1 << 24
# Rows looked at per row of the sample: as hashes spread evenly, the lowest ones are among these.
SPARE = 2
# Bytes that have symbols of their own: the most frequent ones. All others share the last symbol, in equal parts.
SYMBOLS = 128
ORDER = 3
# Code lengths are held in units of 1/1024 bit.
UNIT = 1024.0
WINDOW = 1 << 20
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
# Each text is coded as if it stood after this.
BEFORE = b"\n" * ORDER


def prepared(text: bytes | None) -> bytes:
    """The text in lower case, so that capitals need no statistics of their own."""
    return text.decode().lower().encode() if text else b""


@dataclass
class Model:
    """``costs[context, symbol, language]`` and, for the last three symbols, the longest context known."""

    languages: list[str]
    symbol: np.ndarray
    longest: np.ndarray
    costs: np.ndarray


def grams(rows: DataFrame) -> DataFrame:
    """(``lang``, ``gram``, ``n``): counts of four bytes in a row, as one number, of rows (lang, text)."""
    def run(batches):
        for batch in slices(batches, "text"):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch, "text")):
                found.setdefault(lang, []).append(np.frombuffer(BEFORE + prepared(text), np.uint8).astype(np.int64))
            for lang, texts in found.items():
                coded = [t[:-3] << 24 | t[1:-2] << 16 | t[2:-1] << 8 | t[3:] for t in texts if len(t) > ORDER]
                if coded:
                    gram, n = np.unique(np.concatenate(coded), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(gram), "gram": gram, "n": n.astype(np.int64)})

    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _probabilities(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of the symbols (columns) in each context (rows), given those of the next shorter contexts."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    unseen = np.where(counts > 0, 0.0, parent).sum(1, keepdims=True)
    room = np.where(unseen > 0, kinds, 0.0)
    escape = np.where(total > 0, room / np.maximum(total + room, 1), 1.0)
    return np.where(counts > 0, counts / np.maximum(total + room, 1), escape * parent / np.maximum(unseen, 1e-300))


def fit(docs: DataFrame, sample: int = SAMPLE, cells: int = CELLS) -> Model | None:
    """The model of rows (``doc_id``, ``lang``, ``text``): at most ``sample`` per language, chosen by a hash of the id.

    Rows without language, text or id teach nothing; without any row there is no model. Whole texts are counted.
    A language's rows are counted first, so that only those whose hash is low enough for the sample are shuffled.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("h"), "doc_id")
    # One entry per language, as many as the model has.
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).scalar()
    place = F.col("h") / F.lit(2.0**64) + 0.5
    low = known.withColumn("__counts", counts).where(place * F.element_at("__counts", F.col("lang")) < SPARE * sample).drop("__counts")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = low.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("lang", "text")
    counted = stored(grams(chosen), "grams")
    languages = [row["lang"] for row in counted.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None

    # Symbols: the most frequent bytes.
    last = F.col("gram").bitwiseAND(255)
    frequent = counted.groupBy(last.alias("byte")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "byte").limit(SYMBOLS - 1).collect()
    symbol = np.full(256, SYMBOLS - 1, np.int64)
    symbol[[row["byte"] for row in frequent]] = np.arange(len(frequent))
    others = max(1, 256 - len(frequent))

    # Contexts per order: the most frequent ones, within the bound of cells. Sums over grams that share a context.
    most = max(1, cells // (SYMBOLS * len(languages)) // ORDER)
    lookup = {lang: i for i, lang in enumerate(languages)}
    # The longest known context behind any three symbols, filled from short to long, and each context's next shorter one.
    longest = np.zeros((SYMBOLS,) * ORDER, np.int32)
    tables: list[np.ndarray] = []
    parents: list[np.ndarray] = []
    known_contexts = 0
    for k in range(ORDER + 1):
        context = F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1) if k else F.lit(0).cast("bigint")
        rows = counted.select("lang", context.alias("context"), last.alias("byte"), "n").groupBy("lang", "context", "byte").agg(F.sum("n").alias("n"))
        if k:
            kept = rows.groupBy("context").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "context").limit(most).select("context")
            rows = rows.join(kept, "context", "left_semi")
        # At most ``most`` contexts x 256 bytes x languages, of which few occur.
        found = rows.toPandas()
        spelled = np.zeros(len(found), np.int64)
        for j in range(k):
            spelled = spelled * SYMBOLS + symbol[found["context"].to_numpy(np.int64) >> 8 * (k - 1 - j) & 255]
        values, index = np.unique(spelled, return_inverse=True)
        table = np.zeros((len(languages), len(values), SYMBOLS), np.float32)
        np.add.at(table, (found["lang"].map(lookup).to_numpy(), index, symbol[found["byte"].to_numpy(np.int64)]), found["n"].to_numpy(np.float32))
        tables.append(table)
        if k:
            digits = [values // SYMBOLS ** (k - 1 - j) % SYMBOLS for j in range(k)]
            parents.append(longest[(0,) * (ORDER - k + 1) + tuple(digits[1:])] if k > 1 else np.zeros(len(values), np.int32))
            longest[(slice(None),) * (ORDER - k) + tuple(digits)] = known_contexts + np.arange(len(values))
        known_contexts += len(values)

    costs = np.zeros((known_contexts, SYMBOLS, len(languages)), np.uint16)
    base = np.full(SYMBOLS, 1 / 256)
    base[-1] = others / 256
    base[len(frequent) : -1] = 0.0
    for i in range(len(languages)):
        chances = _probabilities(tables[0][i].astype(float), base[None, :])
        for table, parent in zip(tables[1:], parents):
            chances = np.concatenate([chances, _probabilities(table[i].astype(float), chances[parent])])
        bits = -np.log2(np.maximum(chances, 1e-9))
        bits[:, -1] += np.log2(others)
        costs[:, :, i] = np.minimum(np.round(bits * UNIT), 65535).astype(np.uint16)
    return Model(languages, symbol.astype(np.int32), longest, costs)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text (rows) in each language (columns)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stream = model.symbol[np.frombuffer(b"".join(BEFORE + t for t in texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes + ORDER)
    coded = np.ones(len(stream), bool)
    coded[(np.cumsum(sizes + ORDER) - sizes - ORDER)[:, None] + np.arange(ORDER)] = False
    flat, longest = model.costs.reshape(-1, len(model.languages)), model.longest.reshape(-1)
    totals = np.zeros((len(texts), len(model.languages)))
    for at in range(ORDER, len(stream), WINDOW):
        to = min(at + WINDOW, len(stream))
        a, b, c, s = (stream[at - 3 + i : to - 3 + i] for i in range(4))
        context = longest[(a * SYMBOLS + b) * SYMBOLS + c]
        cost = flat[context * SYMBOLS + s]
        use = coded[at:to]
        cost, who = cost[use], owner[at:to][use]
        if len(who):
            runs = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            np.add.at(totals, who[runs], np.add.reduceat(cost, runs, axis=0, dtype=np.int64))
    return totals / UNIT


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language of the shortest code and its share of the probability.

    Null texts, texts without a letter, and all texts if there is no model, are ``und`` with score 0. Ties go to the
    language whose name comes first. Columns of ``docs`` named like results are replaced; an empty table gives an
    empty result; repeated rows are judged alike. The model is of bounded size and is sent to all workers once.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "__text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in slices(batches, "__text"):
            texts = as_bytes(batch, "__text")
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            judged = [i for i, t in enumerate(texts) if t and learned and LETTER.search(t.decode())]
            if judged:
                bits = code_lengths(learned, [prepared(texts[i]) for i in judged])
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, lang, value in zip(judged, best, share):
                    names[i], scores[i] = learned.languages[lang], float(value)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in kept] + ["lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, schema)
