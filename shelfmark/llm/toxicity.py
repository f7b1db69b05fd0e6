"""Toxicity as ordinal regression: a cumulative-link model on sparse word features.

P(grade > k) is the logistic function of (weights . features - threshold k): all thresholds share the weights. The
features are the words that are far more frequent in toxic labelled documents than chance allows, counted as
log(1 + n). The expected severity is the sum of P(grade > k) over the thresholds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.texts import as_bytes, let_go, slices
from shelfmark.session import stored

# Bounds of the fit: labelled documents it looks at, and words it keeps as features.
SAMPLE = 30_000
MOST_WORDS = 5_000
# A word is a feature if a share of toxic documents as high as its own has less than this chance.
CHANCE = 1e-7
# Documents of this expected severity or more are toxic.
TOXIC_FROM = 0.5
RIDGE = 0.02
MOST_KEPT = 400_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass
class Model:
    """Weight per word and rising thresholds, one per grade above 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def severity(self, score: np.ndarray) -> np.ndarray:
        total = np.zeros(len(score))
        for threshold in self.thresholds:
            total += _logistic(score - threshold)
        return total


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Lookup(dict):
    """Numbers of the features among the words of a raw token, each as often as it stands there; forgets when full."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.words = {word: i for i, word in enumerate(words)}
        self.kept = 0

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        found = tuple(self.words[word] for word in LETTERS.findall(raw.decode().lower()) if word in self.words)
        # A text may be one token: tokens count by their size.
        self.kept += 1 + len(raw) // 64
        if self.kept > MOST_KEPT:
            self.clear()
            self.kept = 1 + len(raw) // 64
        self[raw] = found
        return found


def _chance(k: int, n: int, share: float) -> float:
    """Upper bound of the chance of k or more toxic documents among n (Chernoff)."""
    if k <= n * share:
        return 1.0
    p = k / n
    gain = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return math.exp(-n * gain)


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(``text``, ``toxic``) of at most ``sample`` labelled documents, chosen by a hash of their id, each text once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = docs.where(F.col(text).isNotNull()).select(F.col("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Repeated doc_ids may bring more rows than labels; the bound holds for texts.
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic").limit(sample)


def signal_words(sample: DataFrame, chance: float = CHANCE, most: int = MOST_WORDS) -> list[str]:
    """Words whose documents are toxic more often than chance allows, the least likely ones first."""
    def count(batches):
        let_go()
        for batch in slices(batches, "text"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for value, toxic in zip(as_bytes(batch, "text"), batch.column("toxic").to_pylist()):
                seen[toxic].update(set(LETTERS.findall(value.decode().lower())))
            words = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic"])

    clean, toxic = sample.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    if not clean or not toxic:
        return []
    share = toxic / (clean + toxic)
    counts = sample.mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # The bound of the chance of pure words leaves out all that could not pass; the rest is few.
    least = max(2, math.ceil(math.log(chance) / math.log(share)) if share < 1 else 2)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    scored = counts.where(F.col("toxic") >= least).where(rate > share).withColumn("gain", gain * (F.col("toxic") + F.col("clean")))
    rows = scored.where(F.col("gain") > -math.log(chance)).orderBy(F.desc("gain"), "word").limit(most).select("word").collect()
    return [row["word"] for row in rows]


def _counted(batch: pa.RecordBatch, text: str, lookup: Lookup) -> list[Counter]:
    """Feature counts of each text of a batch."""
    result = []
    for value in as_bytes(batch, text):
        result.append(Counter(chain.from_iterable(map(lookup.__getitem__, value.lower().split()))) if value else Counter())
    return result


def fit_grades(rows: list[dict[int, int]], grades: np.ndarray, features: int, ridge: float = RIDGE, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by full gradient steps (Adam), the same on every run."""
    top = int(grades.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    value = np.log1p(np.array([n for r in rows for n in r.values()], float))
    # Parameters: weights, first threshold, logarithms of the gaps between thresholds.
    x = np.zeros(features + top)
    x[features] = 1.0
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        theta = x[features] + np.r_[0.0, np.cumsum(np.exp(x[features + 1 :]))]
        score = np.bincount(at, value * x[column], len(rows))
        # Likelihood of each grade from its two neighbouring thresholds.
        above = _logistic(score[:, None] - theta[None, :])
        edges = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], 1)
        slope = edges * (1 - edges)
        index = np.arange(len(rows))
        chance = np.maximum(edges[index, grades] - edges[index, grades + 1], 1e-12)
        low, high = slope[index, grades] / chance, slope[index, grades + 1] / chance
        by_score = low - high
        by_theta = np.zeros(top)
        np.add.at(by_theta, grades[grades > 0] - 1, -low[grades > 0])
        np.add.at(by_theta, grades[grades < top], high[grades < top])
        gradient = np.zeros_like(x)
        gradient[:features] = np.bincount(column, value * by_score[at], features) / len(rows) - ridge / len(rows) * 10 * x[:features]
        gradient[features] = by_theta.sum() / len(rows)
        for k in range(1, top):
            gradient[features + k] = by_theta[k:].sum() * np.exp(x[features + k]) / len(rows)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x += 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return x[:features], x[features] + np.r_[0.0, np.cumsum(np.exp(x[features + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents.

    Labels only say toxic or not, so toxic documents are graded by how much they hold: grade 1 up to the middle
    number of signal words among them, grade 2 above, 0 for clean ones. Null labels, texts and ids are left out.
    Without both kinds of documents, or without any signal word, the model is empty and finds nothing toxic.
    """
    rows = stored(labelled(docs, labels, text, sample), "labelled")
    words = signal_words(rows)
    if not words:
        return Model()

    def features(batches):
        let_go()
        lookup = Lookup(words)
        for batch in slices(batches, "text"):
            counted = _counted(batch, "text", lookup)
            columns = [batch.column("toxic").cast(pa.int32()), pa.array([list(c) for c in counted], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "words", "counts"])

    # At most ``sample`` rows, with only the words that are features.
    found = rows.mapInArrow(features, "toxic int, words array<int>, counts array<int>").orderBy("toxic", "words", "counts").collect()
    toxic = np.array([row["toxic"] for row in found])
    held = np.array([sum(row["counts"]) for row in found])
    middle = np.median(held[toxic == 1])
    grades = np.where(toxic == 0, 0, np.where(held <= middle, 1, 2))
    # Grades that no document has get no threshold.
    grades = np.searchsorted(np.unique(grades), grades)
    weights, thresholds = fit_grades([dict(zip(r["words"], r["counts"])) for r in found], grades, len(words))
    return Model({w: float(x) for w, x in zip(words, weights)}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``severity`` (0 to the number of thresholds) and ``toxic`` from the whole text.

    Null, empty and blank texts have no features, hence the score 0. Rows are judged one by one: repeated rows alike.
    Columns of ``docs`` named like results are replaced; an empty table gives an empty result.
    """
    words = list(model.weights)
    weights = np.array([*model.weights.values(), 0.0])
    kept = [f for f in docs.schema.fields if f.name not in ("score", "severity", "toxic")]

    def run(batches):
        let_go()
        lookup = Lookup(words)
        for batch in slices(batches, text):
            counted = _counted(batch, text, lookup) if words else [{}] * batch.num_rows
            scores = np.array([sum(weights[i] * math.log1p(n) for i, n in sorted(c.items())) for c in counted], float)
            severity = model.severity(scores)
            columns = [batch.column(f.name) for f in kept]
            new = [pa.array(scores), pa.array(severity), pa.array(severity >= TOXIC_FROM)]
            yield pa.RecordBatch.from_arrays(columns + new, names=[f.name for f in kept] + ["score", "severity", "toxic"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "severity double", "toxic boolean"])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
