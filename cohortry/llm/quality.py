"""Quality rules: base counts, then a calibrated logistic regression over hashed word and character n-grams.

The regression is fitted by Spark on a bounded sample of labelled documents; scoring gathers its weights in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WORD, CharGrams, chunks, stored

SYMBOLS = frozenset("#*$%&|<>")
#: Fixed thresholds of the base rules and of the verdict.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_FROM = 50, 50, 0.5
#: Labelled documents that the regression is fitted on at most (those with the lowest hash of their id).
MAX_LABELLED = 6_000
#: Of those, the part that calibrates: one in CALIBRATION_PARTS.
CALIBRATION_PARTS = 5
WORD_BITS, CHAR_BITS, CHAR_ORDERS = 15, 14, (2, 3)
REMEMBERED_WORDS = 300_000
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class QualityModel:
    """weights: one value per bucket; probability = sigmoid(slope * margin + offset). None stands for no verdict."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


class Words:
    """Words as numbers, with the length, symbols and hash of each; forgets all when too many are known."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.columns = np.zeros((3, 0), np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED_WORDS:
            self._reset()
        known = len(self.number)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            new = list(self.number)[known:] if known == 0 else _last(self.number, len(self.number) - known)
            more = [(len(w), sum(c in SYMBOLS for c in w), zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))) for w in new]
            self.columns = np.concatenate([self.columns, np.array(more, np.int64).reshape(-1, 3).T], axis=1)
        return ids


def _last(items: dict, n: int) -> list:
    found = []
    for key in reversed(items):
        found.append(key)
        if len(found) == n:
            break
    return found[::-1]


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, local = np.unique(ids, return_inverse=True)
    span = int(local.max()) + 1
    pairs = local[:-2] * span + local[1:-1]
    if span > 2_000_000:  # three such numbers no longer fit in 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    _, at, times = np.unique(pairs * span + local[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def base_counts(text: str | None, known: Words) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the words as numbers."""
    words = WORD.findall(text or "")
    if not words:
        return (0, 0, 0, 0, 0), np.zeros(0, np.int64)
    ids = known.numbers(words)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                duplicates += 1
            seen.add(line)
    return (len(words), int(known.columns[0, ids].sum()), int(known.columns[1, ids].sum()), duplicates, repeated_words(ids)), ids


def word_buckets(ids: np.ndarray, known: Words) -> np.ndarray:
    """Buckets of the words and word pairs of one text."""
    single = known.columns[2, ids].astype(np.uint64)
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:]
    mixed = np.concatenate([single * np.uint64(0xD6E8FEB86659FD93), (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)])
    return (mixed >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def measured(texts: list[str | None], known: Words) -> Iterator[tuple[tuple, np.ndarray, list[np.ndarray]]]:
    """For each text: base counts, word buckets, and the buckets of each character order (offset to their own range)."""
    grams = CharGrams(CHAR_ORDERS, CHAR_BITS)
    for begin, end in chunks([len(t or "") for t in texts], BATCH_CHARS):
        part = [t or "" for t in texts[begin:end]]
        by_order = [((1 << WORD_BITS) + (k << CHAR_BITS), *found) for k, found in enumerate(grams(part))]
        for i, text in enumerate(part):
            counts, ids = base_counts(text, known)
            yield counts, word_buckets(ids, known), [base + buckets[starts[i] : starts[i + 1]] for base, buckets, starts in by_order]


#: Weight of each family of n-grams: the values of a text's features are these, times the n-gram's share in the family.
SCALE = 100.0
N_FEATURES = (1 << WORD_BITS) + (len(CHAR_ORDERS) << CHAR_BITS)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """At most ``bound`` labelled documents: (key, text, label). Repeated labels of a document count by majority, a tie as 1; repeated documents stay."""
    votes = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).dropna().groupBy("key").agg(F.avg("label").alias("label"))
    chosen = votes.select("key", F.when(F.col("label") >= 0.5, 1.0).otherwise(0.0).alias("label")).orderBy(F.xxhash64("key"), "key").limit(bound)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "key")  # `bound` rows


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, penalty: float = 0.01) -> QualityModel | None:
    """Fit on a bounded labelled sample, calibrate on a fifth of it (Platt). None if the sample lacks one of the classes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            at, values = [], []
            for _, words, chars in measured(batch.column(1).to_pylist(), known):
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for family in (words, *chars):
                    if len(family):
                        buckets, n = np.unique(family, return_counts=True)
                        found.append((buckets, n * (SCALE / len(family))))
                at.append(np.concatenate([b for b, _ in found]).astype(np.int32) if found else np.zeros(0, np.int32))
                values.append(np.concatenate([v for _, v in found]) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["key", "label", "at", "values"])

    sample = labelled_sample(docs, labels, bound).where(F.length("text") > 0)
    rows = sample.mapInArrow(features, "key long, label double, at array<int>, values array<double>")
    rows = stored(rows.withColumn("calibrates", F.pmod(F.xxhash64("key", F.lit("calibration")), F.lit(CALIBRATION_PARTS)) == 0), "quality-sample")
    fit_rows = rows.where("NOT calibrates")
    if {r[0] for r in fit_rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    vector = F.udf(lambda at, values: SparseVector(N_FEATURES, at, values), VectorUDT())  # the bounded sample only
    model = LogisticRegression(regParam=penalty, maxIter=40, standardization=False).fit(fit_rows.select("label", vector("at", "values").alias("features")))
    weights, intercept = model.coefficients.toArray().astype(np.float64), float(model.intercept)
    scored = fit_rows.sparkSession.sparkContext.broadcast(weights)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [float(scored.value[at] @ v) + intercept if len(at) else intercept for at, v in zip((np.array(x, np.int64) for x in batch.column(1).to_pylist()), (np.array(x) for x in batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.float64())], ["label", "margin"])

    held = rows.where("calibrates").select("label", "at", "values").mapInArrow(margins, "label double, margin double").toArrow()  # under `bound` rows
    slope, offset = platt(held.column(1).to_numpy(), held.column(0).to_numpy())
    return QualityModel(weights, intercept, slope, offset)


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability that fits the margins best, with smoothed targets; (1, 0) without both classes."""
    n1, n0 = float((label == 1).sum()), float((label == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def judge(docs: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its base counts, ``base_failed``, ``probability`` and ``kept``.

    A null text counts as one without words; it fails the base rules. Without a model the probability is null and the base
    rules decide alone. Each row is judged by its own text: repeated rows and repeated keys each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = Words(), shared.value
        for batch in batches:
            base, probability = [], []
            for counts, words, chars in measured(batch.column(1).to_pylist(), known):
                base.append(counts)
                if m is None:
                    probability.append(None)
                    continue
                margin = m.intercept + SCALE * sum(float(m.weights[family].mean()) for family in (words, *chars) if len(family))
                probability.append(1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -500, 500))))
            failed = [base_failed(c[0], c[4]) for c in base]
            kept = [not f and (p is None or p >= KEEP_FROM) for f, p in zip(failed, probability)]
            columns = [pa.array([c[k] for c in base], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(probability, pa.float64())], ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(score, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
    return out.withColumnRenamed("key", key)
