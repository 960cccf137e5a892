"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams where the texts are (one pass, counts added by Spark); the matrix of log-probabilities, whose size
is languages x buckets whatever the corpus, is broadcast, and texts are scored in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import CharGrams, chunks, returning

UNDETERMINED = "und"
#: Languages beyond this number raise: the matrix on the driver is languages x buckets.
MAX_LANGUAGES = 512
#: Characters of text that are hashed at once.
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """``log_likelihood`` is languages x (orders x buckets); ``log_prior`` has a value per language."""

    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray
    orders: tuple[int, ...]
    bits: int


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 14, smoothing: float = 0.1) -> LanguageModel:
    """Count the n-grams of every text whose language is known.

    Rows with a null text or language teach nothing; an empty text counts for the prior alone; repeated rows count each
    time. An empty table gives a model without languages, which answers ``und`` for every text.
    """
    buckets = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        numbers: dict[str, int] = {}
        grams = CharGrams(orders, bits)
        for batch in batches:
            rows = sorted(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()), key=lambda r: r[0])
            for begin, end in chunks([len(t) for _, t in rows], BATCH_CHARS):
                cut = begin
                while cut < end:  # texts of one language together
                    name = rows[cut][0]
                    stop = next((i for i in range(cut, end) if rows[i][0] != name), end)
                    own = totals.setdefault(name, np.zeros(len(orders) * buckets, np.int64))
                    for k, (found, _) in enumerate(grams([t for _, t in rows[cut:stop]])):
                        own[k * buckets : (k + 1) * buckets] += np.bincount(found, minlength=buckets)
                    numbers[name] = numbers.get(name, 0) + stop - cut
                    cut = stop
        for name, own in totals.items():
            at = np.flatnonzero(own)
            at, n = np.append(at, -1), np.append(own[at], numbers[name])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(returning(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r[0] for r in counts.where("bucket = -1").select("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    table = counts.toArrow()  # at most languages x buckets rows
    row = {name: i for i, name in enumerate(names)}
    matrix, prior = np.zeros((len(names), len(orders) * buckets)), np.zeros(len(names))
    lang_at = np.array([row[x] for x in table.column(0).to_pylist()], np.int64)
    bucket_at, n = table.column(1).to_numpy(), table.column(2).to_numpy()
    docs_row = bucket_at == -1
    prior[lang_at[docs_row]] = n[docs_row]
    matrix[lang_at[~docs_row], bucket_at[~docs_row]] = n[~docs_row]
    for k in range(len(orders)):
        part = matrix[:, k * buckets : (k + 1) * buckets]
        part += smoothing
        part /= part.sum(axis=1, keepdims=True)
    return LanguageModel(names, np.log(prior / prior.sum()) if len(names) else prior, np.log(matrix).astype(np.float32), tuple(orders), bits)


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, and its posterior probability; ties go to the first name."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    grams, buckets = CharGrams(model.orders, model.bits), 1 << model.bits
    for begin, end in chunks([len(texts[i]) for i in usable], BATCH_CHARS):
        part = usable[begin:end]
        logs = np.tile(model.log_prior, (len(part), 1))
        for k, (found, starts) in enumerate(grams([texts[i] for i in part])):
            for lang in range(len(model.languages)):
                values = model.log_likelihood[lang, k * buckets : (k + 1) * buckets][found]
                sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                logs[:, lang] += sums[starts[1:]] - sums[starts[:-1]]
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, lang, p in zip(part, best.tolist(), share.tolist()):
            names[i], scores[i] = model.languages[lang], p
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), more: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``keep``, ``more``, then ``lang_pred`` and ``score`` for every row.

    A null text, a text without a letter, and every text under a model without languages is ``und`` with score 0.
    Only the text decides. Rows are answered one by one: repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept goes to the worker once
    own = [] if text in keep else [F.col(text).alias("__text")]
    chosen = docs.select(*own, *keep, *[c.alias(n) for n, c in (more or {}).items()])
    fields, at = chosen.schema.fields[len(own) :], 0 if own else keep.index(text)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score_texts(batch.column(at).to_pylist(), shared.value)
            kept = batch.columns[-len(fields) :]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in fields), "lang_pred", "score"])

    return chosen.mapInArrow(returning(answer), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"]))
