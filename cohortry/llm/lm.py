"""Language-model scores by deleted interpolation.

A bigram model: maximum-likelihood bigram, unigram and uniform estimates, mixed with weights that depend on how often the
context was seen (buckets of powers of two). The weights are learned by expectation-maximisation on the counts of a
held-out part of the training documents, under estimates from which that part is deleted; the scores then use the counts
of all training documents.

Counts grow with the corpus, so no task or driver holds them all. Documents are cut into chunks of a bounded number of
tokens. A chunk sends its distinct words and word pairs, as packed arrays of 64-bit hashes, to the partitions that own
them; these add up the counts and send back, to each chunk, the totals of its own keys in the same order. One very
frequent word or pair is one key per chunk, whatever its number of occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import chunks as cut_up
from cohortry.llm.common import partitions, stored

BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The end token (no word contains a space); as a context it stands for the start of a document.
END = xxhash.xxh64_intdigest(b" end")
CHUNK_TOKENS = 1 << 21
#: Owners of keys for each shuffle partition: what one of them holds at a time stays small.
OWNERS = 2
#: Tokens that are rated at once.
RATE_TOKENS = 1 << 18
#: Roles of documents: counted; counted and used for the weights; only scored.
COUNTED, WEIGHTS, SCORED = 0, 1, 2
BUCKETS = 24
#: Estimates of held-out tokens are counted in cells of an eighth of an octave; 0 stands for an estimate of zero.
STEPS, CELLS = 8, 8 * 48


@dataclass(frozen=True)
class Weights:
    """mix[b] = (bigram, unigram, uniform) for contexts of bucket b; n_tokens and n_types of the training documents."""

    mix: np.ndarray
    n_tokens: int
    n_types: int


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), the last bucket being open."""
    return np.minimum(np.frexp(context_count.astype(np.float64))[1], BUCKETS - 1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: of small numbers the upper planes vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


class Chunk:
    """Tokens of some documents of one role: numbers into the chunk's own vocabulary of word hashes; 0 is the end token."""

    def __init__(self):
        self.keys, self.lengths, self.parts, self.words, self.size = [], [], [], {}, 0

    def add(self, key, text: str | None) -> None:
        words = BYTE_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z alone
        known = self.words
        ids = np.zeros(len(words) + 1, np.uint32)
        ids[:-1] = [known.get(w) or known.setdefault(w, len(known) + 1) for w in words]
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.parts.append(ids)
        self.size += len(ids)

    def row(self, number: int, role: int) -> pa.RecordBatch:
        vocabulary = np.array([END, *map(xxhash.xxh64_intdigest, self.words)], np.uint64)
        columns = [pa.array([number], pa.int64()), pa.array([role], pa.int32()), pa.array([self.keys], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int64())), pa.array([squeeze(np.concatenate(self.parts))], pa.binary()), pa.array([vocabulary.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "role", "keys", "lengths", "tokens", "vocabulary"])


CHUNK_SCHEMA = "chunk long, role int, keys array<long>, lengths array<long>, tokens binary, vocabulary binary"


def to_chunks(docs: DataFrame, role: Column, key: str, text: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[int, Chunk] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k, t, r in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = open_chunks.setdefault(r, Chunk())
                chunk.add(k, t)
                if chunk.size >= CHUNK_TOKENS:
                    yield open_chunks.pop(r).row(number, r)
                    number += 1
        for r, chunk in open_chunks.items():
            yield chunk.row(number, r)
            number += 1

    return docs.select(F.col(key).cast("long"), F.col(text), role.cast("int")).mapInArrow(cut, CHUNK_SCHEMA)


class Grams:
    """The tokens of a chunk row, its distinct keys (words first, then pairs), and where each token's keys are.

    A word's key is odd, a pair's even. Keys are sent in ascending order; an owner owns a range of them.
    """

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        local, hashes = unsqueeze(row["tokens"], np.uint32), np.frombuffer(row["vocabulary"], np.uint64)
        before = np.zeros(len(local), np.uint32)
        before[1:] = local[:-1]
        before[np.cumsum(self.lengths)[:-1]] = 0  # a document begins after the end token
        pairs = (before.astype(np.uint64) << np.uint64(32)) | local
        distinct, self.pair_at = np.unique(pairs, return_inverse=True)
        self.word_at, self.context_at = local, before
        pair_keys = pair_hash(hashes[(distinct >> np.uint64(32)).astype(np.int64)], hashes[(distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        self.keys = np.concatenate([hashes | np.uint64(1), pair_keys & ~np.uint64(1)])
        self.n_words = len(hashes)
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.word_at, minlength=self.n_words), np.bincount(self.pair_at, minlength=len(self.keys) - self.n_words)])


def count_keys(chunks: DataFrame, owners: int) -> DataFrame:
    """For each chunk and owner: totals of the chunk's keys over the counted documents, and over those of role WEIGHTS.

    Rows with a null chunk carry an owner's numbers of tokens and types.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                grams = Grams(row)
                keys, counts = grams.keys[grams.order], grams.counts()[grams.order].astype(np.uint64)
                owner = ((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
                cut = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
                full = [(o, slice(cut[o], cut[o + 1])) for o in range(owners) if cut[o] < cut[o + 1]]
                columns = [
                    pa.array([o for o, _ in full], pa.int32()),
                    pa.array([row["chunk"]] * len(full), pa.int64()),
                    pa.array([row["role"]] * len(full), pa.int32()),
                    pa.array([squeeze(np.diff(keys[k], prepend=np.uint64(0))) for _, k in full], pa.binary()),
                    pa.array([squeeze(counts[k]) if row["role"] != SCORED else b"" for _, k in full], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "chunk", "role", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if held and held[0]["owner"] != row["owner"]:
                    yield total(held)
                    held = []
                held.append(row)
        if held:
            yield total(held)

    def total(rows: list[dict]) -> pa.RecordBatch:
        parts = [np.cumsum(unsqueeze(r.pop("keys"), np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(p) for p in parts])
        begins = np.concatenate([[0], ends[:-1]])
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        every, part = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        for r, b, e in zip(rows, begins, ends):
            if r["role"] != SCORED:  # a row has each key once
                counts = unsqueeze(r["counts"], np.uint64)
                every[at[b:e]] += counts
                if r["role"] == WEIGHTS:
                    part[at[b:e]] += counts
        is_word = (distinct & np.uint64(1)).astype(bool)
        answers = [(squeeze(every[at[b:e]]), squeeze(part[at[b:e]]) if r["role"] == WEIGHTS else b"") for r, b, e in zip(rows, begins, ends)]
        stats = [int(every[is_word].sum()), int((every[is_word] > 0).sum()), int(part[is_word].sum())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["chunk"] for r in rows] + [None], pa.int64()),
                pa.array([r["role"] for r in rows] + [None], pa.int32()),
                pa.array([r["owner"] for r in rows] + [rows[0]["owner"]], pa.int32()),
                pa.array([a for a, _ in answers] + [b""], pa.binary()),
                pa.array([b for _, b in answers] + [b""], pa.binary()),
                *(pa.array([None] * len(rows) + [x], pa.int64()) for x in stats),
            ],
            ["chunk", "role", "owner", "every", "part", "n_tokens", "n_types", "n_part"],
        )

    asked = chunks.mapInArrow(ask, "owner int, chunk long, role int, keys binary, counts binary")
    return asked.repartition(owners, "owner").sortWithinPartitions("owner", "chunk").mapInArrow(answer, "chunk long, role int, owner int, every binary, part binary, n_tokens long, n_types long, n_part long")


def received(grams: Grams, answers: list[dict], column: str) -> np.ndarray:
    """For each key of a chunk, the total that its owner sent."""
    totals = np.zeros(len(grams.keys), np.int64)
    totals[grams.order] = np.concatenate([unsqueeze(a[column], np.uint64) for a in sorted(answers, key=lambda a: a["owner"])]).astype(np.int64)
    return totals


def together(chunks: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(chunk row, its answers) -> record batch, for every chunk."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([f(row, right.to_pylist()) for row in left.to_pylist()])

    return chunks.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(one, schema)


def learn_weights(chunks: DataFrame, answers: DataFrame, rounds: int = 60) -> Weights:
    """Mixture weights of each bucket, by expectation-maximisation on the held-out counts.

    Held-out tokens are counted by (bucket, cell of the bigram estimate, cell of the unigram estimate), so that what
    reaches the driver is bounded by the number of cells while every held-out token counts.
    """
    n_tokens, n_types, n_part = (x or 0 for x in answers.agg(F.sum("n_tokens"), F.sum("n_types"), F.sum("n_part")).first())
    rest = max(n_tokens - n_part, 1)

    def cell(p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        seen = p > 0
        out[seen] = np.clip(np.round(-np.log2(p[seen]) * STEPS), 0, CELLS - 2) + 1
        return out

    def count(row: dict, sent: list[dict]) -> pa.RecordBatch:
        grams = Grams(row)
        left = received(grams, sent, "every") - received(grams, sent, "part")
        context, word, pair = left[grams.context_at], left[grams.word_at], left[grams.n_words + grams.pair_at]
        at = (bucket_of(context) * CELLS + cell(pair / np.maximum(context, 1))) * CELLS + cell(word / rest)
        found, n = np.unique(at, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    held = together(chunks.where(F.col("role") == WEIGHTS), answers.where(F.col("role") == WEIGHTS), count, "cell long, n long")
    table = held.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS x CELLS x CELLS rows
    cells, n = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.float64)
    size = np.concatenate([[0.0], 2.0 ** (-np.arange(CELLS - 1) / STEPS)])
    estimates = np.stack([size[cells // CELLS % CELLS], size[cells % CELLS], np.full(len(cells), 1 / (n_types + 1))], axis=1)
    return Weights(mixture(cells // CELLS // CELLS, estimates, n, rounds), n_tokens, n_types)


def mixture(bucket: np.ndarray, estimates: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights per bucket that maximise the held-out likelihood; one pseudo-token of each component keeps them positive."""
    mix = np.full((BUCKETS, estimates.shape[1]), 1 / estimates.shape[1])
    for _ in range(rounds):
        share = mix[bucket] * estimates
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        expected = np.ones_like(mix)
        np.add.at(expected, bucket, share)
        mix = expected / expected.sum(axis=1, keepdims=True)
    return mix


def score(docs: DataFrame, train: Column, weigh: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every document under the model learned from the documents where ``train`` holds.

    ``weigh``: which training documents the mixture weights are learned on. Both conditions count a null as false.
    Returns key, held_out (not a training document), n_tokens, n_known, train_tokens, base_score (add-one unigram), score.
    A null or empty text is its end token alone. Rows are documents: repeated rows count and are scored each time. Without
    training documents every estimate but the uniform one is zero, with a single type. An empty table gives no rows.
    """
    role = F.when(~F.coalesce(train, F.lit(False)), SCORED).when(F.coalesce(weigh, F.lit(False)), WEIGHTS).otherwise(COUNTED)
    owners = OWNERS * partitions(docs.sparkSession)
    chunks = stored(to_chunks(docs, role, key, text), "lm-chunks")
    answers = stored(count_keys(chunks, owners), "lm-counts")
    w = learn_weights(chunks, answers)

    def rate(row: dict, sent: list[dict]) -> pa.RecordBatch:
        grams = Grams(row)
        every = received(grams, sent, "every")
        n = len(grams.lengths)
        known, base, model = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        ends = np.cumsum(grams.lengths)
        for first, last in cut_up(grams.lengths.tolist(), RATE_TOKENS):
            begin, end = ends[first] - grams.lengths[first], ends[last - 1]
            context, word, pair = every[grams.context_at[begin:end]], every[grams.word_at[begin:end]], every[grams.n_words + grams.pair_at[begin:end]]
            mix = w.mix[bucket_of(context)]
            p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (word / max(w.n_tokens, 1)) + mix[:, 2] / (w.n_types + 1)
            starts = ends[first:last] - grams.lengths[first:last] - begin
            known[first:last] = np.add.reduceat((word > 0).astype(np.int64), starts)
            base[first:last] = np.add.reduceat(np.log10((word + 1) / (w.n_tokens + w.n_types + 1)), starts)
            model[first:last] = np.add.reduceat(np.log10(p), starts)
        columns = [
            pa.array(row["keys"], pa.int64()),
            pa.array([row["role"] == SCORED] * n, pa.bool_()),
            pa.array(grams.lengths, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array([w.n_tokens] * n, pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(model, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together(chunks, answers, rate, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
