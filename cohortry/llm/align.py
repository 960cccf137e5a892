"""Alignment of two tokenizers over the bytes of their tokens.

Tokenizer A is a byte-level BPE (tokenizers library), B a SentencePiece model with byte fallback. Both cut a space and the text
into tokens; the byte offsets at which a token of A and one of B end together cut the tokens into groups, and a token of A is
linked with each token of B that shares a byte with it.

Diagonal run skipping: where A's token i and B's token j begin together, the arrays of their ends are compared at the shift
j - i. As long as they are equal, tokens are one to one, and the compared length doubles; a stretch that is not equal ends at
its first difference. There the tokens on both sides up to the next common end form one irregular group, found locally, and the
shift is updated. Texts are cut before spaces that no token of either side crosses, so each distinct run of text is encoded and
aligned once per task; the documents are put together from their runs.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import chunks, stored

SPACE = "▁"
#: Characters of text that are aligned at once; their documents share one list of pairs.
CHUNK_CHARS = 1 << 21
#: Runs of text that an aligner remembers before it starts anew.
REMEMBERED_RUNS = 400_000
#: Before a space behind something else than white space. U+180E was white space once.
CUT = re.compile("(?<=[^\\s᠎])(?= )")
#: White space other than a space, before a space.
MIXED = re.compile("[^\\S ] |᠎ ")
#: Latin letters and the ASCII punctuation behind them: two words to A's first cut (an apostrophe may begin one of letters).
LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\\[-`{-~]*)")
#: First length that is compared at a new shift.
FIRST_PROBE = 4
HEX = re.compile("<0x([0-9A-F]{2})>")


def one_to_one(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Groups of two lists of ends as (first of a, first of b, tokens of a, tokens of b), stretches of one to one as (i, j, n, -1).

    Both lists ascend and end alike.
    """
    i = j = 0
    n = len(a)
    while i < n:
        begin, step = i, FIRST_PROBE
        while i < n and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, step * 2
        if i < n:
            while a[i] == b[j]:  # the first difference lies in the last stretch
                i, j = i + 1, j + 1
        else:
            i, j = n, len(b)
        if i > begin:
            yield begin, j - (i - begin), i - begin, -1
        if i < n:  # the next common end
            x, y = i, j
            while (p := a[x]) != (q := b[y]):
                if p < q:
                    x += 1
                else:
                    y += 1
            yield i, j, x + 1 - i, y + 1 - j
            i, j = x + 1, y + 1


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Encodes texts on both sides and aligns them, each distinct run of text once."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.spelt = {b: c for c, b in letters.items()}
        self.marks: dict[str, list[int]] = {"": []}  # ids of punctuation
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            known = all(c in letters for c in piece)
            self.bytes_a[i] = bytes(letters[c] for c in piece) if known else piece.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            code = HEX.fullmatch(piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(code[1], 16)]) if code else piece.replace(SPACE, " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.wide_b = len(self.bytes_b)
        self.shown = [str(i) for i in range(max(len(self.bytes_a), self.wide_b))]
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in map(self.b.id_to_piece, range(self.wide_b)))
        self.space = self.b.piece_to_id(SPACE)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict()  # of a run, by what follows its first space
        self.number.default_factory = self.number.__len__
        self.counts = np.zeros((0, 4), np.int64)  # of a run: tokens of a, of b, groups, links
        self.texts: list[bytes] = []  # its groups as text
        self.good = np.zeros(0, bool)
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)  # links of run i: pairs[ends[i]:ends[i + 1]]

    def _encode_a(self, keys: list[str]) -> list[list[int]]:
        """Ids of runs, given without their space; those of letters and punctuation go to the model at once."""
        out, others, spelt, model, marks = [], [], self.spelt, self.a.model, self.marks
        for i, key in enumerate(keys):
            found = LETTERS.fullmatch(key)
            if found is None:
                others.append(i)
                out.append([])
                continue
            word, mark = found.groups()
            if mark not in marks:
                marks[mark] = self.a.encode(mark, add_special_tokens=False).ids
            out.append([t.id for t in model.tokenize((" " + word).encode().decode("latin-1").translate(spelt))] + marks[mark])
        for i, e in zip(others, self.a.encode_batch_fast([" " + keys[i] for i in others], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _encode_b(self, keys: list[str]) -> list[list[int]]:
        # the model puts a space before what it is given, unless that is empty
        found = self.b.encode(keys, num_threads=1)
        return [ids or [self.space] for ids in found]

    def _runs(self, text: str) -> list[str]:
        """The runs of a space and the text, each without its first character, which is a space."""
        if not text:
            return []
        if not self.cut:
            return [text]
        if "  " not in text and text[0] != " " and not MIXED.search(text):
            return text.split(" ")
        return [r[1:] for r in CUT.split(" " + text)]

    def _good(self, runs: list[str], flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which runs both sides give back byte by byte; most often all, which one comparison tells."""
        whole = [r.encode() for r in runs]
        length = np.fromiter(map(len, whole), np.int64, len(whole))
        every, good = b"".join(whole), np.ones(len(runs), bool)
        for side, size, flat, n in ((self.bytes_a, self.size_a, flat_a, n_a), (self.bytes_b, self.size_b, flat_b, n_b)):
            own = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum(n)])]
            if (np.diff(own) == length).all() and b"".join(map(side.__getitem__, flat.tolist())) == every:
                continue
            edges = np.concatenate([[0], np.cumsum(n)]).tolist()
            ids = flat.tolist()
            good &= np.fromiter((b"".join([side[i] for i in ids[x:y]]) == w for x, y, w in zip(edges, edges[1:], whole)), bool, len(runs))
        return good

    def _learn(self, keys: list[str]) -> None:
        """Encode and align new runs, all in one pair of arrays."""
        runs = [" " + k for k in keys]
        ids_a, ids_b = self._encode_a(keys), self._encode_b(keys)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(runs)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        good = self._good(runs, flat_a, flat_b, n_a, n_b)
        if not good.all():
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            flat_a, flat_b = flat_a[keep_a], flat_b[keep_b]
            n_a, n_b = n_a * good, n_b * good
        left, right = (np.cumsum(size[x]) for size, x in ((self.size_a, flat_a), (self.size_b, flat_b)))

        # groups as first token of each side
        first_a, first_b = [], []
        for i, j, n, m in one_to_one(left.tolist(), right.tolist()):
            if m < 0:
                first_a.extend(range(i, i + n))
                first_b.extend(range(j, j + n))
            else:
                first_a.append(i)
                first_b.append(j)
        before = np.searchsorted(np.array(first_a, np.int64), np.concatenate([[0], np.cumsum(n_a)]))
        n_groups = np.diff(before)

        # links: each token of a meets the tokens of b from the one that holds its first byte to the one that holds its last
        start = left - self.size_a[flat_a]
        low, high = np.searchsorted(right, start, "right"), np.searchsorted(right, left, "left")
        width = high - low + 1
        owner = np.repeat(np.arange(len(flat_a)), width)
        other = np.arange(int(width.sum())) + np.repeat(low - (np.cumsum(width) - width), width)
        links = flat_a[owner] * self.wide_b + flat_b[other]
        upto = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(n_a)])]

        names_a, names_b = ([self.shown[i] for i in x.tolist()] for x in (flat_a, flat_b))
        last_a, last_b = [*first_a[1:], len(names_a)], [*first_b[1:], len(names_b)]
        shown = [f"{','.join(names_a[i:k])}|{','.join(names_b[j:l])}" if k - i > 1 or l - j > 1 else f"{names_a[i]}|{names_b[j]}" for i, j, k, l in zip(first_a, first_b, last_a, last_b)]
        cut = before.tolist()
        self.texts += [";".join(shown[x:y]).encode() for x, y in zip(cut, cut[1:])]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, np.diff(upto)], axis=1)])
        self.good = np.concatenate([self.good, good])
        self.pairs = np.concatenate([self.pairs, links])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto[1:]])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts (tokens of a, of b, groups, links) and hash of the groups of each text; links of all texts, and how many each has."""
        if len(self.number) > REMEMBERED_RUNS:
            self._forget()
        known = len(self.number)
        runs = [self._runs(t) for t in texts]
        at = [np.fromiter(map(self.number.__getitem__, r), np.int64, len(r)) for r in runs]
        if len(self.number) > known:
            new = list(itertools.islice(reversed(self.number), len(self.number) - known))[::-1]
            gc.disable()  # some hundred thousand lists of ids, none in a cycle
            try:
                self._learn(new)
            finally:
                gc.enable()
        at = [x if self.good[x].all() else np.zeros(0, np.int64) for x in at]
        counts = np.array([self.counts[x].sum(axis=0) for x in at], np.int64).reshape(-1, 4)
        shown = self.texts
        hashes = [hashlib.sha256(b";".join([shown[i] for i in x.tolist()])).hexdigest() if len(x) else "" for x in at]
        every = np.concatenate(at) if at else np.zeros(0, np.int64)
        n = self.ends[every + 1] - self.ends[every]
        links = self.pairs[np.arange(int(n.sum())) + np.repeat(self.ends[every] - (np.cumsum(n) - n), n)]
        return counts, hashes, links, counts[:, 3]


@functools.cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python process: tasks that reuse a worker reuse its vocabularies."""
    return Aligner(path_a, path_b)


DOC = "struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, pairs: binary, times: binary>"


def _rows_of(docs: list, pairs: np.ndarray, holds: np.ndarray, chunk: int, wide_b: int, doc_type: pa.DataType, pair_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, then its pairs; both in the order of their numbers."""
    names = ["chunk", "doc", "pair"]
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(docs), pa.int64()), pa.array(docs, doc_type), pa.nulls(len(docs), pair_type)], names)
    if len(pairs):
        made = pa.StructArray.from_arrays([pa.array(np.arange(len(pairs)), pa.int32()), pa.array(pairs // wide_b, pa.int32()), pa.array(pairs % wide_b, pa.int32()), pa.array(holds, pa.int64())], fields=list(pair_type))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk), pa.int64()), pa.nulls(len(pairs), doc_type), made], names)


PAIR = "struct<at: int, a: int, b: int, n: long>"
PAIR_TYPE = pa.struct([("at", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair of ids counts once for each document in which they are linked; n_best are the links whose pair has the highest count
    of all pairs with that id of A, count_sum is the sum of counts over the links. groups_sha256 is of ``a1,a2|b1;a3|b2,b3``.
    A null or empty text, and one whose tokens on either side do not give its bytes back, has no tokens: zeros, and an empty
    text for the hash. Strings of special tokens are plain text. Repeated rows each count. Whole texts are aligned, however
    long; other columns are left out; an empty table gives no rows.

    Documents are aligned once, in chunks of ``chunk_chars`` characters (a longer one stands alone). A chunk keeps its links as
    numbers into its own list of distinct pairs, which goes through the shuffle with the number of documents that hold each:
    a pair that is everywhere is one row per chunk, and what comes back to a chunk is no more than it sent.
    """
    kind = docs.select(key).schema[key].dataType.simpleString()
    doc_type = pa.struct([("key", pa.int64() if kind == "bigint" else pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
    if kind not in ("bigint", "string"):
        raise ValueError("the key must be a long or a string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, seq = aligner_of(path_a, path_b), TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = [n or 0 for n in pc.utf8_length(batch.column(1)).to_pylist()]
            for begin, end in chunks(lengths, chunk_chars):
                keys = batch.column(0).slice(begin, end - begin).to_pylist()
                counts, hashes, links, n = aligner([t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()])
                distinct, number = np.unique(links, return_inverse=True)
                owner = np.repeat(np.arange(len(keys)), n)
                held, times = np.unique(owner * max(1, len(distinct)) + number, return_counts=True)
                of, at = np.divmod(held, max(1, len(distinct)))
                edges = np.searchsorted(of, np.arange(len(keys) + 1)).tolist()
                at, times = at.astype("<i4"), times.astype("<i4")
                found = [
                    {"key": k, "n_a": a, "n_b": b, "n_groups": g, "n_links": m, "groups_sha256": h, "pairs": at[x:y].tobytes(), "times": times[x:y].tobytes()}
                    for k, (a, b, g, m), h, x, y in zip(keys, counts.tolist(), hashes, edges, edges[1:])
                ]
                yield from _rows_of(found, distinct, np.bincount(at, minlength=len(distinct)), part << 32 | seq, aligner.wide_b, doc_type, PAIR_TYPE)
                seq += 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(cut, f"chunk long, doc {DOC.format(kind=kind)}, pair {PAIR}"), "aligned")
    pairs = found.where("pair IS NOT NULL").select("chunk", "pair.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("top"))
    rated = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    back = pairs.select("chunk", "at", "a", "b").join(rated, ["a", "b"]).select(F.col("chunk").alias("of"), "at", "count", "best")

    def sum_up(mine: pa.Table, known: pa.Table) -> pa.Table:
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        at = known["at"].to_numpy()
        count[at], best[at] = known["count"].to_numpy(), known["best"].to_numpy().astype(np.int64)
        held = [(np.frombuffer(p, "<i4"), np.frombuffer(t, "<i4").astype(np.int64)) for p, t in zip(mine["pairs"].to_pylist(), mine["times"].to_pylist())]
        names = ["key", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table({**{c: mine[c] for c in names}, "n_best": pa.array([int(t @ best[p]) for p, t in held], pa.int64()), "count_sum": pa.array([int(t @ count[p]) for p, t in held], pa.int64()), "groups_sha256": mine["groups_sha256"]})

    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    mine = found.where("doc IS NOT NULL").select("chunk", "doc.*")
    return mine.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(sum_up, schema).withColumnRenamed("key", key)
