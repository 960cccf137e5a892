"""SentencePiece models run by the tokenizers library.

The model file (a protobuf message) is parsed here: pieces with scores and types, the normaliser, and the trainer's choices.
From them a tokenizer is rebuilt: precompiled normalisation, white space as the metaspace marker, merges in score order (BPE)
or unigram scores, and byte fallback for what no piece covers. The normaliser's precompiled rules are used as they are.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import chunks, give_back

SPACE = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Runs of text (white space, then what follows) whose ids an encoder remembers; beyond that it starts anew.
REMEMBERED_RUNS = 200_000
BATCH_CHARS = 1 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_space: bool = False
    rules: bytes = b""


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protobuf message; 32-bit values are floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif wire == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError(f"wire type {wire} in a model file")


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model.pieces.append((piece.get(1, b"").decode(), float(piece.get(2, 0.0)), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind, model.byte_fallback, model.suffix_space = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        elif number == 3:
            norm = dict(fields(value))
            model.rules = norm.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.kind} is not unigram or BPE")
    if model.suffix_space or not model.escape_spaces:
        raise ValueError("white space as a suffix, or not escaped, is not supported")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that form a piece: better scores first, for one piece the pairs in the order of their ids."""
    number = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            pairs = [(number[piece[:k]], number[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in number and piece[k:] in number]
            found += [(-score, number[piece], a, b, left, right) for a, b, left, right in pairs]
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: Model):
    """The same tokenizer in the tokenizers library; text must come with its white space marked."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=merges_of(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    if model.rules:
        tokenizer.normalizer = normalizers.Precompiled(model.rules)
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec:
    """Encodes and decodes with a model file.

    No piece holds white space after another character (checked), so a text is cut before each run of white space without
    changing its ids, and each distinct run of text is encoded once, in batches that the library spreads over threads.
    """

    def __init__(self, path: str, threads: int = 1):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer = rebuild(self.model)
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(inner.search(p) for p, _, _ in self.model.pieces) else None
        self._forget()
        # pieces that stand for themselves may hold white space or depend on their neighbours
        if any(kind == USER_DEFINED for _, _, kind in self.model.pieces):
            self.cut = None
        self.silent = {i for i, p in enumerate(self.model.pieces) if p[2] == CONTROL}
        self.unknown = next((i for i, p in enumerate(self.model.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = np.array([p[2] == BYTE for p in self.model.pieces])

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # of run i: ids[ends[i]:ends[i + 1]]
        self.lost: set[str] = set()

    def normalise(self, text: str) -> str:
        """The text as the model sees it, white space marked."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.model.remove_extra_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if self.model.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [self.normalise(t) for t in texts]
        if self.cut is None:
            return [np.array(e.ids, np.int32) for e in self._batch(marked)]
        out = []
        for begin, end in chunks(list(map(len, marked)), BATCH_CHARS):
            if len(self.number) > REMEMBERED_RUNS:
                self._forget()
            known = len(self.number)
            numbers = [np.fromiter(map(self.number.__getitem__, self.cut.findall(t)), np.int64) for t in marked[begin:end]]
            if len(self.number) > known:
                new = list(itertools.islice(reversed(self.number), len(self.number) - known))[::-1]
                found = [e.ids for e in self._batch(new)]
                self.lost.update(run for run, back in zip(new, self._texts(found)) if back != run.replace(SPACE, " "))
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum()))])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            for at in numbers:
                n = self.ends[at + 1] - self.ends[at]
                out.append(self.ids[np.arange(n.sum()) + np.repeat(self.ends[at] - (np.cumsum(n) - n), n)])
        return out

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def decode(self, ids: list) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become U+FFFD, the marker before the first word goes."""
        spoken = [[int(i) for i in one if int(i) not in self.silent] for one in ids]
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in self._texts(spoken)]

    def _texts(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def restores(self, text: str, ids) -> bool:
        """Whether decoding ``ids``, just encoded from ``text``, gives the normalised text back.

        False where an unknown piece stands for a character. Runs decode on their own, as an encoded run holds whole
        characters: a text comes back if each of its runs did when it was encoded.
        """
        seen = self.normalise(text)
        if self.cut is None:
            return self._texts([[int(i) for i in ids]])[0] == seen.replace(SPACE, " ")
        return not self.lost or self.lost.isdisjoint(self.cut.findall(seen))


@functools.cache
def codec_of(path: str, threads: int) -> Codec:
    """One codec per Python process: tasks that reuse a worker reuse its model and runs."""
    return Codec(path, threads)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", threads: int = 1, with_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, n_bytes (byte pieces), n_unknown, ids_crc32 (ids as little-endian uint32), restored, ids.

    ``path`` is the model file, at the same place on every machine. A null or empty text has no ids and is restored. Whole
    texts are encoded. Repeated rows each get a row. ``threads`` are the library's threads per task; keep it at the
    session's spark.task.cpus. ``ids`` is null unless ``with_ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads)
        try:
            yield from coded(codec, batches)
        finally:  # a reused worker keeps the model, and not the runs of this task
            codec._forget()
            give_back()

    def coded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [n or 0 for n in pc.utf8_length(batch.column(1)).to_pylist()]
            for begin, end in chunks(lengths, BATCH_CHARS):
                part = [t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                ids = codec.encode(part)
                columns = [
                    batch.column(0).slice(begin, end - begin),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(codec.bytes[a].sum()) for a in ids], pa.int64()),
                    pa.array([int((a == codec.unknown).sum()) for a in ids], pa.int64()),
                    pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in ids], pa.int64()),
                    pa.array([codec.restores(t, i) for t, i in zip(part, ids)], pa.bool_()),
                    pa.array([a if with_ids else None for a in ids], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "n_bytes", "n_unknown", "ids_crc32", "restored", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, n_bytes long, n_unknown long, ids_crc32 long, restored boolean, ids array<int>").withColumnRenamed("key", key)
