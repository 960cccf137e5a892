"""Token ids in fixed-width binary files.

A file holds the ids of a run of documents, each id in the minimum number of bits for the vocabulary, in blocks of a fixed
number of ids. Layout, all numbers little-endian:

    magic "FWTB0001"
    blocks: BLOCK_IDS ids each (the last may have fewer), `width` bits per id, most significant bit first, zero-padded to a byte
    footer: n_blocks + 1 block offsets (uint64, from the start of the file)
            n_docs + 1 positions of documents in the file's id stream (uint64)
            n_docs keys (int64), n_docs flags (uint8; 1: the key is null)
    tail: width (uint32), block_ids (uint32), n_ids (uint64), n_docs (uint64), footer position (uint64), magic

Any id can be read by its position: block = position // block_ids, then one offset look-up and one vectorised unpacking.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import chunks, new_folder, stored

MAGIC = b"FWTB0001"
TAIL = struct.Struct("<IIQQQ8s")
BLOCK_IDS = 1 << 14
#: Words whose ids an encoder remembers before it starts anew, and characters of text that it takes at once.
REMEMBERED_WORDS = 1_200_000
BATCH_CHARS = 1 << 20


def bit_width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """(id, byte, shift): where the bits of 8 consecutive ids lie in the ``width`` bytes that hold them."""
    for k in range(8):
        for byte in range(k * width // 8, (k * width + width - 1) // 8 + 1):
            yield k, byte, (k + 1) * width - 8 * (byte + 1)


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive groups of ``width`` bits; 8 ids at a time fill ``width`` bytes."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint32)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), np.uint8)
    for k, byte, shift in _lanes(width):
        out[:, byte] |= (lanes[:, k] >> shift if shift >= 0 else lanes[:, k] << -shift).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    rows = np.zeros((-(-n // 8), width), np.uint8)
    rows.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    lanes = np.zeros((len(rows), 8), np.uint32)
    for k, byte, shift in _lanes(width):
        part = rows[:, byte].astype(np.uint32)
        lanes[:, k] |= part << shift if shift >= 0 else part >> -shift
    return lanes.reshape(-1)[:n] & np.uint32((1 << width) - 1)


class Writer:
    """Appends documents to one file; only one block of ids is held."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS):
        self.sink, self.width, self.block_ids = sink, width, block_ids
        self.pending, self.held = [], 0
        self.offsets, self.positions, self.keys, self.nulls = [len(MAGIC)], [0], [], bytearray()
        sink.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and (int(ids.max()) >> self.width or int(ids.min()) < 0):
            raise ValueError(f"an id needs more than {self.width} bits")
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.positions.append(self.positions[-1] + len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            rest = np.concatenate(self.pending)
            while len(rest) >= self.block_ids:
                self._block(rest[: self.block_ids])
                rest = rest[self.block_ids :]
            self.pending, self.held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> int:
        """Write the footer; returns the number of ids."""
        if self.held:
            self._block(np.concatenate(self.pending))
        at = self.offsets[-1]
        for values, kind in ((self.offsets, "<u8"), (self.positions, "<u8"), (self.keys, "<i8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(bytes(self.nulls))
        self.sink.write(TAIL.pack(self.width, self.block_ids, self.positions[-1], len(self.keys), at, MAGIC))
        return self.positions[-1]


class Reader:
    """Random access to one file: ``ids(begin, end)`` reads only the blocks that hold them."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < TAIL.size + len(MAGIC):
            raise ValueError("not a token file")
        self.width, self.block_ids, self.n_ids, n_docs, at, magic = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        footer = self._bytes(at, size - TAIL.size - at)
        n_blocks = -(-self.n_ids // self.block_ids)
        cut = np.cumsum([0, 8 * (n_blocks + 1), 8 * (n_docs + 1), 8 * n_docs, n_docs])
        self.offsets, self.positions = (np.frombuffer(footer[a:b], "<u8").astype(np.int64) for a, b in zip(cut[:2], cut[1:3]))
        self.keys, self.nulls = np.frombuffer(footer[cut[2] : cut[3]], "<i8"), np.frombuffer(footer[cut[3] : cut[4]], np.uint8)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        data = self._bytes(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        parts, base = [], self.offsets[first]
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(data[self.offsets[b] - base : self.offsets[b + 1] - base], n, self.width))
        return np.concatenate(parts)[begin - first * self.block_ids : end - first * self.block_ids]

    def documents(self, batch_ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, position, ids) of every document in order; about ``batch_ids`` ids are unpacked at once."""
        i = 0
        while i < len(self.keys):
            j = max(i + 1, int(np.searchsorted(self.positions, self.positions[i] + batch_ids, "right")) - 1)
            begin = int(self.positions[i])
            held = self.ids(begin, int(self.positions[j]))
            for k in range(i, j):
                yield None if self.nulls[k] else int(self.keys[k]), int(self.positions[k]), held[self.positions[k] - begin : self.positions[k + 1] - begin]
            i = j


#: A word of Latin letters, and the ASCII punctuation behind it: tokens never cross that border (an apostrophe may begin one).
#: Not U+0130, which ends in a combining dot in lower case; the dot would belong to the punctuation.
LETTERS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Encodes texts with the lower-casing word vocabulary, each distinct word once.

    The tokenizer drops white space between words, so the ids of a text are those of its words in turn. A word of letters
    with punctuation behind it is two pieces to the tokenizer, and one in plain lower case goes to its model at once.
    Words are remembered up to a number, then all forgotten; that bounds memory and never changes ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.parts: dict[str, list[int]] = {"": []}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # of word i: ids[ends[i]:ends[i + 1]]

    def _encode(self, words: list[str]) -> list[list[int]]:
        cut = [(m[1].lower() if m[1].isascii() else m[1], m[2]) if (m := LETTERS.fullmatch(w)) else (w, "") for w in words]
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(cut)) if p not in self.parts]
        plain = [p for p in new if p.isascii() and p.isalpha()]
        self.parts.update((p, [t.id for t in self.tokenizer.model.tokenize(p)]) for p in plain)
        others = [p for p in new if p not in self.parts]
        self.parts.update(zip(others, (e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False))))
        return [self.parts[a] + self.parts[b] for a, b in cut]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED_WORDS:
            self._forget()
        known = len(self.number)
        # of bytes, split() parts at ASCII white space alone
        numbers = [np.fromiter(map(self.number.__getitem__, t.encode("utf-8", "surrogatepass").split()), np.int64) for t in texts]
        if len(self.number) > known:
            new = [w.decode("utf-8", "surrogatepass") for w in itertools.islice(reversed(self.number), len(self.number) - known)][::-1]
            gc.disable()  # many short lists, none in a cycle
            try:
                found = self._encode(new)
            finally:
                gc.enable()
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        out = []
        for at in numbers:
            n = self.ends[at + 1] - self.ends[at]
            out.append(self.ids[np.arange(n.sum()) + np.repeat(self.ends[at] - (np.cumsum(n) - n), n)])
        return out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python process: tasks that reuse a worker reuse its words."""
    return WordEncoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_token_files(docs: DataFrame, make_encoder: Callable, vocabulary: int, end_id: int | None = None, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every document and write the ids in ascending order of ``key``; returns the manifest.

    ``make_encoder()`` is called in each task and gives a function from texts to arrays of ids. Rows are split by ranges of
    (key, hash of the text), so that a key with many rows is split too; a null key comes first, a null text is empty,
    rows that are alike stay as often as they come. Manifest: shard, path, n_docs, n_ids, first (ids in all earlier
    shards). Only files in the manifest count: a task that is run again writes another file. An empty table gives an
    empty manifest.
    """
    folder = folder or new_folder(docs.sparkSession, "token-files")
    width = bit_width(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        shard, path, writer, sink, encode, n = TaskContext.get().partitionId(), "", None, None, None, 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if writer is None and keys:
                store.create_dir(root, recursive=True)
                path = f"{root}/{shard:06d}-{uuid.uuid4().hex}.fwtb"
                encode, sink = make_encoder(), store.open_output_stream(path)
                writer = Writer(sink, width)
            for begin, end in chunks([len(t or "") for t in texts], BATCH_CHARS):
                for k, ids in zip(keys[begin:end], encode([t or "" for t in texts[begin:end]])):
                    writer.add(k, ids if end_id is None else np.append(ids, np.uint32(end_id)))
                    n += 1
        if writer is not None:
            total = writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    split = F.xxhash64("text").alias("split")
    ordered = rows.select("*", split).repartitionByRange(F.asc_nulls_first("key"), "split").sortWithinPartitions(F.asc_nulls_first("key"), "split", "text")
    manifest = stored(ordered.select("key", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"), F.lit(folder).alias("folder"))


def read_token_files(manifest: DataFrame, tasks: int, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (uint32, little-endian; null without ``with_ids``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, first, folder in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "folder"))):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for key, at, ids in Reader(source).documents():
                        data = ids.astype("<u4").tobytes()
                        rows.append((key, first + at, len(ids), zlib.crc32(data), data if with_ids else None))
                        held += 40 + with_ids * len(data)
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = manifest.select("shard", "path", "first", "folder").repartition(tasks, "shard")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
