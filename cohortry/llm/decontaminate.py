"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of word characters. A document and a benchmark item that share a window of ``min_match`` tokens
(found by rolling hashes) are compared: the longest match of tokens not yet marked is marked in both, again and again, until
no match of ``min_match`` tokens is left. The share of the item's tokens that is marked is its coverage; as matches may lie
anywhere, passages put in another order are covered too.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import returning

TOKEN = re.compile(r"\w+")
MIN_MATCH = 5
#: Share of an item's tokens from which a document holds the item.
COVERED_FROM = 0.5
#: Characters of items that are sent to the tasks at once; a larger benchmark is worked off in blocks.
BLOCK_CHARS = 8 << 20
FILTER_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` tokens, from a 64-bit code for each token number."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    coded, out = codes[ids], np.zeros(n, np.uint64)
    for k in range(width):
        out *= BASE
        out += coded[k : k + n]
    return out ^ (out >> np.uint64(31))


@dataclass(frozen=True)
class Index:
    """Items of one block: token numbers of each, and their windows sorted by hash."""

    min_match: int
    item_ids: list
    items: list[np.ndarray]
    number: dict[str, int]
    codes: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # windows of distinct hash i: places[starts[i]:starts[i + 1]]
    places: np.ndarray  # (item, offset)
    filter: np.ndarray


def build_index(items: list[tuple], min_match: int) -> Index:
    number: dict[str, int] = {}
    arrays = [np.array([number.setdefault(t, len(number) + 1) for t in tokens(text)], np.int64) for _, text in items]
    codes = np.random.default_rng(17).integers(1, 1 << 63, len(number) + 1, dtype=np.uint64)
    hashes = [rolling(a, codes, min_match) for a in arrays]
    places = [np.stack([np.full(len(h), i), np.arange(len(h))], axis=1) for i, h in enumerate(hashes)]
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(distinct & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return Index(min_match, [i for i, _ in items], arrays, number, codes, distinct, np.append(first, len(every)), np.concatenate([np.zeros((0, 2), np.int64), *places])[order], seen)


def seeds(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, offset in the item, offset in the document) of every shared window."""
    empty = np.zeros(0, np.int64)
    if not len(index.hashes) or len(ids) < index.min_match:
        return empty, empty, empty
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    whole = np.flatnonzero(known[index.min_match :] - known[: -index.min_match] == index.min_match)  # windows without a foreign token
    if not len(whole):
        return empty, empty, empty
    found = rolling(ids, index.codes, index.min_match)[whole]
    maybe = index.filter[(found & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
    whole, found = whole[maybe], found[maybe]
    at = np.minimum(np.searchsorted(index.hashes, found), len(index.hashes) - 1)
    hit = index.hashes[at] == found
    whole, at = whole[hit], at[hit]
    n = index.starts[at + 1] - index.starts[at]
    each = np.repeat(index.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return index.places[each, 0], index.places[each, 1], np.repeat(whole, n)


def tile(item: np.ndarray, doc: np.ndarray, q: np.ndarray, p: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (length, offset in the item, offset in the document) from the shared windows (q, p): longest first, ties by offset.

    Neighbouring windows on a diagonal form a match. A match that a longer one has marked in part is cut to what is left.
    """
    order = np.lexsort((q, p - q))
    q, p = q[order], p[order]
    cut = np.flatnonzero((np.diff(q) != 1) | (np.diff(p) != 1)) + 1
    begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(q)]])
    heap = [(-(int(e - b) + min_match - 1), int(q[b]), int(p[b])) for b, e in zip(begins, ends)]
    heapq.heapify(heap)
    in_item, in_doc, tiles = np.zeros(len(item), bool), set(), []
    free_left = len(item)
    while heap and free_left >= min_match:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~in_item[a : a + n]
        if in_doc and free.any():
            free &= np.fromiter((x not in in_doc for x in range(b, b + n)), bool, n)
        if free.all():
            if (item[a : a + n] != doc[b : b + n]).any():  # hashes met by chance
                continue
            in_item[a : a + n] = True
            in_doc.update(range(b, b + n))
            free_left -= n
            tiles.append((n, a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= min_match:
                heapq.heappush(heap, (-(e - s), a + s, b + s))
    return tiles


def compare(text: str | None, index: Index) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(item number, tiles) of each item that shares a window with the text."""
    ids = np.array([index.number.get(t, 0) for t in tokens(text)], np.int64)
    item, q, p = seeds(ids, index)
    if not len(item):
        return []
    order = np.argsort(item, kind="stable")
    item, q, p = item[order], q[order], p[order]
    cut = np.flatnonzero(np.diff(item)) + 1
    out = []
    for b, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(item)]])):
        own = index.items[item[b]]
        tiles = tile(own, ids, q[b:e], p[b:e], index.min_match)
        if tiles:
            out.append((int(item[b]), tiles))
    return out


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct item (as tokens), under the lowest key; null and empty items are none."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(tokens(t)) for t in batch.column(1).to_pylist()], pa.string())], ["item_id", "text"])

    rows = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(normalise, "item_id long, text string").where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))


def blocks_of(benchmark: DataFrame, min_match: int, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark's items, block by block; a block has about ``block_chars`` characters."""
    items = items_of(benchmark)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()  # about block_chars
        yield build_index(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows), min_match)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", min_match: int = MIN_MATCH, covered_from: float = COVERED_FROM) -> DataFrame:
    """Pairs (document, item) with coverage of at least ``covered_from``: key, item_id, n_item_tokens, n_covered, coverage, n_tiles, longest.

    Items that are alike as tokens are one item, under the lowest item_id (-1 if that is null). A null or empty text holds
    no item, an item of fewer than ``min_match`` tokens is held by none. Repeated documents each get their rows. An empty
    table on either side gives no rows. Whole texts are compared.
    """
    out, names = None, ["key", "item_id", "n_item_tokens", "n_covered", "coverage", "n_tiles", "longest"]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item_id long, n_item_tokens long, n_covered long, coverage double, n_tiles long, longest long"

    def searcher(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at, found = [], []
                for row, value in enumerate(batch.column(1)):
                    for item, tiles in compare(value.as_py(), index):
                        n, covered = len(index.items[item]), sum(t[0] for t in tiles)
                        if covered >= covered_from * n:
                            at.append(row)
                            found.append((index.item_ids[item], n, covered, covered / n, len(tiles), max(t[0] for t in tiles)))
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([f[k] for f in found], kind) for k, kind in zip(range(6), [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]))], names)

        return search

    for index in blocks_of(benchmark, min_match):
        part = rows.mapInArrow(searcher(docs.sparkSession.sparkContext.broadcast(index)), schema)
        out = part if out is None else out.unionAll(part)
    return (out if out is not None else docs.sparkSession.createDataFrame([], schema)).withColumnRenamed("key", key)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_match: int = MIN_MATCH, covered_from: float = COVERED_FROM) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item; cases as in ``find``."""

    def filterer(shared, at: int):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = [not any(sum(t[0] for t in tiles) >= covered_from * len(index.items[item]) for item, tiles in compare(value.as_py(), index)) for value in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return keep

    for index in blocks_of(benchmark, min_match):
        docs = docs.mapInArrow(returning(filterer(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text))), docs.schema)
    return docs
