"""Summing the partial results of tasks: fixed-size float arrays, moved as raw bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

PART_SCHEMA = "b long, v binary"
PART_ROWS = 32
BLOB_ROWS = 2_048  # rows of a packed block
COLLECT_BYTES = 256 << 20  # above this the partial arrays are summed by tasks, not by the driver


def matrix_parts(total: np.ndarray, touched: np.ndarray | None = None):
    """The (touched) row blocks of a task's partial matrix."""
    rows = np.arange(len(total)) if touched is None else np.flatnonzero(touched)
    hit = np.unique(rows // PART_ROWS)
    for at in range(0, len(hit), 256):
        some = hit[at : at + 256]
        yield pd.DataFrame({"b": some, "v": [total[x * PART_ROWS : (x + 1) * PART_ROWS].tobytes() for x in some]})


def summed_rows(parts: DataFrame, n: int, width: int, tasks: int | None = None) -> np.ndarray:
    """Sum partial matrices block by block into one n x width matrix.

    Each receiving task streams the blocks it owns into one accumulator.  With
    ``tasks`` given and little to move, the driver sums the parts directly.
    """
    total = np.zeros((n, width))
    source = parts
    if tasks is None or tasks * n * width * 8 > COLLECT_BYTES:

        def combine(batches):
            held: dict[int, np.ndarray] = {}
            for pdf in batches:
                for b, v in zip(pdf["b"], pdf["v"]):
                    block = np.frombuffer(v, dtype=float)
                    if b in held:
                        held[b] += block
                    else:
                        held[b] = block.copy()
            for b, block in held.items():
                yield pd.DataFrame({"b": [b], "v": [block.tobytes()]})

        source = parts.repartition("b").mapInPandas(combine, PART_SCHEMA)
    for row in source.collect():
        block = np.frombuffer(row["v"], dtype=float).reshape(-1, width)
        total[row["b"] * PART_ROWS : row["b"] * PART_ROWS + len(block)] += block
    return total


def spread_blocks(packed: DataFrame) -> tuple[DataFrame, int]:
    """The packed blocks kept, on every core where there are enough of them, and their number."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    blobs, tasks = packed.count(), packed.rdd.getNumPartitions()
    if tasks < cores and blobs > tasks:  # small inputs arrive in few partitions
        few, packed = packed, packed.repartition(min(blobs, cores)).persist(StorageLevel.MEMORY_AND_DISK)
        packed.count()
        few.unpersist()
    return packed, blobs


def blocks_of(packed: DataFrame, *columns: str) -> RDD:
    """The packed blocks for passes that differ in their function alone, so that none plans a query.

    There are no more tasks than cores: each streams its blocks into one partial matrix, and what reaches the driver in a pass does
    not grow with the rows.
    """
    blocks = packed.select(*columns).rdd
    return blocks.coalesce(min(blocks.getNumPartitions(), packed.sparkSession.sparkContext.defaultParallelism))


def kept_blocks(packed: DataFrame, *columns: str) -> RDD:
    """The blocks of many passes, kept as dicts, so that a pass converts no rows; to be unpersisted after the last one."""
    return blocks_of(packed, *columns).map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def summed_blocks(blocks: RDD, add: Callable, n: int, width: int) -> np.ndarray:
    """The n x width matrix to which ``add(total, block)`` adds every block; by the driver if little moves, else by tasks first."""

    def one(part):
        total = np.zeros((n, width))
        for block in part:
            add(total, block)
        return total

    def whole(part):
        yield one(part)

    def rows(part):
        total = one(part)
        for b in range(0, n, PART_ROWS):
            yield b, total[b : b + PART_ROWS]

    total = np.zeros((n, width))
    if blocks.getNumPartitions() * n * width * 8 <= COLLECT_BYTES:
        for some in blocks.mapPartitions(whole).collect():
            total += some
    else:
        for b, some in blocks.mapPartitions(rows).reduceByKey(np.add, blocks.getNumPartitions()).collect():
            total[b : b + PART_ROWS] = some
    return total
