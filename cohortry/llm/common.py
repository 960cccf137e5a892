"""What the operators of this subpackage share: words, folds, shared folders, batches of texts."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import ensure_checkpoint_dir, spread_out

#: A word: a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, over at least as many partitions as there are cores."""
    return spread_out(spark.read.parquet(f"{folder}/{name}.parquet").select(*columns))


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(parts)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path, not used before, in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which grows with the input on a cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory of a worker to the system where its allocators can; reused workers stay as large as they once were."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator


def returning(f):
    """A function from batches to batches whose task gives its memory back when it ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def chunks(sizes, limit: int):
    """Ranges (begin, end) of consecutive items whose sizes add up to ``limit`` at most; one larger item stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


class CharGrams:
    """Hashed character n-grams of many texts at once.

    Each text is lower-cased and gets a space on both sides; the n-grams of one text never reach into the next.
    """

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits = tuple(orders), bits

    def __call__(self, texts: list[str]):
        """Yield, for each order, (buckets, starts): the n-grams of text i are buckets[starts[i]:starts[i + 1]]."""
        framed = [f" {t.lower()} " for t in texts]
        lengths = np.fromiter(map(len, framed), np.int64, len(framed))
        codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        running = np.zeros(len(codes), np.uint32)
        done = 0
        for order in sorted(self.orders):
            for step in range(done, order):
                shifted = running[: max(0, len(codes) - step)]
                shifted *= np.uint32(0x01000193)
                shifted ^= codes[step:]
                shifted *= np.uint32(0x9E3779B1)
            done = order
            mixed = running[: max(0, len(codes) - order + 1)] + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            buckets = (mixed >> np.uint32(32 - self.bits)).astype(np.int32)
            per_text = np.maximum(lengths - order + 1, 0)
            if order > 1 and len(texts):
                inside = np.ones(len(codes), bool)
                for back in range(1, order):
                    at = ends - back
                    inside[at[at >= ends - lengths]] = False
                buckets = buckets[inside[: len(buckets)]]
            yield buckets, np.concatenate([[0], np.cumsum(per_text)])
