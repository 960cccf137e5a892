"""Connected components of a large graph, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: every node is linked to the lowest one that it hangs together with there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root[x] for x in nodes], pa.int64())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every node that has an edge to another one, and the lowest id of its component.

    Links that meet in one partition become stars at once. Then a node's neighbours are linked to the lowest of them (first
    those above the node, then those below), until nothing changes; the rounds grow with the logarithm of the graph.
    Minima are pre-aggregated, so that a hub costs no more.
    """
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).mapInArrow(_contract, "u long, v long").distinct()
    links, before = stored(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = stored(small.distinct(), "links")
