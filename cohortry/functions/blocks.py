"""Every point of one table against every point of another, block by block.

Both sides are cut into blocks of bounded size, one row each, and dealt to a grid of tasks: a task holds a group of left blocks
and reads a slice of the right blocks one after another, folding the results of each left block as it goes. So a table is moved
once for each group or slice of the other side, whose number follows the cores until a group outgrows its bound in bytes, and one
result per left block and slice leaves the tasks. Nothing passes the driver, and the number of jobs does not grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.vectors import dimension, matrix_of

BLOCK_ROWS = 2_048
TASKS_PER_CORE = 3
GROUP_BYTES = 64 << 20  # points of the left blocks that a task holds


def _packed(rows: DataFrame, block: str, n_blocks: int) -> DataFrame:
    """One row per block: its number, and the columns of its rows as arrays (features as one array of doubles)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    others = [c for c in rows.columns if c != "features"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({block: [pdf[block].iloc[0]], **{c: [pdf[c].tolist()] for c in others}, "x": [matrix_of(pdf).tobytes()]})

    numbered = rows.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    schema = ", ".join([f"{block} int", *(f"`{c}` array<{kinds[c]}>" for c in others), "x binary"])
    return numbered.groupBy(block).applyInPandas(pack, schema)


def _packed_in_order(rows: DataFrame, block: str, n_blocks: int, block_rows: int, order: list) -> DataFrame:
    """Blocks as in :func:`_packed`, cut from the rows in the order of some columns, so that rows alike lie in one block."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    others = [c for c in rows.columns if c != "features"]

    def pack(batches):
        number = TaskContext.get().partitionId()
        for pdf in batches:
            for at in range(0, len(pdf), block_rows):
                part = pdf.iloc[at : at + block_rows]
                yield pd.DataFrame({block: [number], **{c: [part[c].tolist()] for c in others}, "x": [matrix_of(part).tobytes()]})
                number += 1

    by = [*order, F.xxhash64("id")]  # rows alike are many, and go to several partitions
    dealt = rows.repartitionByRange(min(n_blocks, rows.sparkSession.sparkContext.defaultParallelism), *by).sortWithinPartitions(*by)
    schema = ", ".join([f"{block} int", *(f"`{c}` array<{kinds[c]}>" for c in others), "x binary"])
    return dealt.mapInPandas(pack, schema)


def _grid(n_left: int, n_right: int, group_blocks: int, cores: int) -> tuple[int, int]:
    """Groups of left blocks and slices of right blocks: some tasks per core, and no more blocks in a group than it may hold."""
    tasks = TASKS_PER_CORE * cores
    groups = min(n_left, max(tasks, -(-n_left // group_blocks)))
    return groups, min(n_right, max(1, tasks // groups))


def block_pairs(
    left: DataFrame, right: DataFrame, compare: Callable[[dict, dict, object], object], finish: Callable[[dict, object], pd.DataFrame], schema: str,
    block_rows: int | None = None, order: list | None = None,
) -> DataFrame:
    """``finish(left block, state)`` for every left block and slice of the right side, as one table.

    ``compare(left block, right block, state)`` gives the next state of the left block, which is None at first. Both tables have
    ``id`` and ``features``; a block is a dict of the table's columns as lists, and ``x``, its points as a matrix. What ``compare``
    adds to a block stays there while the block is held. ``order`` has columns of the right rows in whose order they are cut.
    """
    block_rows = block_rows or BLOCK_ROWS
    sizes = left.agg(F.count("*")).first()[0], right.agg(F.count("*")).first()[0]
    n_left, n_right = (max(1, -(-n // block_rows)) for n in sizes)
    group_blocks = max(1, GROUP_BYTES // max(1, 8 * block_rows * dimension(left)))
    groups, slices = _grid(n_left, n_right, group_blocks, left.sparkSession.sparkContext.defaultParallelism)
    a = _packed(left, "_a", n_left)
    b = _packed_in_order(right, "_b", n_right, block_rows, order) if order else _packed(right, "_b", n_right)
    to_slices, to_groups = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    a = a.withColumn("_to", to_slices).withColumn("_cell", F.pmod("_a", F.lit(groups)) * slices + F.col("_to")).drop("_a", "_to")
    b = b.withColumn("_to", to_groups).withColumn("_cell", F.col("_to") * slices + F.pmod("_b", F.lit(slices))).drop("_b", "_to")
    a = a.withColumnsRenamed({c: f"l_{c}" for c in a.columns if c != "_cell"}).withColumn("_side", F.lit(0))
    b = b.withColumnsRenamed({c: f"r_{c}" for c in b.columns if c != "_cell"}).withColumn("_side", F.lit(1))
    cells = a.unionByName(b, allowMissingColumns=True).repartitionById(groups * slices, F.col("_cell").cast("int")).sortWithinPartitions("_side")

    def run(batches):
        held: list[list] = []  # a group's blocks and their states; they come before the slice
        for pdf in batches:
            for row in pdf.to_dict("records"):
                side = "r_" if row["_side"] else "l_"
                block = {k[2:]: v for k, v in row.items() if k.startswith(side)}
                block["x"] = np.frombuffer(block["x"], dtype=float).reshape(len(block["id"]), -1)
                if side == "l_":
                    held.append([block, None])
                else:
                    for one in held:
                        one[1] = compare(one[0], block, one[1])
        for block, state in held:
            if state is not None:
                yield finish(block, state)

    return cells.mapInPandas(run, schema)
