"""Prefix trie of conversations, from sorted neighbours.

A conversation is the sequence of its turns' 128-bit digests. In lexicographic order the conversations below one node of the
trie are neighbours, and two neighbours part at the depth of their longest common prefix (LCP). Union-find over the LCP edges in
descending depth therefore builds the trie bottom-up: each merge of two components creates the node at which they branch, or
joins one that is there at that depth. Nodes on a path without branches and ends are counted, and listed only in the result.

The order is split over partitions, and inside them over blocks. A node whose conversations all lie inside a block is finished
there. The others lie on the block's outer paths, to its first and to its last conversation; each of them is contracted to one
item (its depth, and the totals of the finished subtrees below it), and the same union-find over the items of neighbouring
forests, with the LCP across their border, joins them, some hundred forests at a time, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored

#: Bytes of a turn's digest.
TURN = 16
#: A block ends at so many conversations, or bytes of digests.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 25
#: Neighbouring forests that one task joins.
FORESTS = 128
#: Ids of conversations that end at a node, in one piece of text.
IDS = 1 << 13
#: Nodes that span blocks: up to so many rows (some 100 bytes each) are broadcast to name the parents of others.
MAX_BROADCAST_ROWS = 200_000
EMPTY = hashlib.sha256(b"").hexdigest()

ITEM = "struct<left: boolean, depth: int, n: long, low: long, kids: long, leaves: long, saved: long, ended: boolean>"
FOREST = f"struct<number: long, first: binary, first_sums: array<long>, last: binary, last_sums: array<long>, items: array<{ITEM}>>"
NODE = "struct<low: long, depth: int, sums: array<long>, n: long, kids: long, leaves: long, saved: long, ends: string, self: binary, parent: long, above: binary>"
PIECE = "struct<self: binary, part: long, seq: long, ids: string>"
LEVEL = f"forest {FOREST}, node {NODE}, piece {PIECE}"


def _arrow(ddl: str) -> pa.DataType:
    """The Arrow type of a type written as above."""
    plain = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    if ddl.startswith("array<"):
        return pa.list_(_arrow(ddl[6:-1]))
    if ddl.startswith("struct<"):
        inner, parts, depth = ddl[7:-1], [""], 0
        for c in inner:
            depth += (c == "<") - (c == ">")
            parts = [*parts, ""] if c == "," and not depth else [*parts[:-1], parts[-1] + c]
        return pa.struct([pa.field(*((name.strip(), _arrow(kind.strip())))) for name, kind in (p.split(":", 1) for p in parts)])
    return plain[ddl]


ARROW = pa.schema([("forest", _arrow(FOREST)), ("node", _arrow(NODE)), ("piece", _arrow(PIECE))])
OUT_ROWS = 1 << 14


@dataclass
class Node:
    depth: int
    first: int  # items that it holds, from the first to the last
    last: int
    n: int = 0
    low: int = 1 << 62
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ended: int = 0  # conversations that end here, or whether some do
    below: list[Node] = field(default_factory=list)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two conversations have in common at their begin."""
    n = min(len(a), len(b)) // TURN
    low, step = 0, 1
    while step:  # the step doubles over what is equal, then halves
        step = min(step, n - low)
        if a[low * TURN : (low + step) * TURN] == b[low * TURN : (low + step) * TURN]:
            low, step = low + step, step * 2
        else:
            step //= 2
        if low == n:
            break
    return low


def forest_of(leaves: list[Node], lcps: list[int]) -> Node:
    """Union-find over the edges between neighbours, deepest first; returns the node above all of them."""
    up = list(range(len(leaves)))
    top = leaves[:]

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in np.argsort(-np.array(lcps, np.int64), kind="stable").tolist():
        i, j, depth = find(e), find(e + 1), lcps[e]
        a, b = top[i], top[j]
        if a.depth == depth and b.depth == depth:  # one node: totals and branches are joined
            a.n, a.low, a.kids, a.leaves, a.saved, a.ended = a.n + b.n, min(a.low, b.low), a.kids + b.kids, a.leaves + b.leaves, a.saved + b.saved, a.ended + b.ended
            a.below += b.below
        elif a.depth == depth:
            a.below.append(b)
        elif b.depth == depth:
            b.below.append(a)
            b.first, a = a.first, b
        else:
            a = Node(depth, a.first, b.last, below=[a, b])
        a.last = max(a.last, b.last)
        up[j], top[i] = i, a
    return top[find(0)]


class Forest:
    """Finishes the nodes that lie inside, and contracts the others to items.

    ``paths(i)`` gives (digests, sums of words up to each depth) of a conversation through item i; ``ids_of(node)`` the ids that
    end at a node, in order, or None where they were sent on before.
    """

    def __init__(self, leaves: list[Node], lcps: list[int], paths, ids_of, whole: bool, ids: int = IDS):
        self.paths, self.ids_of, self.whole, self.last, self.ids = paths, ids_of, whole, len(leaves) - 1, ids
        self.nodes, self.pieces = [], []
        root = forest_of(leaves, lcps)
        if whole and root.depth:
            root = Node(0, 0, self.last, below=[root])
        self._finish(root)

    def _open(self, x: Node) -> bool:
        return not self.whole and (x.first == 0 or x.last == self.last)

    def _finish(self, root: Node) -> None:
        order, stack = [], [root]
        while stack:
            x = stack.pop()
            order.append(x)
            stack += x.below
        for x in reversed(order):  # branches before the node
            sums = self.paths(x.first)[1]
            for y in x.below:
                if not self._open(y):
                    x.n, x.low, x.kids, x.leaves = x.n + y.n, min(x.low, y.low), x.kids + 1, x.leaves + y.leaves
                    x.saved += y.saved + (y.n - 1) * (sums_at(self.paths(y.first)[1], y.depth) - sums_at(sums, x.depth))
            if not self._open(x) and not x.kids:
                x.leaves = 1
        for x in order:
            here = self._key(x) if self._open(x) else None
            if here and (ids := self.ids_of(x)):
                self.pieces += [(here, ",".join(map(str, ids[i : i + self.ids]))) for i in range(0, len(ids), self.ids)]
            for y in x.below:
                if not self._open(y):
                    self._emit(y, x.depth, None if here else x.low, here)
        if not self._open(root):
            self._emit(root, -1, None, None)
        at = [x for x in order if self._open(x)]
        self.items = [(True, x) for x in sorted((x for x in at if x.first == 0), key=lambda x: -x.depth)]
        self.items += [(False, x) for x in sorted((x for x in at if x.first), key=lambda x: x.depth)]

    def _key(self, x: Node) -> bytes:
        """What the node is: the digest of its turns."""
        return hashlib.md5(self.paths(x.first)[0][: x.depth * TURN]).digest()

    def _emit(self, x: Node, above: int, parent: int | None, key: bytes | None) -> None:
        sums, ids = self.paths(x.first)[1], self.ids_of(x)
        along = [sums_at(sums, d) for d in range(max(above, 0), x.depth + 1)]
        own = self._key(x) if ids is None else None
        ends = None if own else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else EMPTY
        self.nodes.append((x.low, x.depth, along if above >= 0 else [0, 0], x.n, x.kids, x.leaves, x.saved, ends, own, parent, key))


def sums_at(sums, depth: int) -> int:
    return int(sums[depth - 1]) if depth else 0


def _rows(batches) -> Iterator[tuple[int, bytes, np.ndarray]]:
    for batch in batches:
        ids, keys, sums = batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("words").to_pylist()
        for i, k, w in zip(ids, keys, sums):
            yield i, k or b"", np.cumsum(np.array(w or [], np.int64))


def _block(rows: list, ids: int) -> Forest:
    leaves = [Node(len(k) // TURN, i, i, 1, c, ended=1) for i, (c, k, _) in enumerate(rows)]
    lcps = [common_turns(rows[i][1], rows[i + 1][1]) for i in range(len(rows) - 1)]

    def ids_of(x: Node) -> list[int]:  # they sort before all others below the node
        return [rows[i][0] for i in range(x.first, x.first + x.ended)]

    return Forest(leaves, lcps, lambda i: rows[i][1:], ids_of, False, ids)


def _contracted(found: Forest, number: int, first, last) -> dict:
    items = [{"left": side, "depth": x.depth, "n": x.n, "low": x.low, "kids": x.kids, "leaves": x.leaves, "saved": x.saved, "ended": bool(x.ended)} for side, x in found.items]
    return {"number": number, "first": first[0], "first_sums": first[1], "last": last[0], "last_sums": last[1], "items": items}


def _joined(forests: list[dict], number: int, whole: bool) -> tuple[Forest, dict]:
    """Neighbouring forests as one; their items are the leaves, with an edge between each two."""
    leaves, lcps, ways = [], [], []
    for f in forests:
        first, last = (f["first"], f["first_sums"]), (f["last"], f["last_sums"])
        if ways:
            lcps.append(common_turns(ways[-1][0], first[0]))
        for j, item in enumerate(f["items"]):
            if j:
                lcps.append(min(item["depth"], f["items"][j - 1]["depth"]))
            leaves.append(Node(item["depth"], len(leaves), len(leaves), item["n"], item["low"], item["kids"], item["leaves"], item["saved"], int(item["ended"])))
            ways.append(first if item["left"] else last)
        ways[-1] = last  # the last item is where the last conversation ends
    found = Forest(leaves, lcps, lambda i: ways[i], lambda x: None, whole)
    a, b = forests[0], forests[-1]
    return found, _contracted(found, number, (a["first"], a["first_sums"]), (b["last"], b["last_sums"]))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4, key: str = "conv_id") -> DataFrame:
    """conv_id, path (digests of its turns), words (of each turn): every conversation behind the head of its group's first.

    Turns are in the order of (turn, role, digest of the turn), nulls first; null role and text are empty. Conversation c takes
    the first h = crc32(c as text) mod ``heads`` turns of conversation c - c % ``group`` (fewer if it has fewer, none if it is
    not there), then its own after its first h. Rows without a conversation id belong to none and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), n_words.alias("words")).alias("x"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    own = stored(own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int").alias("h"), "x.digest", "x.words"), "conversations")
    first = own.where(F.col("conv_id") == F.col("base")).select("base", *(F.slice(c, 1, heads - 1).alias(f"base_{c}") for c in ("digest", "words")))
    both = own.join(first, "base", "left")

    def behind(name: str):
        mine = F.slice(name, F.col("h") + 1, F.size(name))
        return F.when(F.col(f"base_{name}").isNull(), mine).otherwise(F.concat(F.slice(f"base_{name}", F.lit(1), F.col("h")), mine))

    return both.select("conv_id", F.unhex(F.array_join(behind("digest"), "")).alias("path"), behind("words").alias("words"))


def _written(forest: dict | None, nodes: list, pieces: list) -> Iterator[pa.RecordBatch]:
    """Rows of a level, each with one of the three structures."""
    names = [f.name for f in ARROW.field("node").type]
    rows = [{"forest": forest, "node": None, "piece": None}] if forest else []
    for kind, some in (("node", (dict(zip(names, n)) for n in nodes)), ("piece", pieces)):
        for one in some:
            rows.append({"forest": None, "node": None, "piece": None} | {kind: one})
            if len(rows) == OUT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(self, ends): the hash over the pieces of ids of each node; one piece is held at a time."""
    at, running, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != at:
                if at is not None:
                    out.append((at, running.hexdigest()))
                at, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if at is not None:
        out.append((at, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["self", "ends"])


def trie(sequences: DataFrame, block_rows: int = BLOCK_ROWS, forests: int = FORESTS, ids: int = IDS) -> DataFrame:
    """Every node of the prefix trie of ``sequences`` (conv_id, path, words), as :func:`nodes` describes it."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, held, size, seq = TaskContext.get().partitionId(), [], [], 0, 0
        for row in _rows(batches):
            held.append(row)
            size += len(row[1])
            if len(held) >= block_rows or size >= BLOCK_BYTES:
                found = _block(held, ids)
                blocks.append(_contracted(found, 0, held[0][1:], held[-1][1:]))
                yield from _written(None, found.nodes, [{"self": k, "part": part, "seq": seq + i, "ids": t} for i, (k, t) in enumerate(found.pieces)])
                held, size, seq = [], 0, seq + len(found.pieces)
            if len(blocks) == forests:
                found, one = _joined(blocks, 0, False)
                yield from _written(None, found.nodes, [])
                blocks = [one]
        if held:
            found = _block(held, ids)
            blocks.append(_contracted(found, 0, held[0][1:], held[-1][1:]))
            yield from _written(None, found.nodes, [{"self": k, "part": part, "seq": seq + i, "ids": t} for i, (k, t) in enumerate(found.pieces)])
        if blocks:
            found, one = _joined(blocks, part, False)
            yield from _written(one, found.nodes, [])

    def join(whole: bool):
        def run(table: pa.Table) -> pa.Table:
            some = sorted((f for f in table.column("forest").to_pylist()), key=lambda f: f["number"])
            found, one = _joined(some, some[0]["number"] // forests, whole)
            return pa.Table.from_batches(_written(None if whole else one, found.nodes, []), ARROW)

        return run

    ordered = sequences.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    levels = [stored(ordered.mapInArrow(grow, LEVEL), "trie")]
    while True:
        open_forests = levels[-1].where("forest IS NOT NULL").select("forest")
        top = open_forests.agg(F.max("forest.number")).first()[0]
        if top is None:
            break
        group = F.floor(F.col("forest.number") / forests).alias("group")
        levels.append(stored(open_forests.groupBy(group).applyInArrow(join(top < forests), LEVEL), "trie"))
        if top < forests:
            break
    return _named(levels)


def _named(levels: list[DataFrame]) -> DataFrame:
    """Nodes with the names of their parents and the hashes of their ends, one row per depth."""
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    rows = rows.where("node IS NOT NULL").select("node.*")
    # nodes that span blocks are finished in the later levels alone
    wide = levels[-1] if len(levels) == 1 else levels[1]
    for level in levels[2:]:
        wide = wide.unionByName(level)
    wide = levels[0].where("node.self IS NOT NULL").unionByName(wide.where("node.self IS NOT NULL")) if len(levels) > 1 else wide.where("node.self IS NOT NULL")
    names = wide.select(F.col("node.self").alias("above"), F.col("node.low").alias("named"))
    if names.count() <= MAX_BROADCAST_ROWS:
        names = F.broadcast(names)
    pieces = levels[0].where("piece IS NOT NULL").select("piece.*").repartition("self").sortWithinPartitions("self", "part", "seq")
    hashes = pieces.select("self", "ids").mapInArrow(_finished, "self binary, ends string").withColumnRenamed("ends", "hashed")
    inner = rows.where("self IS NULL").withColumn("hashed", F.lit(None).cast("string"))
    outer = rows.where("self IS NOT NULL").join(hashes, "self", "left").select(*rows.columns, "hashed")
    both = inner.unionByName(outer)
    near = both.where("above IS NULL").withColumn("named", F.col("parent"))
    far = both.where("above IS NOT NULL").join(names, "above").select(*both.columns, "named")
    found = near.unionByName(far).withColumn("length", F.size("sums") - 1)
    along = found.select("*", F.posexplode(F.slice("sums", F.lit(1), F.col("length"))).alias("i", "before"))
    last = F.col("i") == F.col("length") - 1
    return along.select(
        F.col("low").alias("conv_id"),
        (F.col("depth") - F.col("length") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("named")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.element_at("sums", -1) - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.coalesce("hashed", "ends", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def nodes(conversations: DataFrame, group: int = 20, heads: int = 4, key: str = "conv_id") -> DataFrame:
    """The trie of the rebuilt conversations (see :func:`rebuilt`): one row per node.

    conv_id (smallest member), depth, parent_conv_id (that of the node above; null at the root), n_convs (members), n_children,
    n_leaves (nodes without children in its subtree), saved_tokens (over its subtree, members but one times the words of a
    node's last turn), ends_sha256 (over the ids, ascending, of the members that end here).

    Null roles and texts are empty, a null turn comes first, turns alike in number follow role and content, repeated rows are
    turns of their own, rows without a conversation id and other columns are left out. An empty table has no members and gives
    no rows. A conversation is one row of 24 bytes a turn; groups of copies of any size are split over blocks and tasks.
    """
    return trie(rebuilt(conversations, group, heads, key))
