"""Near-duplicate documents: a chosen-path join on word shingles.

A document is the set of its runs of five words. Each of several runs puts a set into buckets, one for every token that a
hash keeps with probability 1 / (similarity x size of the set): two sets of at least that similarity keep one common token
per run on average, whatever their sizes. Buckets that are still large are split again on further sampled tokens (a path of
chosen tokens names a bucket); small ones are compared by brute force on parity sketches, which leaves candidate clusters. A
sketch rejects a pair only if the sets differ in too many tokens, never by chance. In a cluster the exact similarity of all
pairs decides. The number of runs follows from the target recall.

Equal sets are one member with a number of copies, and a bucket or cluster gives a spanning forest and counts, never its
pairs. Buckets and clusters beyond a block are compared block by block in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WORD, partitions, returning, stored
from cohortry.llm.graph import components

SHINGLE_WORDS, SIMILARITY, TARGET_RECALL = 5, 0.8, 0.995
#: Buckets beyond SMALL are split on another token, DEPTH times at most; then they are compared whatever their size.
SMALL, DEPTH = 4096, 3
#: Members that one task compares with each other at once: by sketches, and by whole sets.
SKETCH_BLOCK, SET_BLOCK = 4096, 512
#: Bits of a sketch: the power of two at or above the size of the set, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Keys (8 bytes each) of documents that may be broadcast when the texts of members are fetched; beyond it, a shuffle.
MAX_BROADCAST_KEYS = 200_000
REMEMBERED_WORDS = 300_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, even if all its buckets are split to ``depth``.

    A pair has one common token per level on average (more if it is more similar), so it survives level d with probability
    1 - exp(-probability at level d - 1).
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K2
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of a text. Fewer words than a shingle are one shingle; no word, none."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text) if text else []
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        one = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(one))
        out = np.full(len(one) - width + 1, np.uint64(width))
        for k in range(width):
            out = mix(out * K1 + one[k : k + len(out)])
        return np.unique(out)


def chosen(tokens: np.ndarray, paths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent path, child path) for every token kept under each path."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(tokens))))) if len(tokens) else np.uint64(0)
    at, out = [], []
    step = max(1, (1 << 20) // max(1, len(tokens)))
    for b in range(0, len(paths), step):
        h = mix(paths[b : b + step, None] * K1 + tokens[None, :])
        row, col = np.nonzero(mix(h) <= limit)
        at.append(row + b)
        out.append(h[row, col])
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of these sizes."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def sketch(tokens: np.ndarray) -> bytes:
    """Whether the number of tokens is odd, for each of the bins that their hashes fall into."""
    bits = int(sketch_bits(np.array([len(tokens)]))[0])
    at = (mix(tokens * K2) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """The sketches at ``bits`` bits each, none of which may be shorter: halves on top of each other are the parities of fewer bins."""
    out = []
    for one in sketches:
        words = np.frombuffer(one, np.uint64)
        while len(words) * 64 > bits:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out.append(words)
    return np.stack(out)


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The links (a, b) that join two parts, and each member's part so far (union-find over 0..n-1)."""
    root = np.arange(n) if root is None else root
    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = x, y
        while root[rx] != rx:
            root[rx] = root[root[rx]]
            rx = root[rx]
        while root[ry] != ry:
            root[ry] = root[root[ry]]
            ry = root[ry]
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept, root


def near_sketches(n: np.ndarray, sketches: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow the similarity.

    Sets of sizes x and y with at least the similarity s differ in (x + y) (1 - s) / (1 + s) tokens at most, and each of those
    changes one bit at most: a pair that is left out is below the similarity for certain.
    """
    kept, root = [], np.arange(len(n))
    order = np.argsort(n, kind="stable")  # sizes must be alike: only a window of larger ones can match
    n = n[order]
    share = (1 - similarity) / (1 + similarity)
    last, bits = np.searchsorted(n, n / similarity + 1e-6, "right"), sketch_bits(n)
    for width in np.unique(bits).tolist():
        lo, hi = np.searchsorted(bits, [width, width + 1]).tolist()
        words = folded([sketches[k] for k in order[lo : last[hi - 1]]], width)
        for i in range(lo, hi):
            j = slice(i + 1, last[i])
            if j.start < j.stop:
                differ = np.bitwise_count(words[i + 1 - lo : last[i] - lo] ^ words[i - lo]).sum(axis=1)
                close = np.flatnonzero(differ <= (n[j] + n[i]) * share + 1e-6) + i + 1
                more, root = forest(len(n), np.full(len(close), i), close, root)
                kept += more
    return [(int(order[x]), int(order[y])) for x, y in kept]


def similar_pairs(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all pairs with at least the similarity: intersections by a product of 0/1 matrices, in pieces."""
    sizes = np.array([len(s) for s in sets])
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)))
    width = max(1, (1 << 23) // len(sets))
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    for b in range(0, len(tokens), width):
        lo, hi = np.searchsorted(at, [b, b + width])
        part = np.zeros((len(sets), min(width, len(tokens) - b)), np.float32)
        part[member[lo:hi], at[lo:hi] - b] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(common / np.maximum(union, 1) >= similarity, 1))
    yield i, j


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[dict]]:
    """Rows of a sorted partition, as groups that agree in the first ``width`` columns."""
    held, name = [], None
    for batch in batches:
        names = batch.schema.names[:width]
        for row in batch.to_pylist():
            own = tuple(row[k] for k in names)
            if own != name and held:
                yield held
                held = []
            name = own
            held.append(row)
    if held:
        yield held


def in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks of its group that holds its own block: columns bi, bj, mine."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    rows = rows.withColumn("mine", mine)
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("mine", o).alias("bi"), F.greatest("mine", o).alias("bj"))))
    return rows.withColumn("pair", pair).select(group, F.col("pair.bi").alias("bi"), F.col("pair.bj").alias("bj"), "*").drop("pair", size)


def measure(docs: DataFrame, words: int, similarity: float, runs: int) -> DataFrame:
    """key, t, id and id2 (hashes of the set; null if it is empty), n, sketch and first-level paths of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seeds = Shingles(words), mix(np.arange(1, runs + 1, dtype=np.uint64) * K1)
        for batch in batches:
            rows = []
            for value in batch.column(2):
                s = shingles(value.as_py())
                if len(s):
                    data = s.tobytes()
                    rows.append((xxhash.xxh64_intdigest(data) - 2**63, xxhash.xxh64_intdigest(data, 1) - 2**63, len(s), sketch(s), chosen(s, seeds, similarity)[1].view(np.int64)))
                else:
                    rows.append((None, None, 0, None, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["key", "t", "id", "id2", "n", "sketch", "paths"])

    return docs.select("key", "t", "text").mapInArrow(returning(run), "key long, t long, id long, id2 long, n long, sketch binary, paths array<long>")


def with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """key and text of the documents that stand for members (whose ``low`` is the key)."""
    keys = members.select(F.col("low").alias("k")).distinct()
    if keys.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("key", "text")


def sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """id and shingles of each member, taken again from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            found = [shingles(v.as_py()) for v in batch.column(1)]
            data = [s.tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(d) - 2**63 if d else None for d in data], pa.int64()), pa.array(data, pa.binary())], ["id", "tokens"])

    return with_texts(docs, members).mapInArrow(returning(run), "id long, tokens binary").where("id IS NOT NULL")


def split_again(docs: DataFrame, sets: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(path, id) one token further, for the (path, id) rows of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = [], []
            for one, tokens, own in zip(*(c.to_pylist() for c in batch.columns)):
                children = np.unique(chosen(np.frombuffer(tokens, np.uint64), np.array(own, np.int64).view(np.uint64), similarity)[1]).view(np.int64)
                ids += [one] * len(children)
                paths.append(children)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int64)), pa.array(ids, pa.int64())], ["path", "id"])

    own = rows.groupBy("id").agg(F.collect_list("path").alias("own"))  # a few paths per run
    members = sets.join(own.select("id"), "id", "left_semi")
    tokens = sets_of(docs, members, words).join(own, "id").dropDuplicates(["id"])
    return tokens.select("id", "tokens", "own").mapInArrow(run, "path long, id long")


def candidate_links(docs: DataFrame, sets: DataFrame, words: int, similarity: float, small: int, depth: int) -> DataFrame:
    """Links (a, b) between sets that share a bucket and whose sketches are alike: a spanning forest of each bucket."""
    rows, ready = sets.select("id", F.explode(F.array_distinct("paths")).alias("path")), None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        rows = stored(rows.join(sizes, "path").select("path", "id", "size"), "buckets")
        large = F.col("size") > small
        last = level == depth or not rows.where(large).limit(1).collect()
        part = rows if last else rows.where(~large)
        ready = part if ready is None else ready.unionAll(part)
        if last:
            break
        rows = split_again(docs, sets, rows.where(large), words, similarity)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, 3):
            if len(group) > 1:
                n = np.array([r["n"] for r in group], np.int64)
                for x, y in near_sketches(n, [r["sketch"] for r in group], similarity):
                    a.append(group[x]["id"])
                    b.append(group[y]["id"])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = ready.join(sets.select("id", "n", "sketch"), "id").select("path", "id", "n", "sketch", "size")
    blocks = in_blocks(full, "path", "size", SKETCH_BLOCK).select("path", "bi", "bj", "id", "n", "sketch")
    parts = partitions(docs.sparkSession)
    return blocks.repartition(parts, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj").mapInArrow(link, "a long, b long")


def exact_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, words: int, similarity: float) -> DataFrame:
    """In every candidate cluster: for each set its number of links to documents of other sets, and a spanning forest.

    Columns id, links, other: a row with ``other`` is a link of the forest, one with ``links`` a number to be added up.
    """
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    members = sets.select("id", "low", "copies").join(clusters, "id")
    tokens = sets_of(docs, members, words).dropDuplicates(["id"])
    rows = tokens.join(members.drop("low"), "id").join(sizes, "root")
    blocks = in_blocks(rows, "root", "size", SET_BLOCK).select("root", "bi", "bj", "mine", "id", "copies", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            if len(group) < 2:
                continue
            ids, copies = [r["id"] for r in group], np.array([r["copies"] for r in group], np.int64)
            mine, links, edges = np.array([r["mine"] for r in group]), np.zeros(len(group), np.int64), []
            across = group[0]["bi"] != group[0]["bj"]
            root = None
            for i, j in similar_pairs([np.frombuffer(r["tokens"], np.uint64) for r in group], similarity):
                if across:  # pairs within a block are the business of that block's own group
                    i, j = i[mine[i] != mine[j]], j[mine[i] != mine[j]]
                links += np.bincount(i, copies[j], len(group)).astype(np.int64) + np.bincount(j, copies[i], len(group)).astype(np.int64)
                more, root = forest(len(group), i, j, root)
                edges += more
            has = np.flatnonzero(links)
            out = [[ids[k] for k in has] + [ids[x] for x, _ in edges], links[has].tolist() + [None] * len(edges), [None] * len(has) + [ids[y] for _, y in edges]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "links", "other"])

    parts = partitions(docs.sparkSession)
    return blocks.repartition(parts, "root", "bi", "bj").sortWithinPartitions("root", "bi", "bj").mapInArrow(compare, "id long, links long, other long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, recall: float = TARGET_RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """For every document: key, t (xxhash64 of the text), set_id, n_shingles, class_id, class_set, n_links.

    Documents whose shingle sets have at least the similarity are linked; a class is a connected component. ``class_id`` is
    its lowest key, ``class_set`` its lowest set_id, ``n_links`` the number of other documents that a document is linked to,
    copies included. Without a word (null, empty, white space) a document has no shingle, no set_id, no link, and is a
    class of its own. With one to four words the words are its only shingle. A null key is no class_id unless all
    keys of the class are null. Repeated rows are documents of their own. Texts are read whole. An empty table gives no rows.
    """
    runs = runs_for(recall, depth)
    slim = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    every = stored(measure(slim, words, similarity, runs), "shingled")
    sets = stored(
        every.where("id IS NOT NULL").groupBy("id", "id2").agg(F.min("key").alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")),
        "sets",
    )
    # written first: two Python steps in one stage would take two workers per core, and workers stay
    clusters = components(stored(candidate_links(slim, sets, words, similarity, small, depth), "candidate-links"))
    found = stored(exact_links(slim, sets, stored(clusters, "clusters"), words, similarity), "exact-links")
    roots = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    lows = sets.select("id", "low", "copies").join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = lows.groupBy("root").agg(F.min("low").alias("class_id"))
    info = lows.join(least, "root").select("id", "class_id", F.col("root").alias("class_set"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("others"))
    out = every.select("key", "t", "id", "n").join(info, "id", "left")
    return out.select(
        F.col("key").alias(key),
        "t",
        F.col("id").alias("set_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        "class_set",
        F.coalesce("others", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less all but one document of each class.

    The document with the lowest (key, hash of the text) stays; of rows that repeat it, one. Documents without a word all
    stay. Cases as in ``classes``.
    """
    found = stored(classes(docs, key, text, **options).select(F.col(key).alias("key"), "t", "class_set"), "classes")
    in_class = found.where("class_set IS NOT NULL")
    kept = in_class.groupBy("class_set").agg(F.min(F.struct("key", "t")).alias("best"))
    judged = in_class.groupBy("class_set", "key", "t").agg(F.count("*").alias("rows")).join(kept, "class_set").withColumn("stays", F.struct("key", "t") == F.col("best"))
    judged = stored(judged.where("rows > 1 OR NOT stays").select(F.col("key").alias("__key"), F.col("t").alias("__t"), "stays"), "judged")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__t"))

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_KEYS else rows

    out = docs.join(side(judged.drop("stays")), same, "left_anti")
    again = judged.where("stays").drop("stays")
    if again.limit(1).collect():
        alike = docs.join(side(again), same, "left_semi").withColumn("__t", F.xxhash64(text))
        out = out.unionByName(alike.dropDuplicates([key, "__t"]).drop("__t"))
    return out
