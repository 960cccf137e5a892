"""URL filters over a sorted digest array.

A list of entries (rules of host and path with a verdict, and words that block a host) is written as files of sorted 64-bit
xxhash digests with the entries' full strings behind them. Tasks memory-map the files, look all candidate keys of a batch up by
vectorised binary search, and compare the full string of each hit, so that two strings with one digest never stand for each other.

A file, all numbers little-endian: magic "SDAX0001"; n (uint64); n digests (int64, ascending); n + 1 offsets of strings (uint64);
n verdicts (uint8, 1: block); the strings (UTF-8). Its place in the digest order is in the manifest, so a list of any length is
probed without being shipped: only the pages of the files that a search touches are read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import new_folder, stored
from cohortry.session import BoundExceeded, take_bounded

MAGIC = b"SDAX0001"
HEAD = struct.Struct("<8sQ")
SEED = 42  # that of the engine's own xxhash64, so that digests agree on both sides
RULE, WORD = "rule:", "word:"
#: Files of a list, and shapes (labels of the host, characters of the path) of its rules.
MAX_FILES, MAX_SHAPES = 100_000, 100_000
#: Bytes of files that a task may hold where the shared folder cannot be memory-mapped.
MAX_HELD_BYTES = 1 << 30
#: Words that block a host when no rule fits, as a list of its own would hold them.
HOST_WORDS = ("ads", "adult", "bet", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
#: Parts of a host between anything but ASCII letters and digits.
PART = re.compile(r"[a-z0-9]+")


def lower(host: Column) -> Column:
    """A-Z in lower case, as hosts are compared."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def address(url: str | Column):
    """(host, path) of an address, as columns: the host in lower case (A-Z), both empty for a null or one without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, whole, i), F.lit("")) for i in (1, 2))
    return lower(host), path


def entries(spark, rules, words=HOST_WORDS) -> DataFrame:
    """A list (kind, host, path, block) from rules (host, path, verdict) and blocked words."""
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
    rows = [("rule", h, p, v == "block") for h, p, v in rules] + [("word", w, "", True) for w in words]
    return spark.createDataFrame(rows, "kind string, host string, path string, block boolean")


def file_parts(digests: np.ndarray, texts: list[str], block: list[bool]) -> list[bytes]:
    """A digest file, in parts; entries come in the order of their digests."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype("<u8")
    return [HEAD.pack(MAGIC, len(data)), digests.astype("<i8").tobytes(), offsets.tobytes(), bytes(block), *data]


@dataclass
class Filter:
    """A written list: its files in digest order, and the shapes of its rules."""

    files: list[tuple[int, str]] = field(default_factory=list)  # (first digest, path)
    folder: str = ""
    shapes: list[tuple[int, int]] = field(default_factory=list)  # (labels of the host, characters of the path)
    bytes: int = 0


def build(listed: DataFrame) -> Filter:
    """Write a list (kind, host, path, block) as digest files in the shared folder.

    Entries with the same string are one; if their verdicts differ, it blocks. Null hosts and paths count as empty; a rule
    without a host is left out, as no address has that host. An empty list gives a filter that allows everything.
    """
    spark = listed.sparkSession
    rule = F.col("kind") == "rule"
    host, path = lower(F.coalesce("host", F.lit(""))), F.when(rule, F.coalesce("path", F.lit(""))).otherwise("")
    rows = listed.select(rule.alias("rule"), host.alias("host"), path.alias("path"), F.coalesce("block", F.lit(True)).alias("block")).where("host <> ''")
    text = F.concat(F.when(F.col("rule"), RULE).otherwise(WORD), "host", "path")
    shapes = rows.where("rule").select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    keys = rows.groupBy(text.alias("text")).agg(F.max("block").alias("block")).select(F.xxhash64("text").alias("digest"), "text", "block")
    folder = new_folder(spark, "url-digests")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        data = file_parts(table["digest"].to_numpy(), table["text"].to_pylist(), table["block"].to_pylist())
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sdax"
        with store.open_output_stream(name) as sink:
            for part in data:
                sink.write(part)
        yield pa.RecordBatch.from_arrays([pa.array([table["digest"][0].as_py()], pa.int64()), pa.array([name]), pa.array([sum(map(len, data))], pa.int64())], ["first", "path", "n_bytes"])

    ordered = keys.repartitionByRange("digest").sortWithinPartitions("digest", "text")
    manifest = stored(ordered.mapInArrow(write, "first long, path string, n_bytes long"), "url-manifest")
    files = sorted((r["first"], r["path"], r["n_bytes"]) for r in take_bounded(manifest, MAX_FILES, "digest files"))
    found = Filter([(a, b) for a, b, _ in files], folder, sorted((r["labels"], r["chars"]) for r in take_bounded(shapes, MAX_SHAPES, "rule shapes")), sum(n for _, _, n in files))
    if files and _local(folder) is None and found.bytes > MAX_HELD_BYTES:
        raise BoundExceeded(f"a list of {found.bytes} bytes needs a shared folder that can be memory-mapped")
    return found


def _local(folder: str) -> str | None:
    """The folder as a path of the file system, None where it is in another store."""
    parts = urlparse(folder)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


class DigestFile:
    """One file, memory-mapped where it can be."""

    def __init__(self, folder: str, path: str):
        if _local(folder) is not None:
            data = np.memmap(path, np.uint8, "r")
        else:
            with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as source:
                data = np.frombuffer(source.read(), np.uint8)
        magic, n = HEAD.unpack(data[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a digest file")
        cut = np.cumsum([HEAD.size, 8 * n, 8 * (n + 1), n])
        self.digests, self.offsets = data[cut[0] : cut[1]].view("<i8"), data[cut[1] : cut[2]].view("<u8")
        self.block, self.texts = data[cut[2] : cut[3]], data[cut[3] :]

    def text(self, i: int) -> bytes:
        return self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()


class DigestArray:
    """The files of a list as one array: ``find(keys)`` gives -1 (not listed), 0 (allow) or 1 (block) for each key."""

    def __init__(self, found: Filter):
        self.found, self.open = found, {}
        self.firsts = np.array([a for a, _ in found.files], np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        out = np.full(len(keys), -1, np.int8)
        if not len(self.firsts) or not keys:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys)).view(np.int64)
        place = np.searchsorted(self.firsts, digests, "right") - 1
        for p in np.unique(place[place >= 0]).tolist():
            file = self.open.get(p)
            if file is None:
                file = self.open[p] = DigestFile(self.found.folder, self.found.files[p][1])
            asked = np.flatnonzero(place == p)
            begin, end = (np.searchsorted(file.digests, digests[asked], side) for side in ("left", "right"))
            for q, a, b in zip(asked[begin < end].tolist(), begin[begin < end].tolist(), end[begin < end].tolist()):
                for i in range(a, b):
                    if file.text(i) == keys[q]:
                        out[q] = file.block[i]
        return out


def judge(pages: DataFrame, found: Filter, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule, verdict, word.

    A rule fits an address if the host is the rule's or one below it and the path begins with the rule's. Of the rules that fit,
    the longest (host and path together, then host) decides; without one, an address is blocked if a word of its host is listed,
    and allowed otherwise. ``rule`` is that rule's host and path, ``word`` the first listed word of the host where no rule fits.
    A null address, and one without ``://``, has an empty host and path and is allowed. Repeated rows each get an answer, other
    columns are left out, an empty table gives no rows. Nothing is shuffled, so a host with most rows costs no more than others.
    """
    host, path = address(url)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    kind = rows.schema["key"].dataType.simpleString()
    lengths: dict[int, list[int]] = {}
    for labels, chars in found.shapes:
        lengths.setdefault(labels, []).append(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(found)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rules, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                cut, labels = len(h), 0
                while h and cut >= 0:  # the host's last label, its last two, and so on
                    cut, labels = h.rfind(".", 0, cut), labels + 1
                    top = h[cut + 1 :]
                    for n in lengths.get(labels, ()):
                        if n <= len(p):
                            rules.append((top, p[:n]))
                            owner.append(i)
            keys = [f"{RULE}{a}{b}".encode("utf-8", "surrogatepass") for a, b in rules]
            best: dict[int, tuple[int, int, int, str]] = {}
            hits = array.find(keys)
            for j in np.flatnonzero(hits >= 0).tolist():
                a, b = rules[j]
                best[owner[j]] = max(best.get(owner[j], (-1, -1, 0, "")), (len(a) + len(b), len(a), int(hits[j]), a + b))
            parts = [(i, w) for i, h in enumerate(hosts) if i not in best for w in PART.findall(h)]
            listed: dict[int, str] = {}
            for j in np.flatnonzero(array.find([f"{WORD}{w}".encode() for _, w in parts]) == 1).tolist():
                listed.setdefault(*parts[j])
            verdicts = ["block" if (best[i][2] if i in best else i in listed) else "allow" for i in range(len(hosts))]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([best[i][3] if i in best else None for i in range(len(hosts))], pa.string()), pa.array(verdicts, pa.string()), pa.array([listed.get(i) for i in range(len(hosts))], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "rule", "verdict", "word"])

    return rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, word string").withColumnRenamed("key", key)
