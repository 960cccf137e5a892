"""WARC files, and a derivative builder: responses become linked metadata and plain-text conversion records.

Records are gzip members of their own, so that each can be read alone. A metadata record holds, as JSON, the source's WARC and
HTTP headers, its digests, title and links; a conversion record holds the page's text. Both name the response in
WARC-Refers-To, and the conversion names its metadata record in WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import new_folder, stored
from cohortry.llm.html import texts

VERSION = "WARC/1.1"
#: A new file is begun after so many bytes of records, before compression.
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20
NAMESPACE = uuid.UUID("8f4c6f6e-3e0b-5d0c-9d2a-4f6b1c2d3e4f")
HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


#: An address, and a reference to one, that joining changes in nothing but the host: no dots alone between slashes, no empty parts.
PLAIN_HOST = re.compile(r"https?://[A-Za-z0-9.-]+(?=/|\Z)")
PLAIN_PATH = re.compile(r"(https?://[A-Za-z0-9.-]+)?(?:/[\w,-][\w.,-]*)+/?(?:\?[A-Za-z0-9_=&-]+)?(?:#[A-Za-z0-9_-]+)?")
PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
SHIFTS = range(150, -1, -10)


def digest(data: bytes) -> str:
    """The SHA-1 in base 32, ten bits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([PAIRS[n >> s & 1023] for s in SHIFTS])


def joined(target: str, host: str | None, href: str) -> str:
    """``urljoin``, without its parsing for plain references; ``host`` is the target's scheme and host if these are plain."""
    plain = PLAIN_PATH.fullmatch(href) if host else None
    if plain is None:
        return urljoin(target, href)
    return href if plain[1] else host + href


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '/'.join(map(str, parts)))}>"


def header_value(text: str) -> str:
    """A value that fits on a header line: control characters are percent-encoded."""
    return CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the block digest and length are added."""
    lines = [VERSION, *(f"{k}: {header_value(v)}" for k, v in fields), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a gzipped file; one record is held at a time."""
    held, inflate, pending = bytearray(), zlib.decompressobj(31), b""
    while True:
        data = pending or stream.read(READ_BYTES)
        if not data:
            if held:
                raise ValueError("a record is cut off")
            return
        held += inflate.decompress(data)
        pending = inflate.unused_data
        if inflate.eof:
            yield parse_record(bytes(held))
            held, inflate = bytearray(), zlib.decompressobj(31)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("the block has another length than its header says")
    return fields, rest[:n]


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("iso-8859-1").split("\r\n")
    return first, dict(line.split(": ", 1) for line in lines if ": " in line), payload


class FileSet:
    """Files of one task: begins a new one when the last is full, and remembers what it closed."""

    def __init__(self, folder: str, stem: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.stem, self.sink, self.done = stem, None, []

    def add(self, data: bytes, size: int) -> None:
        if self.sink is not None and self.size + size > FILE_BYTES:
            self.close()
        if self.sink is None:
            self.store.create_dir(self.root, recursive=True)
            self.path = f"{self.root}/{self.stem}-{uuid.uuid4().hex}.warc.gz"
            self.sink, self.size, self.n = self.store.open_output_stream(self.path, compression=None), 0, 0
        self.sink.write(data)
        self.size += size
        self.n += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.path, self.n))
            self.sink = None


MANIFEST = "path string, n long"


def _manifest(files: FileSet) -> pa.RecordBatch:
    files.close()
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in files.done], pa.string()), pa.array([n for _, n in files.done], pa.int64())], ["path", "n"])


def write_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Every row as an HTTP response record; returns the manifest (path, n, folder) of the files.

    A null page is an empty payload, a null address ``urn:x-none:``, a null key is left out. Repeated rows become records
    with ids of their own. Only files in the manifest count; a task that is run again writes others. An empty table gives
    an empty manifest.
    """
    folder = folder or new_folder(pages.sparkSession, "warc-responses")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        files = FileSet(folder, f"response-{part:06d}")
        for batch in batches:
            for k, address, page in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (page or "").encode("utf-8", "surrogatepass")
                hashed = digest(payload)
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(part, number, address, hashed)), ("WARC-Date", date), ("WARC-Target-URI", "urn:x-none:" if address is None else address), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", hashed)]
                if k is not None:
                    fields.append(("X-Source-Key", str(k)))
                files.add(record(fields, block), len(block))
                number += 1
        yield _manifest(files)

    rows = pages.select(F.col(key).cast("string"), F.col(url), F.col(html))
    return stored(rows.mapInArrow(write, MANIFEST).withColumn("folder", F.lit(folder)), "warc-manifest")


def derivatives(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes, int]:
    """(metadata record, conversion record, bytes before compression) of one response."""
    status, headers, payload = http_parts(block)
    source, target = fields["WARC-Record-ID"], fields.get("WARC-Target-URI", "")
    page = payload.decode("utf-8", "surrogatepass")
    title = TITLE.search(page)
    links, plain = [], PLAIN_HOST.match(target)
    host = plain[0] if plain else None
    for href in HREF.findall(page):
        href = href.strip("\"'")
        href = entities.unescape(href) if "&" in href else href
        try:
            links.append(joined(target, host, href))
        except ValueError:  # an address that cannot be parsed is kept as it stands
            links.append(href)
    found = {
        "Source-Headers": fields,
        "HTTP-Status": status,
        "HTTP-Headers": headers,
        "Payload-Digest-Verified": fields.get("WARC-Payload-Digest") == digest(payload),
        "Block-Digest-Verified": fields.get("WARC-Block-Digest") == digest(block),
        "Title": " ".join(entities.unescape(title[1]).split()) if title else None,
        "Links": links,
    }
    body = json.dumps(found, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    text = "\n".join(texts(page)).encode("utf-8", "surrogatepass")
    linked = [("WARC-Date", fields["WARC-Date"]), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Date", fields["WARC-Date"])]
    linked += [(f"X-Source-{k.removeprefix('WARC-')}", fields[k]) for k in ("WARC-Payload-Digest", "WARC-Block-Digest") if k in fields]
    linked += [("X-Source-Key", fields["X-Source-Key"])] if "X-Source-Key" in fields else []
    about = record_id(source, "metadata")
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", about), *linked, ("Content-Type", "application/json")], body)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id(source, "conversion")), *linked, ("WARC-Concurrent-To", about), ("Content-Type", "text/plain; charset=utf-8")], text)
    return metadata, conversion, len(body) + len(text)


def build_derivatives(manifest: DataFrame, tasks: int, folder: str | None = None) -> DataFrame:
    """Read response files and write, for each response, a metadata and a conversion record; returns their manifest."""
    folder = folder or new_folder(manifest.sparkSession, "warc-derivatives")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSet(folder, f"derivative-{TaskContext.get().partitionId():06d}")
        for batch in batches:
            for path, source in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(source)
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        if fields["WARC-Type"] == "response":
                            metadata, conversion, size = derivatives(fields, block)
                            files.add(metadata + conversion, size)  # both in one file
        yield _manifest(files)

    return stored(manifest.select("path", "folder").repartition(tasks, "path").mapInArrow(derive, MANIFEST).withColumn("folder", F.lit(folder)), "warc-manifest")


def read_files(manifest: DataFrame, tasks: int) -> DataFrame:
    """Every record of the files: type, id, refers_to, concurrent_to, target, key, fields (a map), block, digest_ok."""
    names = ["type", "id", "refers_to", "concurrent_to", "target", "key", "fields", "block", "digest_ok"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for f, block in read_records(stream):
                        rows.append((f["WARC-Type"], f["WARC-Record-ID"], f.get("WARC-Refers-To"), f.get("WARC-Concurrent-To"), f.get("WARC-Target-URI"), f.get("X-Source-Key"), list(f.items()), block, f["WARC-Block-Digest"] == digest(block)))
                        held += len(block)
                        if held > 1 << 24:
                            yield _record_rows(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _record_rows(rows, names)

    return manifest.select("path", "folder").repartition(tasks, "path").mapInArrow(read, "type string, id string, refers_to string, concurrent_to string, target string, key string, fields map<string,string>, block binary, digest_ok boolean")


def _record_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
