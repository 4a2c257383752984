"""Writing and reading WARC archives, one gzip member a record.

Payloads of at least ``MIN_REVISIT`` bytes that occur under several page ids
are stored once, as the response with the smallest page id; the others are
revisit records that refer to it.  Every block starts with HTTP headers, so a
revisit's block states the length of the payload it stands for.

``read_archives`` is sequential: it feeds a file to zlib a chunk at a time, a
decompressor for each member, takes exactly ``Content-Length`` bytes for a
block, hashes while it reads and checks block and payload digests.

Files go to the shared folder from the tasks, under a name of their own for
each attempt; the manifest (Parquet, written by Spark's committer) lists those
of the attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reco.llm.common import on_executors, open_fs, stored

MIN_REVISIT = 100
CHUNK = 1 << 18
HEAD = 1 << 20      # bytes of the longest header block
LEVEL = 6
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"   # archives of a table carry no time of their own
PAGE_URN = "urn:page:"


def _uri(text: str) -> str:
    """Control characters and spaces percent-encoded: a header is one line."""
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool, date: str = EPOCH) -> bytes:
    """One record as a gzip member; a revisit's block has the HTTP headers only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{'' if refers_to is None else refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    """What was read of one record; ``payload`` only if asked for."""
    type: str
    page_id: int | None
    uri: str | None
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None = None
    headers: dict = field(default_factory=dict)


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: "_Source"):
        self.source, self.z, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decompress another chunk into ``held``; False at the member's end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.source.take()
            if not data:
                raise ValueError("gzip member ends early")
            got = self.z.decompress(data, CHUNK)
            if self.z.eof:
                self.source.give_back(self.z.unused_data)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, limit: int = HEAD) -> bytes:
        while mark not in self.held:
            if len(self.held) > limit or not self.more():
                raise ValueError("record header without an end")
        head, _, self.held = self.held.partition(mark)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("block ends early")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


class _Source:
    """Compressed bytes of a file, a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def take(self) -> bytes:
        data, self.held = self.held or self.stream.read(CHUNK), b""
        return data

    def give_back(self, data: bytes) -> None:
        self.held = data + self.held

    def ended(self) -> bool:
        self.held = self.held or self.stream.read(CHUNK)
        return not self.held


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(digits) if digits else None


def _digest(headers: dict, name: str) -> str | None:
    kind, _, value = headers.get(name, "").partition(":")
    return value.lower() if kind.lower() == "sha256" else None


def read_stream(stream, with_payload: bool = False) -> Iterator[Record]:
    """Records of an open archive, front to back.  A broken frame, length or
    digest raises ValueError."""
    source = _Source(stream)
    while not source.ended():
        m = _Member(source)
        first = m.until(b"\r\n\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _headers(first)
        size, kind = int(head["content-length"]), head.get("warc-type", "")
        block_sha, payload_sha, kept, n = hashlib.sha256(), hashlib.sha256(), [], 0
        http: bytes | None = b""      # until its end is seen
        for part in m.exactly(size):
            block_sha.update(part)
            if http is not None:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    if len(http) > HEAD:
                        raise ValueError("block without an end of its HTTP headers")
                    continue
                http, part, http_head = None, http[at + 4:], http[:at]
            n += len(part)
            payload_sha.update(part)
            if with_payload:
                kept.append(part)
        if http is not None:
            raise ValueError("block without HTTP headers")
        if b"".join(m.exactly(4)) != b"\r\n\r\n" or m.held or m.more():
            raise ValueError("record is not framed by its length")
        if (want := _digest(head, "warc-block-digest")) and want != block_sha.hexdigest():
            raise ValueError("block digest differs")
        length = int(_headers(http_head).get("content-length", n))
        want = _digest(head, "warc-payload-digest")
        if kind != "revisit":
            if length != n:
                raise ValueError("payload length differs")
            if want and want != payload_sha.hexdigest():
                raise ValueError("payload digest differs")
            want = payload_sha.hexdigest()
        yield Record(kind, _page(head.get("warc-record-id")), head.get("warc-target-uri"),
                     _page(head.get("warc-refers-to")) if kind == "revisit" else None, length, want or "",
                     b"".join(kept) if with_payload else None, head)


def with_originals(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, first_id``: ``first_id`` is the
    smallest id that has the payload, if several rows have it and it is at
    least ``MIN_REVISIT`` bytes."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    firsts = (p.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n"))
    return p.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", "first_id")


MANIFEST = "path string, n_records long, n_bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One record a row; returns the stored manifest ``path, n_records, n_bytes``.

    Null html is an empty payload, a null url leaves the target out, a null id
    an empty record name.  Rows that repeat the smallest id of a payload are
    all responses.  An empty table writes no file.
    """
    def write(batches):
        out = path = None
        n = size = 0
        for b in batches:
            ids, urls, digests, firsts = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "first_id"))
            payloads = b.column("payload")
            for i in range(b.num_rows):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, p = open_fs(path)
                    fs.create_dir(p.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(p, compression=None)
                revisit = firsts[i] is not None and ids[i] != firsts[i]
                data = record_bytes(ids[i], urls[i], payloads[i].as_py(), digests[i], firsts[i] if revisit else None, revisit)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "n_records": [n], "n_bytes": [size]})

    on_executors(pages.sparkSession)
    return stored(with_originals(pages, id_col, html_col).mapInArrow(write, MANIFEST), "warc-manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the files in ``archives`` (a ``path`` column): ``page_id,
    payload_bytes, payload_digest, record_type, refers_to, uri`` and, if asked
    for, ``payload`` (null for revisits)."""
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(p, compression=None) as stream:
                    for r in read_stream(stream, with_payload):
                        row = (r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, r.uri)
                        rows.append((*row, r.payload if r.type != "revisit" else None) if with_payload else row)
                        held += len(r.payload or b"")
                        if len(rows) == 5000 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    on_executors(archives.sparkSession)
    n = max(1, archives.count())
    return (archives.select("path").repartitionByRange(n, "path")
            .mapInArrow(read, RECORDS + ", payload binary" * with_payload))
