"""Token ids packed to the fewest bits the vocabulary needs.

File format (all integers little-endian):

* ``TPK1`` and a header: bits of an id, ids in a block, two ``uint32``;
* blocks of packed ids, ``block_ids`` each but the last, every block starting
  on a byte; id ``k`` of a block takes bits ``k*bits .. (k+1)*bits-1``, low bit
  first;
* the index: documents' ids (``int64``), a byte each that is 0 for a null id,
  documents' first positions and the end (``int64``), the blocks' offsets in the file and
  the end (``int64``);
* the trailer: position of the index, documents, blocks, ids (four ``int64``)
  and ``TPK1``.

Blocks are written as ids arrive and read alone, so neither side holds more
than a few blocks; ``TokenFile.ids`` reads any range of positions.

``write_tokens`` range-partitions the documents by id and writes one file a
partition; its result is the manifest, a row a file, from the tasks that
succeeded (a lost or repeated attempt leaves an unlisted file at most).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reco.llm.common import on_executors, open_fs, stored
from reco.llm.chunk_ids import ChunkIds
from reco.llm.pretokens import MARK, WHITE

MAGIC = b"TPK1"
BLOCK_IDS = 8192
HEADER, TRAILER = struct.Struct("<4sII"), struct.Struct("<qqqq4s")
LINES = 32           # chunks encoded as one text
#: A chunk with a line break, with white space at its end or twice at its start.
UNSAFE = re.compile(rf"\n|[{WHITE}]\Z|\A[{WHITE}][{WHITE}]|{MARK}")
SPAN = 64            # blocks packed or unpacked at once


def bits_for(vocabulary: int) -> int:
    """Bits of the largest of ``vocabulary`` ids, one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to a bit stream, low bits first.  Raises on an id that needs more bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a bit stream."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


class TokenWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        if block_ids % 8:
            raise ValueError("a block must hold a multiple of 8 ids")
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.docs, self.valid, self.starts, self.offsets = [], bytearray(), [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.at = HEADER.size
        out.write(HEADER.pack(MAGIC, bits, block_ids))

    def begin(self, doc_id: int | None) -> None:
        self.docs.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.starts.append(self.n)

    def extend(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= SPAN * self.block_ids:
            self._flush(self.n_held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for b in range(0, n, self.block_ids):
            self.offsets.append(self.at)
            data = pack(ids[b:min(b + self.block_ids, n)], self.bits)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        self.out.write(np.array(self.docs, "<i8").tobytes() + bytes(self.valid)
                       + np.array([*self.starts, self.n], "<i8").tobytes() + np.array([*self.offsets, self.at], "<i8").tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.docs), len(self.offsets), self.n, MAGIC))


class TokenFile:
    """Random access to a file of packed ids (an open, seekable binary stream)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        if size < HEADER.size + TRAILER.size:
            raise ValueError("not a token file")
        magic, self.bits, self.block_ids = HEADER.unpack(self._read(0, HEADER.size))
        index, n_docs, n_blocks, self.n, tail = TRAILER.unpack(self._read(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token file")
        raw = self._read(index, n_docs * 8 + n_docs + (n_docs + 1) * 8 + (n_blocks + 1) * 8)
        a = n_docs * 8
        self.valid = np.frombuffer(raw, np.uint8, n_docs, a)
        self.docs = np.frombuffer(raw, "<i8", n_docs)
        self.starts = np.frombuffer(raw, "<i8", n_docs + 1, a + n_docs)
        self.offsets = np.frombuffer(raw, "<i8", n_blocks + 1, a + n_docs + (n_docs + 1) * 8)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        data = self.stream.read(n)
        if len(data) != n:
            raise ValueError("token file ends early")
        return data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at positions ``start`` to ``stop``."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block_ids     # full blocks end on a byte, so neighbours unpack in one go
        return unpack(data, self.bits, min((last + 1) * self.block_ids, self.n) - base)[start - base:stop - base]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, start, ids, CRC-32 of the ids as little-endian ``uint32``) of
        each document, read front to back a few blocks at a time."""
        held, at, span = np.zeros(0, np.uint32), 0, SPAN * self.block_ids
        for i, (doc, start, stop) in enumerate(zip(self.docs.tolist(), self.starts.tolist(), self.starts[1:].tolist())):
            crc, p = 0, start
            while p < stop:
                if p >= at + len(held):
                    at = p // span * span
                    held = self.ids(at, min(at + span, self.n)).astype("<u4", copy=False)
                q = min(stop, at + len(held))
                crc = zlib.crc32(held[p - at:q - at], crc)
                p = q
            yield (doc if self.valid[i] else None), start, stop - start, crc


#: A chunk that is one match of letters, perhaps after a space, and what may
#: follow them in one more match: the ids of the two stand one after the other.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD, ENDED = re.compile(f" ?[{LETTERS}]+"), re.compile(f"( ?[{LETTERS}]+)([,.;:!?]+)")
WORDS = 1024         # words encoded as one text


def byte_letters() -> dict[int, int]:
    """Code points that stand for bytes in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file's encoding of whole texts, chunk by chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # a text is cut before white space only, so tokens without it stay whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(f"[{WHITE}{MARK}]", t) for t in self.added):
            raise ValueError("an added token holds white space")
        self.vocabulary = self.tokenizer.get_vocab_size()
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        # with the usual byte-level split a word is one match: the model takes
        # it in the vocabulary's letters, without the split's pattern
        parts = json.loads(self.tokenizer.to_str())
        split, self.words = parts.get("pre_tokenizer") or {}, None
        self.letters = byte_letters()
        cut = "\n".translate(self.letters)
        if (self.newline is not None and parts.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex")
                and not split.get("add_prefix_space") and not any(WORD.search(t) and (WORD.fullmatch(t) or ENDED.fullmatch(t)) for t in self.added)):
            from tokenizers import pre_tokenizers
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(cut, "isolated")
        self.table = ChunkIds(self._encode)

    def _lines(self, tokenizer, parts: list[str], cut: str, n: int) -> list[bytes]:
        """Ids of parts encoded ``n`` at a time as lines of one text."""
        out: list[bytes] = []
        groups = [parts[at:at + n] for at in range(0, len(parts), n)]
        for some, e in zip(groups, tokenizer.encode_batch_fast(list(map(cut.join, groups)), add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.newline) * 4
            data, starts, ends = ids.tobytes(), [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(ids) * 4]
            if len(starts) == len(some):
                out.extend(map(data.__getitem__, map(slice, starts, ends)))
            else:
                out.extend(self._alone(some, tokenizer))
        return out

    def _alone(self, parts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(parts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        text = "\n".join(words).encode().decode("latin-1").translate(self.letters)
        cut = "\n".translate(self.letters)
        return self._lines(self.words, text.split(cut), cut, WORDS) if words else []

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Words by the model, all other chunks by the library as lines of one
        text, which is several times faster than one by one; those with white
        space that could join a line's end or an added token go alone."""
        joined = MARK.join(chunks)
        added = [t for t in self.added if t in joined]
        found: dict[str, bytes] = {}
        words = [c for c, m in zip(chunks, map(WORD.fullmatch, chunks)) if m] if self.words and not added else []
        found.update(zip(words, self._word_ids(words)))
        rest = [c for c in chunks if c not in found] if len(words) < len(chunks) else []
        if self.words and not added:
            ends = {c: m.groups() for c in rest if (m := ENDED.fullmatch(c))}
            new = list({w for w, _ in ends.values()} - found.keys())
            old = [w for w in new if self.table.known(w) is not None]
            found.update((w, self.table.known(w)) for w in old)
            new = [w for w in new if w not in found]
            found.update(zip(new, self._word_ids(new)))
            tails = list({t for _, t in ends.values()})
            ids = dict(zip(tails, self._alone(tails)))
            found.update((c, found[w] + ids[t]) for c, (w, t) in ends.items())
            rest = [c for c in rest if c not in ends]
        alone = [c for c in rest if self.newline is None or UNSAFE.search(c) or any(t in c for t in added)]
        found.update(zip(alone, self._alone(alone) if alone else []))
        lines = [c for c in rest if c not in found] if alone else rest
        found.update(zip(lines, self._lines(self.tokenizer, lines, "\n", LINES) if lines else []))
        return [found[c] for c in chunks]

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) in order, at least once a text; a long
        text comes in several parts."""
        return self.table.stream(texts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    return Encoder(path)


MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode whole texts, each followed by ``end_id``, and write them in
    ascending id order (nulls last; equal ids by a hash of the text) as one
    file a partition under ``folder``.  Null text: the end id alone.  Returns
    the stored manifest ``part, path, n_docs, n_ids, n_bytes, first_id``, where
    ``first_id`` counts the ids of all files before.  Repeated rows are written
    as often as they stand; texts of any length are encoded whole, a part at a
    time; columns besides the two are not looked at; an empty table has an
    empty manifest."""
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, out, w = encoder(tokenizer), None, None
        end = np.array([end_id], np.uint32)
        bits = bits_for(max(own.vocabulary, end_id + 1))
        for b in batches:
            names, now = b.column("id").to_pylist(), -1
            for i, ids in own.encode(t.as_py() for t in b.column("text")):
                if w is None:
                    part = TaskContext.get().partitionId()
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    fs, p = open_fs(path)
                    fs.create_dir(p.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(p, compression=None)
                    w = TokenWriter(out, bits)
                if i != now:
                    if now >= 0:
                        w.extend(end)
                    w.begin(names[i])
                    now = i
                w.extend(ids)
            if now >= 0:
                w.extend(end)
        if w is not None:
            w.close()
            out.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(w.docs)], "n_ids": [w.n],
                                   "n_bytes": [out_size(w)]})

    on_executors(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    files = stored(d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "token-files")
    # a row a file: as many as the range shuffle has partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def out_size(w: TokenWriter) -> int:
    n, b = len(w.docs), len(w.offsets)
    return w.at + n * 9 + (n + 1) * 8 + (b + 1) * 8 + TRAILER.size


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    def read(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first_id").to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as stream:
                    rows = []
                    for doc, start, n, crc in TokenFile(stream, fs.get_file_info(p).size).documents():
                        rows.append((doc, first + start, n, crc))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    on_executors(manifest.sparkSession)
    m = manifest.select("path", "first_id")
    n = max(1, manifest.count())
    return m.repartitionByRange(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])
