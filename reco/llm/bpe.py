"""Byte-level BPE through a sentencepiece model built from the vocabulary.

The ranks of a byte-level vocabulary become a sentencepiece BPE model without
any training: each token is a piece written in 256 printable characters, one a
byte, with the negative rank as its score, so that the best-scoring merge is
the one of the lowest rank; the model file is serialised field by field, with
identity normalisation.  Texts are cut by the split pattern, each match is
looked up whole (as rank tokenizers do) or encoded by the model, and ids decode
by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from reco.llm.common import on_executors
from reco.llm.pretokens import ChunkTable

BATCH = 20_000      # pre-tokens in one call of the model
FIRST_SPARE = 256   # bytes that don't print get characters from here on


def byte_characters() -> list[str]:
    """One printable, non-space character for each byte."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(FIRST_SPARE, FIRST_SPARE + 256))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as fh:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}


# Field numbers and enumeration values of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, TYPE_NORMAL, TYPE_UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, MODEL_BPE, VOCAB_SIZE = 3, 2, 4
UNK_ID, BOS_ID, EOS_ID, PAD_ID = 40, 41, 42, 43
NORMALIZER_NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model.  Piece numbers are the ranks (which must be
    0..n-1); one more piece, the last, stands for unknown characters, which
    byte-mapped text never has."""
    char = byte_characters()
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks have gaps")
    out = []
    for rank, token in enumerate(order):
        text = "".join(char[b] for b in token).encode()
        out.append(_block(PIECES, _block(PIECE_TEXT, text) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -float(rank))
                          + _number(PIECE_TYPE, TYPE_NORMAL)))
    out.append(_block(PIECES, _block(PIECE_TEXT, b"<unk>") + _number(PIECE_TYPE, TYPE_UNKNOWN)))
    n = len(order)
    out.append(_block(TRAINER, _number(MODEL_TYPE, MODEL_BPE) + _number(VOCAB_SIZE, n + 1) + _number(UNK_ID, n)
                      + _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1)))
    out.append(_block(NORMALIZER, _block(NORMALIZER_NAME, b"identity") + _number(DUMMY_PREFIX, 0)
                      + _number(EXTRA_SPACES, 0) + _number(ESCAPE_SPACES, 0)))
    return b"".join(out)


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """Encoder and decoder of one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.latin = {b: c for b, c in enumerate(byte_characters())}   # for str.translate of latin-1 text
        self.tokens = sorted(ranks, key=ranks.get)
        self.whole = {t.decode(): array("I", [r]).tobytes() for t, r in ranks.items() if _is_text(t)}
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.table = ChunkTable(self._encode_chunks)

    def _encode_chunks(self, parts: list[str]) -> list[bytes]:
        matches = list(map(self.split.findall, parts))
        distinct = set(chain.from_iterable(matches))
        new = [w for w in distinct if w not in self.whole]
        packed = {w: self.whole[w] for w in distinct if w in self.whole}
        for at in range(0, len(new), BATCH):
            batch = new[at:at + BATCH]
            mapped = [w.encode().decode("latin-1").translate(self.latin) for w in batch]
            packed.update(zip(batch, (array("I", ids).tobytes() for ids in self.model.encode(mapped, out_type=int, num_threads=1))))
        return [b"".join(map(packed.__getitem__, m)) for m in matches]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null counts as empty."""
        packed: list[list[bytes]] = [[] for _ in texts]
        for i, part in self.table.stream(texts):
            packed[i].append(part)
        return [np.frombuffer(b"".join(p), "<u4") for p in packed]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the SHA-256 of the decimal ids joined
        by commas, and that of the decoded bytes; a long text is never held
        whole in ids."""
        now, n, ids_sha, text_sha = -1, 0, hashlib.sha256(), hashlib.sha256()
        for i, part in self.table.stream(texts):
            if i != now:
                if now >= 0:
                    yield n, ids_sha.hexdigest(), text_sha.hexdigest()
                now, n, ids_sha, text_sha = i, 0, hashlib.sha256(), hashlib.sha256()
            ids = np.frombuffer(part, "<u4").tolist()
            if ids:
                ids_sha.update(("," if n else "").encode() + ",".join(map(self.decimal.__getitem__, ids)).encode())
                text_sha.update(self.decode(ids))
                n += len(ids)
        if now >= 0:
            yield n, ids_sha.hexdigest(), text_sha.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, vocabulary file and pattern."""
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of the text.  Null text: no ids."""
    keep = [c for c in docs.columns if c not in (text_col, "ids")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            ids = [i.astype(np.int32) for i in own.encode(b.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    on_executors(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``bytes binary`` in place of the ids.  Null ids: no bytes."""
    keep = [c for c in docs.columns if c not in (ids_col, "bytes")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("bytes", "binary")

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            got = [own.decode(i or []) for i in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(got, pa.binary())], names=[*keep, "bytes"])

    on_executors(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.
    Null text counts as empty; nulls in the id stay; repeated rows each have
    their row; an empty table gives an empty result."""
    schema = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            got = list(own.digests(t.as_py() for t in b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
                 pa.array([g[2] for g in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    on_executors(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
