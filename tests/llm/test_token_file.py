import io
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reco.llm import token_file as tf
from reco.llm.common import shared_path
from reco.llm.queries import END_ID, TOKENIZER
from tests.llm.tables import DOCS, LONG, clashing, docs, empty, sf_documents

PATH = P.path(TOKENIZER)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 2**31))
def test_packing_roundtrip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    data = tf.pack(ids, bits)
    assert len(data) == -(-n * bits // 8)
    stream = sum(int(v) << (k * bits) for k, v in enumerate(ids))
    assert int.from_bytes(data, "little") == stream
    assert np.array_equal(tf.unpack(data, bits, n), ids)


def test_bits():
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    with pytest.raises(ValueError):
        tf.pack(np.array([4], np.uint32), 2)


@pytest.mark.parametrize("bits,block", [(17, 8), (16, 16), (13, 64), (5, 8192)])
def test_file_roundtrip_and_random_access(bits, block):
    rng, out = np.random.default_rng(1), io.BytesIO()
    w = tf.TokenWriter(out, bits, block)
    texts = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 7, 8, 9, 1000, 0, 5000)]
    names = [3, None, -1, 5, 6, 2**62, 8, 9]
    for name, ids in zip(names, texts):
        w.begin(name)
        for part in np.array_split(ids, 3):
            w.extend(part)
    w.close()
    assert out.tell() == tf.out_size(w)
    f, whole = tf.TokenFile(out, out.tell()), np.concatenate(texts)
    at = 0
    for (name, start, n, crc), want, ids in zip(f.documents(), names, texts):
        assert (name, start, n, crc) == (want, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += n
    for a, b in [(0, 0), (0, 1), (5, 300), (len(whole) - 1, len(whole)), *rng.integers(0, len(whole), (30, 2))]:
        a, b = sorted((int(a), int(b)))
        assert np.array_equal(f.ids(a, b), whole[a:b])
    with pytest.raises(IndexError):
        f.ids(0, len(whole) + 1)
    for bad in (b"", b"x" * 100, out.getvalue()[:-5]):
        with pytest.raises(ValueError):
            tf.TokenFile(io.BytesIO(bad), len(bad))


@lru_cache
def plain_tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from(" \n\t\r\x1c\x1f\x85\xa0's9aé.")), max_size=80))
def test_encoding_is_the_library_s(text):
    text, plain = text.encode("utf-8", "ignore").decode(), plain_tokenizer()
    got = [i for _, part in tf.encoder(PATH).encode([text]) for i in part.tolist()]
    assert got == plain.encode(text, add_special_tokens=False).ids


SPECIAL = "<|endoftext|>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([SPECIAL, "a", " ", "\n", "\t", "  ", "\n ", " the", "'s", "9", ".", "\xa0", "<|", "|>", tf.MARK]), max_size=12))
def test_special_token_in_a_text(parts):
    text = "".join(parts)
    for t in (f"{text}{SPECIAL} b", f"a {SPECIAL} b", f"a{SPECIAL}{text}"):
        got = [i for _, part in tf.encoder(PATH).encode([t, "plain text"]) if _ == 0 for i in part.tolist()]
        assert got == plain_tokenizer().encode(t, add_special_tokens=False).ids and 50256 in got


def expected(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def roundtrip(df):
    m = tf.write_tokens(df, shared_path(df.sparkSession, "tokens"), PATH, END_ID)
    return sorted(map(tuple, tf.read_tokens(m).collect()), key=lambda r: r[1])


def test_whole_table(spark):
    d = sf_documents(spark)
    assert roundtrip(d.repartition(5)) == expected([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    df = clashing(docs(spark), "id", "part", "path")
    got, rows = roundtrip(df), [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = expected(rows)
    # rows of one id may stand in either order
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert roundtrip(empty(spark, DOCS)) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", " the", " The", "été", " straße,", "word.", "...", "a.,b", "×÷", " ªº", "ɐx", "ǀ", " ", "\n", "\n\n", "'s", "12",
                                          SPECIAL, "\t", "end;", " x!?"]), max_size=12).map("".join), max_size=6))
def test_batches_of_texts_are_encoded_as_alone(texts):
    got = [[] for _ in texts]
    for i, part in tf.encoder(PATH).encode(texts):
        got[i] += part.tolist()
    assert got == [plain_tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


def test_generations_of_the_chunk_table():
    """A small table changes generations within a few batches; the ids stay the same."""
    own = tf.Encoder(PATH)
    own.table.held = 5
    texts = [f"some{i % 9} words{i % 4}, and more{i}. " for i in range(60)]
    for _ in range(2):
        for at in range(0, 60, 7):
            some = texts[at:at + 7]
            assert [i.tolist() for i in own.table.ids(some)] == [plain_tokenizer().encode(t, add_special_tokens=False).ids for t in some]
    assert len(own.table.young) < 100 and own.table.old
