import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from reco.llm import bpe, pretokens
from reco.llm.queries import RANKS
from tests.llm.tables import DOC_ROWS, DOCS, LONG, clashing, docs, empty, sf_documents

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


def test_every_character(reference, codec):
    for at in range(0, 0x30000, 64):
        chars = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c <= 0xDFFF]
        for text in ("".join(chars), " ".join(chars), " a".join(chars)):
            assert codec.encode([text])[0].tolist() == reference.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003'sS9aé.")), max_size=60))
def test_random_text(reference, codec, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode([text])[0].tolist()
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    assert "".join(pretokens.chunks(text)) == text


def test_long_text_in_pieces(reference, codec):
    assert len(list(pretokens.pieces(LONG))) > 1
    assert codec.encode([LONG])[0].tolist() == reference.encode_ordinary(LONG)


def test_small_cache_changes_nothing(reference):
    own = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    own.table.limit = 3
    text = DOC_ROWS[0][1] * 3
    assert own.encode([text])[0].tolist() == reference.encode_ordinary(text)
    assert len(own.table.known) < 100


def test_texts_together(reference, codec):
    texts = [DOC_ROWS[0][1], None, "", LONG, "a" * 200 + " b", LONG, "x"]
    assert [i.tolist() for i in codec.encode(texts)] == [reference.encode_ordinary(t or "") for t in texts]
    assert [d[0] for d in codec.digests(texts)] == [len(reference.encode_ordinary(t or "")) for t in texts]
    assert not any(len(c) > pretokens.LONG for c in codec.table.known)


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0, b"b": 2})


def expected(reference, rows):
    out = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_tables(spark, reference):
    for df in (clashing(docs(spark), "n_tokens", "ids"), sf_documents(spark), empty(spark, DOCS)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, bpe.digest_documents(df, PATH, P.PATTERN).collect()), key=repr)
        assert got == expected(reference, rows)


def test_ids_and_bytes_roundtrip(spark):
    df = docs(spark).select("doc_id", "text")
    ids = bpe.encode_documents(df, PATH, P.PATTERN)
    back = bpe.decode_documents(ids, PATH, P.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in back), key=repr) == sorted(((i, t or "") for i, t, *_ in DOC_ROWS), key=repr)
