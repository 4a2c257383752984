import hashlib
import io
import uuid
import zlib

import pytest

from reco.llm import warc
from reco.llm.common import shared_path
from tests.llm.tables import PAGES, SF, clashing, empty

BIG = "<p>" + "same page " * 30 + "</p>"
ROWS = [(3, "http://a/x", BIG), (1, "http://a/y", BIG), (2, None, BIG), (4, "http://b/", "short"), (5, "http://b/", "short"),
        (6, "http://b/ sp\nace", ""), (7, "u", None), (None, "n", BIG), (1, "http://a/y", BIG), (8, "l", "x\u00e9" * 400_000),
        (9, "h", "a\r\n\r\nb\r\n\r\n" * 20), (None, None, None)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        again = f is not None and i != f and sum((x[2] or "").encode() == p for x in rows) > 1
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def roundtrip(df, with_payload=False):
    manifest = warc.write_archives(df, shared_path(df.sparkSession, "warc"))
    return manifest, warc.read_archives(manifest, with_payload)


def test_awkward_rows(spark):
    df = clashing(spark.createDataFrame(ROWS, PAGES), "digest", "first_id", "payload")
    manifest, back = roundtrip(df)
    got = sorted((tuple(r)[:5] for r in back.collect()), key=repr)
    assert got == expected(ROWS)
    assert manifest.groupBy().sum("n_records").first()[0] == len(ROWS)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    _, back = roundtrip(pages, with_payload=True)
    recs = back.collect()
    assert sorted((tuple(r)[:5] for r in recs), key=repr) == expected(rows)
    text = {r[0]: r[2] for r in rows}
    assert all(r.payload.decode() == text[r.page_id] for r in recs if r.record_type == "response")


def test_empty_table(spark):
    manifest, back = roundtrip(empty(spark, PAGES))
    assert manifest.count() == 0 and back.count() == 0


def one(payload=b"<p>hello</p>" * 20, **kw):
    return warc.record_bytes(7, "http://a/", payload, hashlib.sha256(payload).hexdigest(), None, False, **kw)


def test_members_are_separate_and_read_a_piece_at_a_time():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    data = one(b"x" * 300_000) + one(b"") + one()
    recs = list(warc.read_stream(Slow(data), with_payload=True))
    assert [r.payload_bytes for r in recs] == [300_000, 0, 240]
    z = zlib.decompressobj(31)
    z.decompress(data)
    assert z.eof and z.unused_data[:2] == b"\x1f\x8b"


@pytest.mark.parametrize("old,new", [(b"hello", b"hallo"), (b"Content-Length: 240", b"Content-Length: 241"),
                                     (b"WARC/1.1", b"XARC/1.1"), (b"\r\n\r\n<p>", b"\r\n__<p>")])
def test_damage_is_found(old, new):
    raw = zlib.decompress(one(), 31).replace(old, new)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_stream(io.BytesIO(z.compress(raw) + z.flush())))


def test_truncation_is_found():
    data = one()
    for cut in (10, len(data) // 2, len(data) - 1):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_stream(io.BytesIO(data[:cut])))


def test_unlisted_files_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    manifest = warc.write_archives(spark.createDataFrame(ROWS, PAGES), folder)
    path = manifest.first().path[len("file://"):]
    with open(path.rpartition("/")[0] + "/lost-attempt.warc.gz", "wb") as fh:
        fh.write(b"half a fil")
    assert warc.read_archives(manifest).count() == len(ROWS)
