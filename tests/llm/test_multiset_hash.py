import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reco.llm import multiset_hash as mh
from tests.llm.tables import DOC_ROWS, DOCS, EN, clashing, docs, empty, sf_documents

TEXTS = ["a. b.\nc", "c\na. b.", "c\nb. a.", "", None, "a. b.\nc\nc", "one line", EN]


def words(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: np.array(r.w, np.int64) for r in mh.with_fingerprint(df, "t", "w").collect()}


def test_order_of_paragraphs_does_not_matter(spark):
    w = words(spark, TEXTS)
    assert (w[0] == w[1]).all() and not (w[0] == w[2]).all() and not (w[0] == w[5]).all()
    assert not w[3].any() and not w[4].any()


def test_sums_against_brute_force(spark):
    from xxhash import xxh64_intdigest
    mask = (1 << 64) - 1

    def h(i, p):     # the seed of the text's hash is the number's hash
        seed = np.uint64(xxh64_intdigest(int(i).to_bytes(4, "little"), seed=42))
        return xxh64_intdigest(p.encode(), seed=int(seed))

    text = "\n".join(EN for _ in range(30)) + "\nother line. And more"
    w = words(spark, [text])[0].view(np.uint64)
    paragraphs = [p for p in text.split("\n") if p]
    sentences = [s for s in re.split(mh.RUN, text) if s]
    assert len(sentences) > mh.CHUNK      # so that sums of several chunks are added
    assert int(w[0]) == len(sentences)
    for i in range(mh.WIDE):
        assert int(w[1 + i]) == sum(h(i, p) for p in paragraphs) & mask
    for k in range(mh.HASHES):
        for j in range(mh.SHIFTS):
            want = sum(h(mh.WIDE + k, s) >> j & mh.LANE_MASK for s in sentences) & mask
            assert int(w[1 + mh.WIDE + k * mh.SHIFTS + j]) == want


def test_insertion_and_deletion(spark):
    both = "p one\np two\np three. four"
    df = spark.createDataFrame([(both, "p two", "p one\np three. four")], "a string, b string, c string")
    for c in "abc":
        df = mh.with_fingerprint(df, c, f"w{c}")
    r = df.select((mh.add(F.col("wb"), F.col("wc")) == F.col("wa")).alias("x"), (mh.remove(F.col("wa"), F.col("wb")) == F.col("wc")).alias("y")).first()
    assert r.x and r.y


def test_likeness(spark):
    lines = [f"line number {i}" for i in range(400)]
    pairs = [(1.0, lines, lines[::-1]), (0.75, lines, lines[:300] + [f"x{i}" for i in range(100)]), (0.0, lines, [f"y{i}" for i in range(400)]),
             (1.0, [], []), (0.0, lines, [])]
    df = spark.createDataFrame([(p, "\n".join(a), "\n".join(b)) for p, a, b in pairs], "p double, a string, b string")
    df = mh.with_fingerprint(mh.with_fingerprint(df, "a", "wa"), "b", "wb")
    for r in df.select("p", mh.likeness(F.col("wa"), F.col("wb")).alias("l")).collect():
        assert 0 <= r.l <= 1 and abs(r.l - r.p) <= (0.3 if 0 < r.p < 1 else 0.25 if r.p == 0 else 0)


def check_rows(rows, got):
    """Edited text of each row by the order of ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want


@pytest.mark.parametrize("bucket_rows", [1, 1024])
def test_next_document(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mh, "BUCKET_ROWS", bucket_rows)
    d = sf_documents(spark).filter("doc_id % 7 <> 3")
    got = mh.fingerprints(d).collect()
    check_rows([tuple(r) for r in d.select("doc_id", "text").collect()], got)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_few_rows(spark):
    rows = [(5, "abc" * 9, None, None, None), (None, "other" * 9, None, None, None), (-3, "", None, None, None), (2**61, None, None, None, None)]
    for n in range(1, 5):
        check_rows([r[:2] for r in rows[:n]], mh.fingerprints(docs(spark, rows[:n])).collect())


def test_a_third_without_an_id_are_spread(spark):
    """Null ids, and one id that many rows share, fall into as many buckets as other rows."""
    rows = ([(i, f"text {i}") for i in range(30_000)] + [(None, f"none {i}") for i in range(20_000)] + [(777, f"same {i}") for i in range(10_000)])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tie = F.shiftrightunsigned(F.xxhash64("text"), 11)
    stats = d.agg(F.percentile_approx("doc_id", [i / mh.COARSE for i in range(mh.COARSE + 1)], 10000)).first()[0]
    b = d.select(mh._bucket(F.col("doc_id"), tie, list(stats), len(rows), 20_000).alias("b"), "doc_id", tie.alias("t")).cache()
    sizes = [r["count"] for r in b.groupBy("b").count().collect()]
    assert max(sizes) < 4 * mh.BUCKET_ROWS and len(sizes) > len(rows) / mh.BUCKET_ROWS / 2
    # buckets follow the order: larger ids first, ties rising
    order = [r.b for r in b.orderBy(F.desc_nulls_last("doc_id"), "t").collect()]
    assert order == sorted(order, reverse=True)
    got = {r.text: r.next.text for r in mh.with_next(d, "doc_id", ["text"]).collect()}
    by_id = d.withColumn("t", tie).orderBy(F.desc_nulls_last("doc_id"), "t").collect()
    assert got == {r.text: by_id[(k + 1) % len(by_id)].text for k, r in enumerate(by_id)}


def test_edited_texts_are_nearer_than_the_next(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mh.fingerprints(d).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) >= 0.99
    assert np.mean([r.near_edited < 0.3 for r in got]) < 0.07
    r = words(spark, ["one sentence of some length that nobody ended", "one sentence of some length that nobody wrote"])
    assert (r[0][1 + mh.WIDE:] != r[1][1 + mh.WIDE:]).any() and int(r[0][0]) > 1


def test_awkward_rows(spark):
    out = mh.fingerprints(clashing(docs(spark), "words", "next", "_bucket", "edited")).collect()
    assert len(out) == len(DOC_ROWS)
    by_text = {}
    for r in out:
        by_text.setdefault((r.n_chars, r.fingerprint), 0)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(by_text) == len({t or "" for _, t, *_ in DOC_ROWS})
    assert mh.fingerprints(empty(spark, DOCS)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mh.fingerprints(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
