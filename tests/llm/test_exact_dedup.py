import hashlib
from collections import defaultdict

from reco.llm import exact_dedup
from tests.llm.tables import DOC_ROWS, DOCS, clashing, docs, empty, sf_documents


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=repr):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_decisions(spark):
    for df in (clashing(docs(spark), "digest", "salt", "id", "keep_id"), sf_documents(spark), empty(spark, DOCS)):
        got = sorted(map(tuple, exact_dedup.decisions(df).collect()), key=repr)
        assert got == brute(rows_of(df))


def test_kept_rows(spark):
    df = clashing(docs(spark), "_digest", "_size", "_keep_id")
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(rows_of(kept), key=repr) == sorted(((k, next(t for i, t in rows_of(df) if (t or "") == x and i == k))
                                                      for k, x in {(max((i for i, u in rows_of(df) if (u or "") == t and i is not None), default=None), t)
                                                                   for t in {t or "" for _, t in rows_of(df)}}), key=repr)
    assert exact_dedup.deduplicate(empty(spark, DOCS)).count() == 0


def test_large_group_of_copies(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) AS text")
    d = exact_dedup.decisions(df)
    assert d.count() == 6000 and d.filter("kept").count() == 4001
    assert {(r.keep_id, r.group_size) for r in d.filter("doc_id % 3 = 0").collect()} == {(5997, 2000)}


def test_repeats_of_one_row(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("doc_id", "text", "explode(sequence(1, 10000)) AS n").drop("n")
    d = exact_dedup.decisions(df)
    assert d.count() == 10000 and d.filter("kept").count() == 1
    assert exact_dedup.deduplicate(df).count() == 1


def test_shared_digest_is_told_apart(spark, monkeypatch):
    """With a digest that all texts share, the texts themselves decide."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("0" * 64))
    df = docs(spark)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(df).collect() if r.doc_id is not None)
    assert got == sorted(x[:4] for x in brute(rows_of(df)) if x[0] is not None)
    kept = exact_dedup.deduplicate(df)
    assert kept.count() == len({t or "" for _, t in rows_of(df)})
