"""Line deduplication against plain Python, and the runs by themselves."""

from collections import defaultdict

from pyspark.sql import functions as F

from reco.llm import line_dedup as ld
from tests.llm.tables import DOCS, clashing, docs, empty, sf_documents


def by_hand(rows, min_chars=ld.MIN_CHARS, min_docs=ld.MIN_DOCS):
    """Sorted (id, text kept, lines, dropped) of (id, text) rows."""
    holders = defaultdict(set)

    def key(line):
        return line.strip(ld.SPACE).translate(ld.TO_LOWER)

    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    owner = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in owner or owner[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


LINE = "A line of more than twenty characters"
ROWS = [(1, f"{LINE}\nown text one\n  {LINE.upper()}\t"), (2, f"x\n{LINE.lower()}\n"), (3, LINE), (4, None), (5, ""),
        (6, "short\nshort"), (7, "short"), (8, "short"), (None, f"{LINE}\nlast"), (None, LINE), (9, f"{LINE} \n{LINE}\n\n\x0b"),
        (9, LINE), (10, "Été comme il faut, bien sûr"), (11, "été comme il faut, bien sûr"),
        (12, " " + LINE), (-3, "z" * 19 + "\n" + "z" * 20), (13, "z" * 20), (14, " " * 50 + "z" * 20)]


def test_awkward_rows(spark):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in ROWS], DOCS)
    assert got(ld.deduplicate(d)) == by_hand(ROWS)
    for batches, fanout in ((1, 2), (3, 2), (20, 4)):
        assert got(ld.deduplicate(d, batches=batches, fanout=fanout)) == by_hand(ROWS)


def test_shared_rows_and_long_texts(spark):
    assert got(ld.deduplicate(docs(spark))) == by_hand(pairs(docs(spark)))


def test_documents(spark):
    d = sf_documents(spark)
    want = by_hand(pairs(d))
    assert sum(r[3] for r in want) > 0
    assert got(ld.deduplicate(d)) == want


def test_empty_and_no_line(spark):
    assert ld.deduplicate(empty(spark, DOCS)).collect() == []
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert got(ld.deduplicate(some)) == [(1, "a", 1, 0), (2, "", 1, 0)]


def test_clashing_columns(spark):
    names = ["id", "t", "h1", "h2", "n", "owner", "gone", "_gone", "_gone_id", "_text_hash", "batch", "N_LINES", "n_dropped"]
    out = ld.deduplicate(clashing(docs(spark), *names))
    assert set(names[:-2]) <= set(out.columns) and out.filter("owner <> 'x' OR n <> 'x'").count() == 0
    assert got(out) == by_hand(pairs(docs(spark)))


def test_runs_hold_each_key_once(spark):
    runs = ld.LineRuns(spark, 4, fanout=2)
    first = {}
    for b in range(5):
        keys = [(k, k * 7, 1, 100 - b) for k in range(b * 3, b * 3 + 10)]
        fresh, seen = runs.add(spark.createDataFrame(keys, "h1 long, h2 long, n long, owner long"))
        new = {k for k, *_ in keys} - set(first)
        assert {r.h1 for r in fresh.collect()} == new
        assert {r.h1 for r in seen.collect()} == {k for k, *_ in keys} - new
        first |= dict.fromkeys(new, 100 - b)
        assert len(runs.runs()) <= 4
    held = [(r.h1, r.owner) for run in runs.runs() for r in run.collect()]
    assert sorted(held) == sorted(first.items())
    assert {r.h1 for r in runs.held(3).collect()} == {k for k in first if sum(b * 3 <= k < b * 3 + 10 for b in range(5)) >= 3}
    runs.close()


def test_runs_join_without_a_shuffle_of_their_side(spark):
    runs = ld.LineRuns(spark, 4, fanout=9)
    for b in range(2):
        runs.add(spark.range(10).select("id", (F.col("id") + b).alias("h2")).select(F.col("id").alias("h1"), "h2", F.lit(1).alias("n"), F.lit(b).alias("owner")))
    a, b = runs.runs()
    plan = a.join(b.select(*ld.KEY).hint("merge"), ld.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
