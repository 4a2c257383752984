import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reco.llm import mixing
from tests.llm.tables import DOCS, clashing, docs, empty, sf_documents


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in open_)
        t = {s: rest * w[s] / share for s in open_} if open_ else {}
        over = [s for s in open_ if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: float(cap * sizes[s]) for s in over}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mixed(df):
    return mixing.mix(df, mixing.word_count(F.col("text")))


def check(df):
    rows = mixed(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r.size == words(r.text)
        sizes[r.source] += r.size
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.takes <= 3
        taken[r.source] += r.takes * r.size
    return sizes, target, taken


def test_sources_meet_their_targets(spark):
    _, target, taken = check(sf_documents(spark))
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())     # ten documents a source


def test_awkward_rows(spark):
    df = clashing(docs(spark), "Size", "_pick", "_rank", "bucket")
    out = mixed(df)
    assert out.count() == df.count()
    check(docs(spark))
    assert mixed(empty(spark, DOCS)).count() == 0
    zeros = mixed(docs(spark, [(1, "", None, "a", 0), (2, None, None, None, 0)])).collect()
    assert [(r.size, r.target, r.takes) for r in zeros] == [(0, 0.0, 0)] * 2


def test_reruns_agree_and_rows_repeat(spark):
    df = sf_documents(spark)
    a, b = (sorted(map(tuple, mixed(df.repartition(n)).select("doc_id", "takes").collect())) for n in (3, 7))
    assert a == b
    size = mixing.word_count(F.col("text"))
    out = mixing.mixed_rows(df, size)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(i for i, n in a for _ in range(n))


def test_one_length_for_most_rows(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "if(id % 50 = 0, 7, 5) AS n")
    out = mixing.mix(df, F.col("n")).groupBy("source").agg(F.sum(F.col("takes") * F.col("size")).alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 4 for r in out)      # the lengths are 5 and 7


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=7), st.floats(0, 1))
def test_small_subset_sums_are_best(hist, part):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    budget = int(part * int((lengths * counts).sum()))
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    base = mixing.proportional(lengths, counts, budget)
    sums = {int((lengths * base).sum())}
    for n, c, b in zip(lengths, counts, base):     # every sum above the proportional part
        sums = {s + n * k for s in sums for k in range(int(c) - b + 1)}
    assert int((lengths * take).sum()) == max(s for s in sums if s <= budget)


def test_long_documents_only():
    lengths, counts = np.array([90_000, 250_000, 1_000_003]), np.array([20, 20, 20])
    for budget in (0, 100_000, 3_000_000, 26_000_000):
        got = int((lengths * mixing.fit_counts(lengths, counts, budget)).sum())
        assert got <= budget and budget - got < 90_000


def test_documents_longer_than_the_programme():
    for hist, budget, best in (({5_000_000: 2}, 5_010_000, 5_000_000), ({5_000_000: 2}, 4_999_999, 0),
                               ({5_000_000: 2, 5_005_000: 2, 9_000_000: 1}, 5_010_000, 5_005_000),
                               ({5_000_000: 2, 4_000: 3}, 5_010_000, 5_008_000),
                               ({3_000_000: 2, 4_000: 3}, 3_010_000, 3_008_000)):
        lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
        assert int((lengths * mixing.fit_counts(lengths, counts, budget)).sum()) == best


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=6), st.floats(0, 1), st.integers(1, 3))
def test_nearest_sums_with_repeats(hist, part, uses):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    budget = int(part * int((lengths * counts).sum()))
    take = mixing.fit_counts(lengths, counts, budget, uses, over=True)
    assert (take >= 0).all() and (take <= counts * uses).all()
    base = mixing.proportional(lengths, counts, budget)
    sums = {int((lengths * base).sum())}
    for n, c, b in zip(lengths, counts, base):
        sums = {s + n * k for s in sums for k in range(int(c) * uses - b + 1)}
    got = int((lengths * take).sum())
    # sums over the budget are looked for up to twice what the programme has left
    assert abs(got - budget) <= min(abs(s - budget) for s in sums if s <= 2 * budget - int((lengths * base).sum()))


def test_many_lengths_beyond_the_programme():
    """Documents of over 4.2 million words: the nearest sum to within a unit for each of the few that fit."""
    rng = np.random.default_rng(5)
    lengths = rng.choice(np.arange(5_000_000, 20_000_000), 9, replace=False)
    for budget in (11_000_000, 37_500_000, 64_000_001):
        got = int((lengths * mixing.fit_counts(lengths, np.ones(9, np.int64), budget)).sum())
        every = [sum(int(n) for k, n in enumerate(lengths) if m >> k & 1) for m in range(512)]
        base = int((lengths * mixing.proportional(lengths, np.ones(9, np.int64), budget)).sum())
        best = max(s for s in every if s <= budget)
        assert base == 0 and got <= budget and best - got <= 16 * -(-budget // mixing.DP_LIMIT)


def test_a_corpus_with_the_mix_s_own_names(spark):
    df = clashing(docs(spark), "size", "source_size", "Target", "takes")
    out = mixing.mixed_rows(df, mixing.word_count(F.col("text")))
    assert out.columns == df.columns and {r.takes for r in out.collect()} == {"x"}
    plain = mixing.mixed_rows(docs(spark), mixing.word_count(F.col("text")))
    assert out.count() == plain.count()
