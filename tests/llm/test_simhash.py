import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reco.llm import simhash
from tests.llm.tables import DOC_ROWS, DOCS, LONG, clashing, docs, empty, sf_documents


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if s and 2 * ones[b] > len(s))


def brute_components(fps, radius=4):
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= radius and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


def signed(x):
    return int(np.uint64(x).astype(np.int64)) if x < 1 << 63 else x - (1 << 64)


def test_fingerprints(monkeypatch):
    texts = [t for _, t, *_ in DOC_ROWS if t != LONG] + ["ONE two", "x", "a b c d", LONG[:3000]]
    want = [brute_fp(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 3)
    assert [simhash.fingerprint(t) for t in texts] == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def near(rng, f, bits):
    for b in rng.sample(range(64), bits):
        f ^= 1 << b
    return f


def check_components(spark, fps, n=None):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, n or len(fps))).collect()}
    want = brute_components(fps)
    classes = {}
    for f in fps:
        classes.setdefault(want[f], set()).add(signed(f))
    mine = {}
    for f in fps:
        mine.setdefault(got.get(signed(f), signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [near(rng, f, k) for f in fps[:40] for k in (3, 4, 5, 6)]
    fps += [0, (1 << 64) - 1, 1, 3 << 62]
    fps = list(dict.fromkeys(fps))
    check_components(spark, fps)
    check_components(spark, fps, n=1 << 24)         # runs of another scheme
    monkeypatch.setattr(simhash, "CHUNK", 16)       # a block in chunks
    monkeypatch.setattr(simhash, "TILE", 8)
    check_components(spark, fps)


def test_long_chain(spark):
    fps, f = [], 0
    for b in range(0, 64, 4):
        f |= 0xF << b
        fps.append(f)
    check_components(spark, fps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=30, unique=True), st.integers(0, 4))
def test_forest_in_numpy(values, radius):
    x = np.array(values, np.uint64)
    edges = simhash.forest(x, None, radius)
    assert all((int(a) ^ int(b)).bit_count() <= radius for a, b in edges)
    assert len(edges) == len(values) - len(set(brute_components(values, radius).values()))


def brute(rows):
    fps = {t: brute_fp(t) if t != LONG else simhash.fingerprint(t) for _, t in rows}
    root = brute_components(set(fps.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fps[t]]] = min(least.get(root[fps[t]], i), i)
    return sorted(((i, signed(fps[t]), least.get(root[fps[t]])) for i, t in rows), key=repr)


def test_tables(spark):
    for df in (clashing(docs(spark), "fp", "row_key", "block"), sf_documents(spark), empty(spark, DOCS)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = simhash.decisions(df).select("doc_id", "fp", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    df = clashing(sf_documents(spark), "_row_key", "fp")
    d = simhash.decisions(df)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in d.collect()})
    awkward = simhash.deduplicate(docs(spark)).collect()
    assert len({simhash.fingerprint(r.text) for r in awkward}) == len({simhash.fingerprint(t) for _, t, *_ in DOC_ROWS})
    assert simhash.deduplicate(empty(spark, DOCS)).count() == 0


def test_block_scheme_covers_every_pair():
    for n in (0, 1, 10**4, 10**7, 10**9, 10**11):
        parts, bits = simhash.block_scheme(n)
        assert parts > simhash.RADIUS and bits <= (parts - simhash.RADIUS) * (64 // parts)
        assert n >> bits <= 2 * simhash.BLOCK
