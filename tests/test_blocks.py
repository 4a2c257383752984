"""Blocked all-pairs engine vs brute force."""

import numpy as np
import pandas as pd

from reco.operators import blocks


def _brute_sparse(rows, k):
    df = pd.DataFrame(rows, columns=["e", "d", "v"])
    ents = sorted(df.e.unique())
    vec = {e: dict(zip(g.d, g.v)) for e, g in df.groupby("e")}
    out = []
    for a in ents:
        cand = []
        for b in ents:
            if a == b:
                continue
            dot = sum(v * vec[b].get(d, 0.0) for d, v in vec[a].items())
            if dot == 0:
                continue
            na = np.sqrt(sum(v * v for v in vec[a].values()))
            nb = np.sqrt(sum(v * v for v in vec[b].values()))
            cand.append((-(dot / (na * nb)), b, dot / (na * nb)))
        cand.sort()
        out += [(a, b, s, r + 1) for r, (_, b, s) in enumerate(cand[:k])]
    return out


def _canon(df):
    return sorted((int(r.e1), int(r.e2), round(float(r.score), 9), int(r.rank)) for r in df.itertuples())


def test_sparse_matches_brute_force_and_slicing(spark):
    rng = np.random.default_rng(7)
    rows = {(int(e), int(d)): float(rng.integers(1, 6)) for e, d in zip(rng.integers(0, 40, 600), rng.integers(0, 30, 600))}
    rows = [(e, d, v) for (e, d), v in rows.items()]
    df = spark.createDataFrame(rows, "e long, d long, v double")
    want = sorted((a, b, round(s, 9), r) for a, b, s, r in _brute_sparse(rows, 5))
    got = _canon(blocks.sparse_topk(df, "e", "d", "v", 5, block_rows=8).toPandas())
    assert got == want
    sliced = _canon(blocks.sparse_topk(df, "e", "d", "v", 5, block_rows=8, force_dim_slices=3).toPandas())
    assert sliced == want


def test_sparse_hot_dimension(spark):
    # one "user" (dim 0) rated every item: a hot group, still exact
    rows = [(e, 0, 1.0 + e % 5) for e in range(60)] + [(e, 1 + e % 7, 2.0) for e in range(60)]
    df = spark.createDataFrame(rows, "e long, d long, v double")
    want = sorted((a, b, round(s, 9), r) for a, b, s, r in _brute_sparse(rows, 3))
    assert _canon(blocks.sparse_topk(df, "e", "d", "v", 3, block_rows=16).toPandas()) == want


def test_dense_twins_tie_by_id_and_self_excluded(spark):
    # items 1 and 2 are identical; item 3 differs
    pdf = pd.DataFrame({"id": [1, 2, 3, 4], "x": [1.0, 1.0, -1.0, 0.5], "y": [0.0, 0.0, 0.2, 0.5],
                        "c": ["a", "a", "b", None]})
    df = spark.createDataFrame(pdf)
    r = blocks.dense_topk(df, "id", ["x", "y"], ["c"], 2, measure="cosine_distance", block_rows=2).toPandas()
    top1 = r[r["rank"] == 1].set_index("e1")["e2"].to_dict()
    assert top1[1] == 2 and top1[2] == 1  # twin found, self never listed
    assert (r.e1 != r.e2).all()
    d12 = r[(r.e1 == 1) & (r.e2 == 2)].score.iloc[0]
    assert abs(d12) < 1e-12  # identical vectors: distance 0


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(50, 6))
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(6)])
    pdf["id"] = np.arange(50)
    df = spark.createDataFrame(pdf)
    r = blocks.dense_topk(df, "id", [f"x{i}" for i in range(6)], [], 4, measure="cosine", block_rows=8).toPandas()
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    np.fill_diagonal(S, -np.inf)
    for i in range(50):
        want = list(np.argsort(-S[i], kind="stable")[:4])
        got = list(r[r.e1 == i].sort_values("rank").e2)
        assert got == want


def test_bipartite_excludes_and_matches(spark):
    rng = np.random.default_rng(5)
    U = rng.normal(size=(12, 3))
    V = rng.normal(size=(20, 3))
    left = spark.createDataFrame([(i, U[i].tolist()) for i in range(12)], "id long, v array<double>")
    right = spark.createDataFrame([(j, V[j].tolist()) for j in range(20)], "id long, v array<double>")
    ex = [(i, j) for i in range(12) for j in range(20) if (i + j) % 4 == 0]
    exdf = spark.createDataFrame(ex, "l long, r long")
    r = blocks.bipartite_topk(left, right, "id", "v", 3, exclude=exdf, block_rows=5).toPandas()
    S = U @ V.T
    for i, j in ex:
        S[i, j] = -np.inf
    for i in range(12):
        assert list(r[r.l == i].sort_values("rank").r) == list(np.argsort(-S[i], kind="stable")[:3])


def test_hot_item_triggers_dimension_slicing_automatically(spark, monkeypatch):
    """A hot item (a third of all rows) makes its block exceed the task bound;
    the engine must switch to sliced partial products on its own and stay
    exact."""
    rng = np.random.default_rng(9)
    rows = {(0, int(d)): float(rng.integers(1, 6)) for d in range(300)}  # hot item 0
    rows.update({(int(e), int(d)): float(rng.integers(1, 6))
                 for e, d in zip(rng.integers(1, 40, 500), rng.integers(0, 300, 500))})
    rows = [(e, d, v) for (e, d), v in rows.items()]
    df = spark.createDataFrame(rows, "e long, d long, v double")
    calls = []
    orig = blocks.block_of

    def spy(col, n, seed=0):
        if seed == 17:
            calls.append(n)
        return orig(col, n, seed)

    monkeypatch.setattr(blocks, "block_of", spy)
    got = _canon(blocks.sparse_topk(df, "e", "d", "v", 4, block_rows=8, max_task_rows=200).toPandas())
    assert calls and calls[0] > 1  # dimension slices were used
    want = sorted((a, b, round(s, 9), r) for a, b, s, r in _brute_sparse(rows, 4))
    assert got == want


def test_product_auto_slices_hot_user(spark):
    from reco.operators import neighborhood as NB
    rows = [(0, i, float(1 + i % 5)) for i in range(60)] + [(u, u % 60, 3.0) for u in range(1, 40)] + \
           [(u, (u * 7) % 60, 4.0) for u in range(1, 40)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double").dropDuplicates(["user_id", "item_id"])
    nb, by = NB.neighbors_for("item", df, k=5, block_rows=8)
    a = NB.knn_recommendations(nb, df, by, 5).collect()
    b = NB.knn_recommendations(nb, df, by, 5, max_task_rows=50).collect()  # forces slicing by size
    assert sorted((r.user_id, r.rank, r.item_id) for r in a) == sorted((r.user_id, r.rank, r.item_id) for r in b)


def test_sparse_lists_go_to_their_entities_only(spark, monkeypatch):
    """No copy of the table for every block, whatever the number of blocks;
    dims longer than a list, values that are no small integers."""
    def refuse(*args):
        raise AssertionError("rows copied to every block pair")

    monkeypatch.setattr(blocks, "to_block_pairs", refuse, raising=False)
    monkeypatch.setattr(blocks, "LIST_ROWS", 8)
    rng = np.random.default_rng(11)
    for values in (rng.integers(1, 6, 700), rng.normal(size=700)):
        rows = {(int(e), int(d)): float(v) for e, d, v in zip(rng.integers(0, 50, 700), rng.integers(0, 40, 700), values)}
        rows.update({(e, 0): float(values[e]) for e in range(50)})
        rows = [(e + 2 ** 33, d, v) for (e, d), v in rows.items()]
        df = spark.createDataFrame(rows, "e long, d long, v double")
        want = sorted((a, b, round(s, 9), r) for a, b, s, r in _brute_sparse(rows, 6))
        assert _canon(blocks.sparse_topk(df, "e", "d", "v", 6, block_rows=8).toPandas()) == want
        assert _canon(blocks.sparse_topk(df, "e", "d", "v", 6, block_rows=8, max_task_rows=300).toPandas()) == want


def test_dense_rows_go_to_few_panels(spark, monkeypatch):
    """A table of many blocks is copied for a few panels only; several panels,
    tiles and a long category, nulls, a zero row and equal rows included."""
    def refuse(*args):
        raise AssertionError("rows copied to every block pair")

    monkeypatch.setattr(blocks, "to_block_pairs", refuse, raising=False)
    rng = np.random.default_rng(4)
    X = rng.normal(size=(700, 3))
    X[:30] = X[0]
    X[40] = 0
    c = [None if i % 9 == 0 else f"c{i % 4}" for i in range(700)]
    d = [None if i == 40 else f"d{i % 300}" for i in range(700)]
    c[40] = None
    df = spark.createDataFrame([(i, *map(float, X[i]), c[i], d[i]) for i in range(700)], "id long, x double, y double, z double, c string, d string")
    same = np.array([[float((c[i] is not None and c[i] == c[j]) + (d[i] is not None and d[i] == d[j])) for j in range(700)] for i in range(700)])
    dot = X @ X.T + same
    with np.errstate(invalid="ignore"):
        dist = np.round(2 * (1 - dot / np.sqrt(np.outer(np.diag(dot), np.diag(dot)))), 9)
    np.fill_diagonal(dist, np.inf)
    want = {i: [j for _, j in sorted((v, j) for j, v in enumerate(dist[i]) if np.isfinite(v))[:12]] for i in range(700)}
    for block_rows, tile in ((2048, (256, 4096)), (1, (16, 32))):
        monkeypatch.setattr(blocks, "TILE", tile)
        r = blocks.dense_topk(df, "id", ["x", "y", "z"], ["c", "d"], 12, block_rows=block_rows).toPandas().sort_values(["e1", "rank"])
        got = r.groupby("e1")["e2"].apply(list).to_dict()
        assert got == {i: w for i, w in want.items() if w}
    assert blocks._panel_counts(spark, 1_200_000, 10, 2048) == (19, 3)   # 586 copies of a row before


def test_bipartite_tiles_and_few_panels(spark, monkeypatch):
    """Left and right rows have few copies; equal scores, a zero row, and pairs
    excluded in every tile."""
    rng = np.random.default_rng(6)
    U, V = rng.normal(size=(60, 4)), rng.normal(size=(500, 4)) * rng.exponential(size=(500, 1))
    V[100:120] = V[100]
    U[7] = 0
    left = spark.createDataFrame([(i, U[i].tolist()) for i in range(60)], "id long, v array<double>")
    right = spark.createDataFrame([(j, V[j].tolist()) for j in range(500)], "id long, v array<double>")
    ex = [(i, j) for i in range(60) for j in range(500) if (i * j) % 3 == 0] + [(3, j) for j in range(500)]
    S = np.einsum("ik,jk->ij", U, V)
    for i, j in ex:
        S[i, j] = -np.inf
    for block_rows, tile in ((2048, (256, 4096)), (1, (8, 32))):
        monkeypatch.setattr(blocks, "TILE", tile)
        r = blocks.bipartite_topk(left, right, "id", "v", 9, exclude=spark.createDataFrame(ex, "l long, r long"), block_rows=block_rows).toPandas()
        for i in range(60):
            want = [j for j in np.argsort(-np.round(S[i], 12), kind="stable")[:9] if np.isfinite(S[i, j])]
            assert list(r[r.l == i].sort_values("rank").r) == want, i
    monkeypatch.undo()
    copies = []
    known = blocks._panel_counts
    monkeypatch.setattr(blocks, "_panel_counts", lambda *a: copies.append(known(*a)) or copies[-1])
    blocks.bipartite_topk(left, right, "id", "v", 9, n_left=900_000, n_right=1_200_000)
    assert copies[0][0] <= 14                        # 440 copies of a right row before


def test_seen_pairs_by_lists(spark, monkeypatch):
    """Only rated pairs are predicted; hot dims in parts, hot entities over
    several groups, both directions."""
    from reco.operators import neighborhood as NB

    def refuse(*args, **kw):
        raise AssertionError("every user-item cell multiplied")

    rng = np.random.default_rng(8)
    r = {(int(u), int(i)): float(rng.integers(1, 6)) for u, i in zip(rng.integers(0, 30, 500), rng.integers(0, 40, 500))}
    r.update({(u, 0): 3.0 for u in range(30)})
    near = [(e, int(p), float(w)) for e in range(30) for p, w in zip(rng.choice(40, 8, replace=False), rng.normal(size=8)) if p != e]
    near += near[:40]                                # neighbours listed twice count twice
    ratings = spark.createDataFrame([(u, i, v) for (u, i), v in r.items()], "user_id long, item_id long, rating double")
    neighbours = spark.createDataFrame(near, "e1 long, e2 long, weight double")
    monkeypatch.setattr(blocks, "sparse_product", refuse)
    for by in ("item", "user"):
        errors = []
        for (u, i), v in r.items():
            e = i if by == "item" else u
            found = [(w, r[(u, p) if by == "item" else (p, i)]) for e1, p, w in near if e1 == e and ((u, p) if by == "item" else (p, i)) in r]
            num, den = sum(w * x for w, x in found), sum(abs(w) for w, _ in found)
            if num > 0:
                errors.append(abs(num / den - v))
        for rows in (4096, 6):
            monkeypatch.setattr(blocks, "LIST_ROWS", rows)
            got = NB.knn_mae(neighbours, ratings, by, max_task_rows=200 if rows == 6 else 4_000_000).first()
            assert got.n_pairs == len(errors) and abs(got.mae - np.mean(errors)) < 1e-9


def test_sparse_topk_in_passes(spark):
    """Co-occurrences past a pass's share are worked out entity by entity in
    several stored passes: the same rows, hot dims and entities included, and
    the shuffle of a pass is gone when the next begins."""
    rng = np.random.default_rng(11)
    rows = sorted({(int(e), int(d)) for e, d in zip(rng.integers(0, 90, 900), np.minimum(rng.integers(0, 60, 900), 40))})
    df = spark.createDataFrame([(e, d, float((e * 7 + d) % 5 + 1)) for e, d in rows], "e long, d long, v double")
    want = _canon(blocks.sparse_topk(df, "e", "d", "v", 5, block_rows=8).toPandas())
    assert len(want) > 300
    for options in ({}, {"max_task_rows": 400}, {"force_dim_slices": 2}):
        in_passes = blocks.sparse_topk(df, "e", "d", "v", 5, block_rows=8, pass_rows=3000, **options)
        assert len(in_passes.inputFiles()) > 1 and not any("Exchange" in s for s in in_passes._jdf.queryExecution().executedPlan().toString().split())
        assert _canon(in_passes.toPandas()) == want


def test_seen_products_in_passes(spark):
    """The predictions of rated pairs are the same in several stored passes."""
    rng = np.random.default_rng(12)
    known = sorted({(int(e), int(d)) for e, d in zip(rng.integers(0, 60, 700), np.minimum(rng.integers(0, 50, 700), 35))})
    df = spark.createDataFrame([(e, d, float((e * 5 + d) % 5 + 1)) for e, d in known], "e long, d long, a double")
    near = spark.createDataFrame([(e, p, float((e + 3 * p) % 7 - 1) / 4) for e in range(60) for p in rng.choice(60, 9, replace=False).tolist()], "e long, p long, w double")

    def canon(out):
        return sorted((r.e, r.d, r.a, round(r.pred, 12)) for r in out.collect())

    want = canon(blocks.seen_products(near, df))
    assert len(want) > 200
    for options in ({}, {"force_dim_slices": 3}, {"max_task_rows": 600}):
        got = blocks.seen_products(near, df, pass_rows=2500, **options)
        assert len(got.inputFiles()) > 1 and canon(got) == want
