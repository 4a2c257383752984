"""Best unseen pairs of the sparse product, against plain loops."""

import numpy as np

from reco.operators import blocks, neighborhood as NB


def by_hand(r, near, by, n):
    best = {}
    users, items = sorted({u for u, _, _ in r}), sorted({i for _, i, _ in r})
    targets = sorted({e for e, _, _ in near})
    rated = {(u, i) for u, i, _ in r}
    for u in (users if by == "item" else targets):
        found = []
        for t in (targets if by == "item" else items):
            x = [(w, v) for e, p, w in near for a, i, v in r
                 if (e == t and a == u and p == i if by == "item" else e == u and a == p and i == t)]
            num, den = sum(w * v for w, v in x if v is not None), sum(abs(w) for w, _ in x)
            if any(v is None for _, v in x) or num <= 0 or (u, t) in rated:
                continue
            found.append((-round(num / den, 9), t, num / den))
        best.update({(u, k): (t, p) for k, (_, t, p) in enumerate(sorted(found)[:n], 1)})
    return best


def test_unseen_pairs_by_lists(spark, monkeypatch):
    """No row goes to a cell by itself; small tiles, several blocks of either
    side, both directions, ratings that are null, fractions or listed twice."""
    def refuse(*args, **kw):
        raise AssertionError("a row for every block of the other side")

    rng = np.random.default_rng(5)
    near = [(e, int(p), float(w)) for e in range(20) for p, w in zip(rng.choice(20, 5, replace=False), rng.normal(0.3, 1, size=5)) if p != e]
    near += near[:10]
    monkeypatch.setattr(blocks, "sparse_product", refuse)
    for values in ([1.0, 2.0, 5.0], [0.5, 2.25, None]):
        r = [(int(u), int(i), values[int(x)]) for u, i, x in zip(rng.integers(0, 20, 120), rng.integers(0, 20, 120), rng.integers(0, 3, 120))]
        r += r[:5]
        ratings = spark.createDataFrame(r, "user_id long, item_id long, rating double")
        neighbours = spark.createDataFrame(near, "e1 long, e2 long, weight double")
        for by in ("item", "user"):
            want = by_hand(r, near, by, 4)
            for cells, options in ((None, {}), ((3, 4), {"max_cell": 16})):
                with monkeypatch.context() as m:
                    if cells:
                        m.setattr(blocks, "_panel_cells", lambda *a: cells)
                    got = {(x.user_id, x["rank"]): (x.item_id, x.pred_rating) for x in NB.knn_recommendations(neighbours, ratings, by, 4, **options).collect()}
                assert got.keys() == want.keys()
                assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_few_copies_are_sent():
    """The sizes of sf0.1: 15,000 users' 594,000 ratings, 20,000 items of 200 neighbours; and 60 times that."""
    for times, most in ((1, 110e6), (60, 70e9)):
        left, right = 594_000 * 5 * times, 4_000_000 * 12 * times
        bl, br = blocks._panel_cells(15_000 * times, 20_000 * times, left, right, 48_000_000, 8)
        assert bl * br >= 16 and left / bl <= 48e6 and right / br <= 48e6
        assert left * br + right * bl < most
    old = blocks._choose_blocks(15_000, 20_000, 594_000, 4_000_000, 4_000_000, 8)
    assert 594_000 * old[1] + 4_000_000 * old[0] > 20_000_000      # rows sent before


def test_one_panel_ranks_in_its_cell(spark, monkeypatch):
    """The ranks of a row are final in its cell and those of several panels; ids
    listed twice, in one tile and in two, ties."""
    rng = np.random.default_rng(2)
    rows = [(int(i % 350), float(round(x, 1)), float(round(y, 1)), "a") for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    monkeypatch.setattr(blocks, "TILE", (7, 64))
    found = []
    for counts in ((2, 1), (2, 3)):
        monkeypatch.setattr(blocks, "_panel_counts", lambda *a: counts)
        got = blocks.dense_topk(df, "id", ["x", "y"], ["c"], 6, measure="cosine")
        assert ("Window" in got._jdf.queryExecution().toString()) == (counts[1] > 1)
        found.append(sorted((r.e1, r["rank"], r.e2, round(r.score, 9)) for r in got.collect()))
    assert found[0] == found[1] and len(found[0]) == 350 * 6
