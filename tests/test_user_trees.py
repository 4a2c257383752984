"""Trees of all users at once, against one grown by plain recursion."""

import numpy as np
import pytest

from reco.operators import user_trees as UT


def gini(y):
    return 2.0 * sum(y) * (len(y) - sum(y)) / len(y) if y else 0.0


def tree_by_hand(rows, depth=0, max_depth=UT.MAX_DEPTH):
    """rows: (label, features); the prediction function of the tree."""
    y = [r[0] for r in rows]
    best = None
    if 0 < sum(y) < len(y) and depth < max_depth:
        for k in range(len(rows[0][1])):
            for v in sorted({r[1][k] for r in rows}):
                left = [r[0] for r in rows if (r[1][k] <= v if k < UT.N_NUMERIC else r[1][k] == v)]
                if len(left) < len(y):
                    pos, n = sum(left), len(left)
                    gain = round(gini(y) - 2.0 * pos * (n - pos) / n - 2.0 * (sum(y) - pos) * ((len(y) - n) - (sum(y) - pos)) / (len(y) - n), 9)
                    if best is None or (-gain, k, v) < best[:3]:
                        best = (-gain, k, v)
    if best is None:
        return lambda f: int(2 * sum(y) > len(y))
    _, k, v = best

    def goes(f):
        return f[k] <= v if k < UT.N_NUMERIC else f[k] == v
    a = tree_by_hand([r for r in rows if goes(r[1])], depth + 1, max_depth)
    b = tree_by_hand([r for r in rows if not goes(r[1])], depth + 1, max_depth)
    return lambda f: a(f) if goes(f) else b(f)


def some_rows(sizes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for u, n in sizes.items():
        for i in range(n):
            f = [f"{rng.integers(0, 8):04d}" for _ in range(UT.N_NUMERIC)] + [str(rng.choice(["a", "b", "c"])) for _ in range(3)]
            y = int((int(f[0]) > 3) ^ (f[5] == "b") if rng.random() < 0.85 else rng.integers(0, 2))
            out.append((u, i, y, f, bool(rng.random() < 0.3)))
    return out


SCHEMA = "user_id long, item_id long, label int, f array<string>, test boolean"


@pytest.mark.parametrize("max_depth", [UT.MAX_DEPTH, 2])
def test_trees_of_all_users_at_once(spark, max_depth):
    rows = some_rows({1: 200, 2: 40, 3: 12, 4: 2, 5: 1})
    rows += [(6, i, 1, ["0001"] * 5 + ["a"] * 3, i % 2 == 0) for i in range(6)]        # one class
    rows += [(7, i, i % 2, ["0001"] * 5 + ["a"] * 3, i > 3) for i in range(6)]         # alike but of two classes
    rows += [(8, 1, 1, ["0001"] * 5 + ["a"] * 3, True)]                                # nothing to learn from
    res = UT.per_user_trees(spark.createDataFrame(rows, SCHEMA), max_depth)
    got = {(r.user_id, r.item_id): r.prediction for r in res["predictions"].collect()}
    want, right = {}, {}
    for u in range(1, 8):
        train = [(y, f) for w, _, y, f, t in rows if w == u and not t]
        if train:
            predict = tree_by_hand(train, max_depth=max_depth)
            for w, i, y, f, t in rows:
                if w == u and t:
                    want[u, i] = predict(f)
                    right.setdefault(u, []).append(want[u, i] == y)
    assert got == want and len(got) > 50
    assert {r.user_id: round(r.accuracy, 9) for r in res["per_user"].collect()} == {u: round(float(np.mean(v)), 9) for u, v in right.items()}


def test_jobs_follow_the_levels_not_the_users(spark):
    """Twice the users, the same trees each: no more levels."""
    one = some_rows({1: 60})
    many = [(u, *r[1:]) for u in range(20) for r in one]
    a, b = (UT.grow(spark.createDataFrame(r, SCHEMA))[1] for r in (one, many))
    assert a.select("node").distinct().count() == b.select("node").distinct().count()
    assert b.count() == 20 * a.count()


def test_no_rows(spark):
    res = UT.per_user_trees(spark.createDataFrame([], SCHEMA))
    assert res["per_user"].count() == 0 and res["splits"].count() == 0


@pytest.mark.parametrize("max_depth", [UT.MAX_DEPTH, 3])
def test_chunks_and_levels_grow_the_same_trees(spark, monkeypatch, max_depth):
    """Users dealt whole need no job a level, and end in the nodes, splits and
    votes of those grown by levels; nulls, rows listed twice, several chunks."""
    rows = some_rows({u: 1 + 9 * u for u in range(9)}, seed=4)
    rows += rows[:20] + [(20, i, None if i % 5 == 0 else i % 2, ["0001", None, f"{i % 3:04d}", "0002", "0003", "a", None if i % 2 else "b", "é"], i % 4 == 3)
                         for i in range(12)] + [(21, i, None, ["0001"] * 5 + ["a"] * 3, i == 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(UT, "CHUNK_ROWS", 60)

    def found(pair):
        ended, splits = pair
        return (sorted(map(str, ended.select("user_id", "item_id", "label", "test", "node", "prediction").collect())),
                sorted((r.user_id, r.node, r.feature, str(r.value), round(r.gain, 9)) for r in splits.collect()))

    levels = found(UT.grow_by_levels(df, max_depth))
    assert found(UT.grow(df, max_depth, chunk=40)) == levels     # some of either kind
    with monkeypatch.context() as m:
        m.setattr(UT, "grow_by_levels", None)
        assert found(UT.grow(df, max_depth)) == levels and levels[1]
