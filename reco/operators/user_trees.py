"""A decision tree for every user, all grown together level by level.

A row is one rating with its item's features: the numeric part of the unit
content vector in ``BINS`` bins of equal width, and the item's categories.  A
level is one aggregation of (user, node, feature, bin) counts over all users,
combined in the map tasks, from which the split of every node follows by sums
over bins: a numeric feature splits at a bin, a category by equality.  So a
level costs a job whatever the number of users, a user with very many rows is
spread over all tasks, and only counts meet.

Users of at most ``CHUNK`` rows need no job a level: whole users are dealt to
chunks, and the task of a chunk goes through the same levels, with the same
sums, for all its users together.  Both ways give the same trees.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reco.operators.evaluate import accuracy
from reco.operators.blocks import block_of
from reco.operators.features import CATEGORY_FEATURES, Z_COLS, content_features
from reco.session import app_scratch_dir

BINS = 128
MAX_DEPTH = 40
CHUNK = 4096             # rows of a user that is dealt whole
CHUNK_ROWS = 32_768      # rows of such users in a chunk, about
NODE = ["user_id", "node"]
N_NUMERIC = len(Z_COLS)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{app_scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def item_bins(catalog: DataFrame) -> DataFrame:
    """``item_id, f``: the item's features as strings of fixed width, numeric
    ones by bin, then the categories."""
    f = content_features(catalog)
    norm = F.sqrt(sum((F.col(z) * F.col(z) for z in Z_COLS), F.lit(float(len(CATEGORY_FEATURES)))))
    bins = [F.lpad(F.least(F.lit(BINS - 1), F.floor((F.col(z) / norm + 1) * (BINS / 2))).cast("string"), 4, "0") for z in Z_COLS]
    return f.select(F.col("id").alias("item_id"), F.array(*bins, *[F.col(c).cast("string") for c in CATEGORY_FEATURES]).alias("f"))


def _impurity(n: Column, pos: Column) -> Column:
    """Gini impurity times the number of rows."""
    return 2.0 * pos * (n - pos) / n


def best_splits(rows: DataFrame) -> DataFrame:
    """``user_id, node, feature, value, gain`` of each node of ``rows``
    (user_id, node, label, f) that has both classes and some split; the
    largest gain, of equal ones the first feature and the smallest value."""
    counts = (rows.select(*NODE, "label", F.posexplode("f").alias("feature", "value"))
              .groupBy(*NODE, "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")))
    of_node = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("all_n"), F.sum("label").alias("all_pos"))
    up_to = Window.partitionBy(*NODE, "feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)     # at most BINS rows
    numeric = F.col("feature") < N_NUMERIC
    sums = (counts.filter(numeric).withColumns({"ln": F.sum("n").over(up_to), "lp": F.sum("pos").over(up_to)})
            .unionByName(counts.filter(~numeric).withColumns({"ln": F.col("n"), "lp": F.col("pos")})))
    j = sums.join(of_node.filter("all_pos > 0 AND all_pos < all_n"), NODE).filter(F.col("ln") < F.col("all_n"))
    gain = F.round(_impurity(F.col("all_n"), F.col("all_pos")) - _impurity(F.col("ln"), F.col("lp"))
                   - _impurity(F.col("all_n") - F.col("ln"), F.col("all_pos") - F.col("lp")), 9)
    return (j.groupBy(*NODE).agg(F.min(F.struct((-gain).alias("g"), "feature", "value")).alias("s"))
            .select(*NODE, "s.feature", "s.value", (-F.col("s.g")).alias("gain")))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to 9 digits as Spark's ``round`` does."""
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def _splits_of(node: np.ndarray, label: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """``best_splits`` of rows sorted by node: positions of the nodes' first
    rows that split, with feature, value (code) and gain."""
    start = np.r_[0, np.flatnonzero(np.diff(node)) + 1]
    n_of, p_of = np.diff(np.r_[start, len(node)]), np.add.reduceat(label, start)
    of = np.repeat(np.arange(len(start)), n_of)
    found = []
    for k in range(f.shape[1]):
        o = np.lexsort((f[:, k], of))
        at, value, y = of[o], f[o, k], label[o]
        first = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(value) != 0)) + 1]
        n, p, at, value = np.diff(np.r_[first, len(y)]), np.add.reduceat(y, first), at[first], value[first]
        if k < N_NUMERIC:       # all up to the value
            n, p = np.cumsum(n) - (start[at]), np.cumsum(p) - (np.cumsum(p_of) - p_of)[at]
        found.append((at, np.full(len(at), k), value, n, p))
    at, feature, value, n, p = (np.concatenate(x) for x in zip(*found))
    use = (p_of[at] > 0) & (p_of[at] < n_of[at]) & (n < n_of[at])
    at, feature, value, n, p = (x[use] for x in (at, feature, value, n.astype("float64"), p.astype("float64")))
    all_n, all_p = n_of[at].astype("float64"), p_of[at].astype("float64")

    def impurity(n, p):
        return 2.0 * p * (n - p) / n

    gain = _half_up(impurity(all_n, all_p) - impurity(n, p) - impurity(all_n - n, all_p - p))
    o = np.lexsort((value, feature, -gain, at))
    o = o[np.r_[True, np.diff(at[o]) != 0]] if len(o) else o
    return start[at[o]], feature[o], value[o], gain[o]


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of strings in their order, null the first of all, and the strings."""
    d = column.dictionary_encode()
    names = np.array(d.dictionary.to_pylist(), dtype=object)
    order = np.argsort(names, kind="stable") if len(names) else np.array([], "int64")
    place = np.empty(len(names), "int64")
    place[order] = np.arange(1, len(names) + 1)
    codes = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    return np.where(codes >= 0, place[codes] if len(names) else 0, 0), np.r_[np.array([None], dtype=object), names[order]]


def _chunk(max_depth: int):
    """All trees of a chunk's users, level by level: its rows with node and
    prediction, and rows (kind 1) of its splits."""
    def trees(table: pa.Table) -> pa.Table:
        table = table.sort_by("user_id").combine_chunks()
        _, user = np.unique(table.column("user_id").to_numpy(), return_inverse=True)
        label = table.column("label").fill_null(0).to_numpy().astype("int64")
        known = table.column("label").is_valid().to_numpy().astype("int64")
        test = table.column("test").to_numpy(zero_copy_only=False).astype(bool)
        lists = table.column("f").combine_chunks()
        wide = len(lists[0])
        values, names = zip(*(_codes(lists.flatten().take(pa.array(np.arange(k, wide * len(table), wide)))) for k in range(wide)))
        f = np.stack(values, axis=1)
        node = np.ones(len(table), "int64")
        live = np.ones(len(table), bool)
        splits = []
        for _ in range(max_depth):
            rows = np.flatnonzero(live & ~test)
            if not len(rows):
                break
            rows = rows[np.lexsort((node[rows], user[rows]))]
            group = np.r_[0, np.cumsum((np.diff(user[rows]) != 0) | (np.diff(node[rows]) != 0))]
            first, feature, value, gain = _splits_of(group, label[rows], f[rows])
            if not len(first):
                break
            who, where = user[rows[first]], node[rows[first]]
            splits.append((rows[first], where, feature, np.array([names[k][v] for k, v in zip(feature, value)], dtype=object), gain))
            # every live row looks up the split of its (user, node)
            keys, inverse = np.unique(np.stack([np.r_[who, user[live]], np.r_[where, node[live]]], axis=1), axis=0, return_inverse=True)
            split = np.full(len(keys), -1)
            split[inverse[:len(who)]] = np.arange(len(who))
            mine = split[inverse[len(who):]]
            at = np.flatnonzero(live)
            live[at[mine < 0]] = False
            at, mine = at[mine >= 0], mine[mine >= 0]
            x, v = f[at, feature[mine]], value[mine]
            left = np.where(feature[mine] < N_NUMERIC, (x <= v) & (x > 0) & (v > 0), x == v)
            node[at] = 2 * node[at] + ~left
        keys, inverse = np.unique(np.stack([user, node], axis=1), axis=0, return_inverse=True)
        learnt = ~test
        n, pos, told = (np.bincount(inverse[learnt], w[learnt], len(keys)) for w in (np.ones(len(user)), label, known))
        rows = {"kind": pa.array(np.zeros(len(table), "int32")), **{c: table.column(c) for c in ("user_id", "item_id", "label", "test")},
                "node": pa.array(node), "prediction": pa.array((2 * pos > n).astype("int32")[inverse], mask=(told == 0)[inverse]),
                "feature": pa.nulls(len(table), pa.int32()), "value": pa.nulls(len(table), pa.string()), "gain": pa.nulls(len(table), pa.float64())}
        out = [pa.table(rows)]
        for at, where, feature, value, gain in splits:
            none = {c: pa.nulls(len(at), rows[c].type) for c in ("item_id", "label", "test", "prediction")}
            out.append(pa.table({"kind": pa.array(np.ones(len(at), "int32")), "user_id": table.column("user_id").take(pa.array(at)), **none, "node": pa.array(where),
                                 "feature": pa.array(feature.astype("int32")), "value": pa.array(value.tolist(), pa.string()), "gain": pa.array(gain)}).select(out[0].column_names))
        return pa.concat_tables(out)
    return trees


def grow(rows: DataFrame, max_depth: int = MAX_DEPTH, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``rows``: (user_id, item_id, label, f, test).  Returns (user_id, item_id,
    label, test) with the ``node`` that a row ends in and its ``prediction`` (1
    where most training rows of the node are 1), and the splits of all levels.
    Node ``k`` has children ``2k`` and ``2k + 1``; a node is a leaf once its
    training rows are of one class, or alike, or at ``max_depth``.  Users of more
    than ``chunk`` rows are grown by Spark's levels (``grow_by_levels``)."""
    stored = _written(rows.select("user_id", "item_id", "label", "f", "test"), "tree-input")
    sizes = stored.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0]
    large = sizes.filter((F.col("n") > chunk) | F.col("user_id").isNull()).select("user_id")
    some_large = large.limit(1).count() > 0
    parts = max(1, -(-int(total or 0) // CHUNK_ROWS), min(2 * stored.sparkSession.sparkContext.defaultParallelism, -(-int(total or 0) // CHUNK)))
    whole = stored.join(large, "user_id", "left_anti").filter(F.col("user_id").isNotNull()) if some_large else stored
    kinds = ", ".join(f"{n} {stored.schema[n].dataType.simpleString()}" for n in ("user_id", "item_id", "label"))
    made = _written(whole.withColumn("_c", block_of("user_id", parts, 11)).repartition(parts, "_c").groupBy("_c").applyInArrow(
        _without("_c", _chunk(max_depth)), f"kind int, {kinds}, test boolean, node long, prediction int, feature int, value string, gain double"), "trees")
    ended = made.filter("kind = 0").select("user_id", "item_id", "label", "test", "node", "prediction")
    splits = made.filter("kind = 1").select(*NODE, "feature", "value", "gain")
    if some_large:
        more, their = grow_by_levels(stored.join(large.select(F.col("user_id").alias("_u")), F.col("user_id").eqNullSafe(F.col("_u")), "left_semi"), max_depth)
        ended, splits = ended.unionByName(more.select(*ended.columns)), splits.unionByName(their)
    return ended, splits


def _without(column: str, run):
    def of_group(table: pa.Table) -> pa.Table:
        return run(table.drop_columns([column]))
    return of_group


def grow_by_levels(rows: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``grow`` with a job a level, for users of any size.  ``rows``: (user_id, item_id, label, f, test).  Returns the rows with the
    ``node`` they end in and its ``prediction`` (1 where most training rows of
    the node are 1), and the splits of all levels.  Node ``k`` has children
    ``2k`` and ``2k + 1``; a node is a leaf once its training rows are of one
    class, or alike, or at ``max_depth``."""
    live = _written(rows.select("user_id", "item_id", "label", "f", "test", F.lit(1).cast("long").alias("node")), "tree-rows")
    done, levels = [], []
    for _ in range(max_depth):
        splits = _written(best_splits(live.filter(~F.col("test"))), "tree-splits")
        if not splits.limit(1).count():
            break
        levels.append(splits)
        left = F.when(F.col("feature") < N_NUMERIC, F.element_at("f", F.col("feature") + 1) <= F.col("value")).otherwise(
            F.element_at("f", F.col("feature") + 1).eqNullSafe(F.col("value")))
        j = live.join(splits.select(*NODE, "feature", "value"), NODE, "left")
        moved = j.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1))
        stays = F.col("feature").isNull()
        new = _written(moved.withColumn("leaf", stays).drop("feature", "value"), "tree-rows")
        done.append(new.filter("leaf").drop("leaf"))
        live = new.filter(~F.col("leaf")).drop("leaf")
    ended = live
    for d in done:
        ended = ended.unionByName(d)
    votes = (ended.filter(~F.col("test")).groupBy(*NODE)
             .agg((2 * F.sum("label") > F.count(F.lit(1))).cast("int").alias("prediction")))
    splits = None
    for s in levels:
        splits = s if splits is None else splits.unionByName(s)
    if splits is None:
        splits = best_splits(live.filter(~F.col("test")))
    return ended.join(votes, NODE, "left"), splits


def per_user_trees(rows: DataFrame, max_depth: int = MAX_DEPTH, chunk: int = CHUNK) -> dict:
    """Trees of all users: {"predictions" (test rows; a user without training
    rows has none), "accuracy", "per_user", "splits"}."""
    ended, splits = grow(rows, max_depth, chunk)
    p = ended.filter(F.col("test") & F.col("prediction").isNotNull()).select("user_id", "item_id", "label", "prediction")
    per_user = p.groupBy("user_id").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
                                        F.count(F.lit(1)).alias("n_test"))
    return {"predictions": p, "accuracy": accuracy(p), "per_user": per_user, "splits": splits}
