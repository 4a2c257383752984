"""Blocked all-pairs scoring with exact top-k.

All-pairs similarity is a matrix product.  Instead of a cross join or a
self-join that lists every pair inside a group, dense rows are hashed into left
blocks and into a few large right panels; each (block, panel) cell is one group,
bounded no matter how the data is skewed.  The cell goes through the score
matrix in tiles and emits only each row's best of the panel under one total
order (score key, then partner id).  The final ``row_number() <= k`` per entity
over these lists is exact, because every member of the global top-k is among
the best of its own panel.  Rows of given groups (LSH buckets) go by block pairs
``(lo, hi)`` of the group.

Sparse vectors (ratings) go another way: an entity needs only those that share
a dimension with it, so each dimension's list goes to the entities on it and
an entity's dot products are added up, and its k best taken, in one group.  An
entity with too many co-occurrences for one group (a hot item with a third of
all ratings) has its dimensions cut into slices: each ``(block, slice)`` group
then emits partial dot products, which Spark sums per pair before the top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reco.session import each_pass, in_pass, passes_for, stored

_KEY_INF = np.inf


def min_blocks_for_parallelism(spark: SparkSession) -> int:
    """Smallest B with B(B+1)/2 >= 2 x default parallelism (enough groups to
    keep every core busy even when the data fits one block)."""
    par = max(1, spark.sparkContext.defaultParallelism)
    b = 1
    while b * (b + 1) // 2 < 2 * par:
        b += 1
    return b


MIN_BLOCK_ROWS = 256


def n_blocks(spark: SparkSession, n: int, block_rows: int) -> int:
    """Blocks of at most ``block_rows`` entities; more blocks for parallelism
    only while each keeps at least MIN_BLOCK_ROWS entities (a large cluster
    must not shred a small catalog into near-empty blocks)."""
    need = math.ceil(max(1, n) / block_rows)
    par = min(min_blocks_for_parallelism(spark), math.ceil(max(1, n) / MIN_BLOCK_ROWS))
    return max(1, min(max(1, n), max(need, par)))


def block_of(col: str, n: int, seed: int = 0):
    return F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(n)).cast("int")


# --------------------------------------------------------------------------
# numpy kernels (run inside tasks)

def _local_topk(key: np.ndarray, raw: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray,
                k: int | None, exclude_self: bool) -> pd.DataFrame:
    """Top-k per row of ``key`` (smaller is better; +inf = not a candidate),
    ties by column id (columns are sorted by id, the sort is stable)."""
    if key.shape[0] == 0 or key.shape[1] == 0:
        return pd.DataFrame({"e1": np.array([], "int64"), "e2": np.array([], "int64"),
                             "score": np.array([], "float64"), "_key": np.array([], "float64")})
    key = key.copy()
    if exclude_self:
        pos = np.searchsorted(col_ids, row_ids)
        pos_c = np.minimum(pos, len(col_ids) - 1)
        hit = col_ids[pos_c] == row_ids
        rows = np.nonzero(hit)[0]
        key[rows, pos_c[rows]] = _KEY_INF
    kk = key.shape[1] if k is None else min(k, key.shape[1])
    if kk == 0 or key.shape[0] == 0:
        return pd.DataFrame({"e1": np.array([], "int64"), "e2": np.array([], "int64"),
                             "score": np.array([], "float64"), "_key": np.array([], "float64")})
    finite = np.isfinite(key)
    if finite.mean() < 0.25:
        # sparse cell: sort only the candidates, by (row, key, column id)
        r, c = np.nonzero(finite)
        kv = key[r, c]
        o = np.lexsort((c, kv, r))
        r, c, kv = r[o], c[o], kv[o]
        starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        pos = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
        m = pos < kk
        r, c, kv = r[m], c[m], kv[m]
        return pd.DataFrame({"e1": row_ids[r].astype("int64"), "e2": col_ids[c].astype("int64"),
                             "score": raw[r, c].astype("float64"), "_key": kv.astype("float64")})
    if kk * 4 < key.shape[1]:
        # selection instead of a full sort: the k-th smallest key per row,
        # then every entry at or below it (ties at the boundary included),
        # sorted by (row, key, column id) and cut to k per row
        kth = np.partition(key, kk - 1, axis=1)[:, kk - 1]
        r, c = np.nonzero(key <= kth[:, None])
        kv = key[r, c]
        o = np.lexsort((c, kv, r))
        r, c, kv = r[o], c[o], kv[o]
        starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        pos = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
        m = (pos < kk) & np.isfinite(kv)
        r, c, kv = r[m], c[m], kv[m]
        return pd.DataFrame({"e1": row_ids[r].astype("int64"), "e2": col_ids[c].astype("int64"),
                             "score": raw[r, c].astype("float64"), "_key": kv.astype("float64")})
    order = np.argsort(key, axis=1, kind="stable")[:, :kk]
    sel = np.take_along_axis(key, order, axis=1)
    keep = np.isfinite(sel)
    e1 = np.broadcast_to(row_ids[:, None], order.shape)[keep]
    e2 = col_ids[order][keep]
    sc = np.take_along_axis(raw, order, axis=1)[keep]
    return pd.DataFrame({"e1": e1.astype("int64"), "e2": e2.astype("int64"),
                         "score": sc.astype("float64"), "_key": sel[keep].astype("float64")})


def _rank_key(score: np.ndarray, descending: bool, digits: int | None) -> np.ndarray:
    s = np.round(score, digits) if digits is not None else score
    return -s if descending else s


# --------------------------------------------------------------------------
# dense vectors (content features)

def dense_topk(df: DataFrame, id_col: str, num_cols: list[str], cat_cols: list[str],
               k: int | None, measure: str = "cosine_distance", include_self: bool = False,
               rank_digits: int | None = 9, block_rows: int = 2048,
               n_items: int | None = None, group_col: str | None = None) -> DataFrame:
    """Exact top-k neighbours of every row under cosine similarity of the
    vector ``num_cols ++ one_hot(cat_cols)``.

    The one-hot blocks are never materialised: ``dot = sum(x_a*x_b) +
    sum_c [cat_a == cat_b]`` and ``|v|^2 = sum(x^2) + #non-null cats``.
    A null category is equal to nothing (fill it first to make "missing" a
    category).  ``measure`` is ``cosine`` (descending) or ``cosine_distance``
    = 2(1 - cos) (ascending).  Returns (e1, e2, score, rank).
    """
    spark = df.sparkSession
    descending = measure == "cosine"
    base = df.select(F.col(id_col).cast("long").alias("_id"),
                     *[F.col(c).cast("double").alias(c) for c in num_cols],
                     *[F.col(c).cast("string").alias(c) for c in cat_cols],
                     (F.col(group_col).cast("long") if group_col else F.lit(0).cast("long")).alias("_g"))
    if group_col is None:
        n = n_items if n_items is not None else df.select(id_col).count()
        return _panel_topk(base, n, num_cols, cat_cols, k, measure, include_self, rank_digits, block_rows)
    # Only rows of the same group are compared; each group gets its own
    # number of blocks from its size, so a big group is split into
    # bounded block pairs and small groups stay one task each.
    sizes = base.groupBy("_g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)))
                                   .cast("int").alias("_nb"))
    base = base.join(sizes, "_g")
    base = base.withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int"))
    j = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_j")
    pairs = (base.select("*", j)
             .withColumn("_lo", F.least("_b", "_j")).withColumn("_hi", F.greatest("_b", "_j")).drop("_j"))

    def score_block(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["_lo"].iat[0]), int(pdf["_hi"].iat[0])
        a = pdf[pdf["_b"] == lo].sort_values("_id", kind="stable")
        b = a if lo == hi else pdf[pdf["_b"] == hi].sort_values("_id", kind="stable")
        xa = a[num_cols].to_numpy("float64")
        xb = b[num_cols].to_numpy("float64")
        dot = xa @ xb.T
        na = (xa * xa).sum(axis=1)
        nbv = (xb * xb).sum(axis=1)
        for c in cat_cols:
            # exact integer codes for the category strings of both blocks (-1 = null)
            codes, _ = pd.factorize(pd.concat([a[c], b[c]], ignore_index=True))
            cai, cbi = codes[:len(a)], codes[len(a):]
            va, vb = cai >= 0, cbi >= 0
            dot = dot + ((cai[:, None] == cbi[None, :]) & va[:, None] & vb[None, :])
            na = na + va
            nbv = nbv + vb
        cos = dot / (np.sqrt(na)[:, None] * np.sqrt(nbv)[None, :])
        raw = 2.0 * (1.0 - cos) if measure == "cosine_distance" else cos
        key = _rank_key(raw, descending, rank_digits)
        ida = a["_id"].to_numpy("int64")
        idb = b["_id"].to_numpy("int64")
        outs = [_local_topk(key, raw, ida, idb, k, not include_self)]
        if lo != hi:
            outs.append(_local_topk(key.T, raw.T, idb, ida, k, not include_self))
        return pd.concat(outs, ignore_index=True)

    cols = ["_g", "_id", "_b", "_lo", "_hi", *num_cols, *cat_cols]
    local = (pairs.select(*cols).groupBy("_g", "_lo", "_hi")
             .applyInPandas(score_block, "e1 long, e2 long, score double, _key double"))
    # a pair can meet in several groups (e.g. LSH tables): keep it once
    local = local.groupBy("e1", "e2").agg(F.min_by("score", "_key").alias("score"),
                                          F.min("_key").alias("_key"))
    return _final_topk(local, k)


PANEL_ROWS, LEFT_ROWS, LEFT_ENTRIES = 524_288, 65_536, 4_000_000
TILE = (256, 4096)
#: Scores are screened in single precision; what may be among the best is scored again.
SCREEN = 2e-5
ONE_HOT_VALUES = 256


def _panel_counts(spark: SparkSession, n: int, k: int | None, block_rows: int) -> tuple[int, int]:
    """(left blocks, right panels).  A row is copied once for each panel and
    once for each left block, so both are as few as memory allows."""
    left = min(LEFT_ROWS, max(256, LEFT_ENTRIES // (k or LEFT_ENTRIES)), 32 * block_rows)
    bl = max(math.ceil(n / left), min(2 * max(1, spark.sparkContext.defaultParallelism), math.ceil(n / MIN_BLOCK_ROWS)))
    return max(1, bl), max(1, math.ceil(n / min(PANEL_ROWS, 256 * block_rows)))


def _screened(A: np.ndarray, B: np.ndarray, extra, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries of ``A B'`` that can be among a row's k + 1
    best; ``extra(S, lo)`` corrects a tile of scores in place."""
    if k is None:
        return tuple(x.ravel() for x in np.indices((len(A), len(B))))
    pool = np.full((len(A), k + 1), -np.inf, "float32")
    found = []
    for lo in range(0, len(B), TILE[1]):
        S = A @ B[lo:lo + TILE[1]].T
        if extra:
            extra(S, lo)
        if lo == 0 and S.shape[1] > k + 1:
            least = np.partition(S, S.shape[1] - k - 1, axis=1)[:, S.shape[1] - k - 1]
        else:
            least = pool.min(axis=1)
        at = np.flatnonzero(S >= least[:, None] - SCREEN)
        if not len(at):
            continue
        (r, c), v = np.divmod(at, S.shape[1]), S.ravel()[at]
        found.append((r, c + lo, v))
        rows, start, count = np.unique(r, return_index=True, return_counts=True)
        more = np.full((len(rows), int(count.max())), -np.inf, "float32")
        more[np.repeat(np.arange(len(rows)), count), np.arange(len(r)) - np.repeat(start, count)] = v
        both = np.concatenate([pool[rows], more], axis=1)
        pool[rows] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1:]
    r, c, v = (np.concatenate(x) for x in zip(*found))
    keep = v >= pool.min(axis=1)[r] - SCREEN
    return r[keep], c[keep]


def _panel_topk(base: DataFrame, n: int, num_cols: list[str], cat_cols: list[str], k: int | None, measure: str,
                include_self: bool, rank_digits: int | None, block_rows: int) -> DataFrame:
    """``dense_topk`` of all rows: cells of a left block and a right panel, gone
    through in tiles; a row of the cell carries its best over the whole panel."""
    bl, br = _panel_counts(base.sparkSession, n, k, block_rows)
    descending = measure == "cosine"
    cols = ["_id", *num_cols, *cat_cols]
    left = base.select(*cols, F.lit(0).alias("_side"), block_of("_id", bl).alias("_bl"), F.explode(F.sequence(F.lit(0), F.lit(br - 1))).alias("_br"))
    right = base.select(*cols, F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.lit(bl - 1))).alias("_bl"), block_of("_id", br, 5).alias("_br"))

    def cell(table):
        import pyarrow as pa
        table = table.sort_by("_id")
        x = np.stack([table.column(c).to_numpy().astype("float64") for c in num_cols], axis=1) if num_cols else np.zeros((len(table), 0))
        codes = []
        for c in cat_cols:
            d = table.column(c).combine_chunks().dictionary_encode()
            codes.append((d.indices.fill_null(-1).to_numpy().astype("int64"), len(d.dictionary)))
        norm = (x * x).sum(axis=1) + sum(((c >= 0) for c, _ in codes), np.zeros(len(table)))
        usable = np.isfinite(norm) & (norm > 0)
        side, ids = table.column("_side").to_numpy(), table.column("_id").to_numpy()
        a, b = np.flatnonzero(usable & (side == 0)), np.flatnonzero(usable & (side == 1))
        root = np.sqrt(norm)
        hot = [(c, m) for c, m in codes if m <= ONE_HOT_VALUES]
        long = [c for c, m in codes if m > ONE_HOT_VALUES]

        def unit(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), x.shape[1] + sum(m for _, m in hot)), "float32")
            out[:, :x.shape[1]] = x[rows] / root[rows][:, None]
            at = x.shape[1]
            for c, m in hot:
                has = np.flatnonzero(c[rows] >= 0)
                out[has, at + c[rows][has]] = 1 / root[rows][has]
                at += m
            return out

        outs, B = [], unit(b)
        for lo in range(0, len(a) if len(b) else 0, TILE[0]):
            rows = a[lo:lo + TILE[0]]

            def extra(S: np.ndarray, at: int) -> None:
                cut = b[at:at + S.shape[1]]
                same = sum(((c[rows][:, None] == c[cut][None, :]) & (c[rows] >= 0)[:, None]).astype("float32") for c in long)
                S += same / (root[rows][:, None] * root[cut][None, :]).astype("float32")

            r, c = _screened(unit(rows), B, extra if long else None, k)
            i, j = rows[r], b[c]
            if not include_self:
                own = np.searchsorted(ids[b], ids[rows])[r] == c
                other = ~(own & (ids[i] == ids[j]))
                i, j = i[other], j[other]
            dot = np.einsum("ij,ij->i", x[i], x[j])
            for code, _ in codes:
                dot = dot + ((code[i] == code[j]) & (code[i] >= 0))
            cos = dot / (root[i] * root[j])
            raw = cos if descending else 2.0 * (1.0 - cos)
            key = _rank_key(raw, descending, rank_digits)
            o = np.lexsort((ids[j], key, ids[i]))
            e1, e2, raw, key = ids[i][o], ids[j][o], raw[o], key[o]
            if k is not None and len(e1):
                first = np.r_[0, np.flatnonzero(np.diff(e1)) + 1]
                keep = np.arange(len(e1)) - np.repeat(first, np.diff(np.r_[first, len(e1)])) < k
                e1, e2, raw, key = e1[keep], e2[keep], raw[keep], key[keep]
            outs.append(pa.table({"e1": e1, "e2": e2, "score": raw, "_key": key}))
        empty = pa.table({"e1": pa.array([], "int64"), "e2": pa.array([], "int64"), "score": pa.array([], "float64"), "_key": pa.array([], "float64")})
        out = pa.concat_tables([empty, *outs])
        if br > 1:
            return out
        # one panel: all of a row's candidates are in this cell, so its ranks are final
        e1, e2, raw, key = (out.column(c).to_numpy() for c in ("e1", "e2", "score", "_key"))
        o = np.lexsort((e2, key, e1))
        first = np.r_[0, np.flatnonzero(np.diff(e1[o])) + 1] if len(o) else np.array([], "int64")
        rank = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)])) + 1
        m = rank <= (len(o) if k is None else k)
        return pa.table({"e1": e1[o][m], "e2": e2[o][m], "score": raw[o][m], "rank": rank[m].astype("int32")})

    cells = left.unionByName(right).repartition(bl * br, "_bl", "_br").groupBy("_bl", "_br")
    if br == 1:
        return cells.applyInArrow(cell, "e1 long, e2 long, score double, rank int")
    return _final_topk(cells.applyInArrow(cell, "e1 long, e2 long, score double, _key double"), k)


def _final_topk(local: DataFrame, k: int | None) -> DataFrame:
    w = Window.partitionBy("e1").orderBy(F.col("_key").asc(), F.col("e2").asc())
    r = local.withColumn("rank", F.row_number().over(w))
    if k is not None:
        r = r.filter(F.col("rank") <= k)
    return r.select("e1", "e2", "score", "rank")


# --------------------------------------------------------------------------
# sparse vectors (long form: entity, dim, value)

LIST_ROWS = 4096
#: Co-occurrences that a pass of ``sparse_topk`` shuffles, at some 5 bytes each.
PASS_ROWS = 300_000_000


def _narrow(stats, n: str, whole: str) -> str:
    """The narrowest type that holds a column of these bounds exactly."""
    if not stats[whole] or stats[n] is None:
        return "double"
    return next((t for t, most in (("tinyint", 127), ("int", 2 ** 31 - 1)) if stats[n] <= most), "double")


def _dot_lists(table) -> tuple:
    """(target, partner, dot, target's norm, partner's norm) of every pair that
    shares a dim, sorted by target and partner, from rows of (target, the list
    of all entities with the dim)."""
    table = table.sort_by([("_d", "ascending"), ("_part", "ascending")])
    lists = table.column("es").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    partner = lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
    other, q = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64") for c in ("vs", "qs"))
    te = table.column("_e").to_numpy().astype("int64")
    ids, row = np.unique(te, return_inverse=True)
    tq = np.zeros(len(ids))
    tq[row] = table.column("_q").to_numpy().astype("float64")
    term = np.repeat(table.column("_v").to_numpy().astype("float64"), n) * other
    t = np.repeat(row, n)
    o = np.lexsort((partner, t))
    t, partner = t[o], partner[o]
    if not len(t):
        return t, partner, term, term, term
    first = np.r_[0, np.flatnonzero((np.diff(t) != 0) | (np.diff(partner) != 0)) + 1]
    dot = np.add.reduceat(term[o], first)
    t, partner, q = t[first], partner[first], q[o][first]
    keep = (ids[t] != partner) & (dot != 0)
    t, partner, dot, q = t[keep], partner[keep], dot[keep], q[keep]
    return ids[t], partner, dot, tq[t], q


def _best_of_rows(target: np.ndarray, partner: np.ndarray, score: np.ndarray, k: int | None):
    """Positions and ranks of each target's k best (score descending, then
    partner) where rows are sorted by target and partner."""
    keep = np.flatnonzero(np.isfinite(score))
    target, score = target[keep], score[keep]
    if k is not None and len(keep):
        start = np.r_[0, np.flatnonzero(np.diff(target)) + 1]
        least = np.full(len(start), -np.inf)
        for i, (lo, hi) in enumerate(zip(start, np.r_[start[1:], len(target)])):
            if hi - lo > k:
                least[i] = np.partition(score[lo:hi], hi - lo - k)[hi - lo - k]
        near = score >= np.repeat(least, np.diff(np.r_[start, len(target)]))
        keep, target, score = keep[near], target[near], score[near]
    o = np.lexsort((-score, target))
    keep, target = keep[o], target[o]
    start = np.r_[0, np.flatnonzero(np.diff(target)) + 1] if len(target) else np.array([], "int64")
    rank = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)])) + 1
    m = rank <= (len(rank) if k is None else k)
    return keep[m], rank[m]


def _with_lists(entries: DataFrame, by_dim: DataFrame, lists: dict[str, str], passes: int = 1):
    """Each entry (_d, _e, ...) with the lists of all entries of its dim, under
    the names given for their columns; a hot dim's list (``by_dim``: _d, _n) comes
    in parts.  With several ``passes`` a function that gives the rows of one: its
    entities', from lists that are stored once."""
    mine = [c for c in entries.columns if c != "_d"]
    row = F.struct("_e", *[c for c in mine if c != "_e"])
    arrays = [F.col(f"l.{c}").alias(name) for c, name in lists.items()]
    hot = by_dim.filter(F.col("_n") > LIST_ROWS).select("_d", F.ceil(F.col("_n") / LIST_ROWS).cast("int").alias("_parts"))
    any_hot = hot.limit(1).count() > 0
    once = stored if passes > 1 else lambda df, name: df
    cold = entries.join(hot, "_d", "left_anti") if any_hot else entries
    cold = once(cold.groupBy("_d").agg(F.array_sort(F.collect_list(row)).alias("l")), "lists")
    if any_hot:
        busy = once(entries.join(hot, "_d"), "hot-entries")
        parts = once(busy.withColumn("_part", F.pmod(F.xxhash64("_e"), F.col("_parts")).cast("int")).groupBy("_d", "_part")
                     .agg(F.array_sort(F.collect_list(row)).alias("l")).select("_d", "_part", *arrays), "hot-lists")

    def rows_of(i: int) -> DataFrame:
        mine_now = F.filter("l", lambda x: in_pass(x["_e"], passes, i)) if passes > 1 else F.col("l")
        rows = (cold.select("_d", F.lit(0).alias("_part"), *arrays, F.explode(mine_now).alias("t"))
                .select("_d", "_part", *[F.col(f"t.{c}").alias(c) for c in mine], *lists.values()))
        if any_hot:
            now = busy.filter(in_pass(F.col("_e"), passes, i)) if passes > 1 else busy
            rows = rows.unionByName(now.drop("_parts").join(parts, "_d"))
        return rows

    return rows_of if passes > 1 else rows_of(0)


def seen_products(neighbors: DataFrame, known: DataFrame, max_task_rows: int = 4_000_000,
                  force_dim_slices: int | None = None, pass_rows: int | None = None) -> DataFrame:
    """For every known (e, d, a): pred = sum w * a' / sum |w| over the neighbours
    p of e (``neighbors``: e, p, w) with a known (p, d, a'), where the numerator
    is positive.  Each dim's list goes to the entities on it, and an entity's
    neighbours are looked up in them; an entity with too many co-occurrences is spread over
    groups by dim.  Past ``pass_rows`` co-occurrences the entities are taken in
    passes (``sparse_topk``).  Returns (e, d, pred, a)."""
    spark = known.sparkSession
    base = known.select(F.col("e").cast("long").alias("_e"), F.col("d").cast("long").alias("_d"), F.col("a").cast("double").alias("_v"))
    by_dim = stored(base.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")), "dims")
    budget = max(1, max_task_rows // 4)
    work = stored(base.join(by_dim, "_d").groupBy("_e").agg(F.sum("_n").alias("_work"))
                  .withColumn("_salts", F.greatest(F.ceil(F.col("_work") / budget), F.lit(force_dim_slices or 1)).cast("int")), "work")
    ws = work.agg(F.count(F.lit(1)).alias("n"), F.sum("_work").alias("all"), F.max(F.abs("_e")).alias("e")).first()
    if not ws["n"]:
        return spark.createDataFrame([], "e long, d long, pred double, a double")
    par = max(1, spark.sparkContext.defaultParallelism)
    passes = passes_for(spark, int(ws["all"]), pass_rows or PASS_ROWS)
    total, n_ent = math.ceil(int(ws["all"]) / passes), math.ceil(int(ws["n"]) / passes)      # of a pass
    nb = max(math.ceil(total / budget), math.ceil(n_ent / 2048), min(2 * par, math.ceil(n_ent / MIN_BLOCK_ROWS)))
    id_type = "int" if ws["e"] < 2 ** 31 else "long"
    salts = work.select("_e", "_salts")
    entries = base.join(salts, "_e").select("_d", F.col("_e").cast(id_type).alias("_e"), "_v", F.coalesce("_v", F.lit(float("nan"))).alias("_x"),
                                                 F.pmod(F.xxhash64("_d"), F.col("_salts")).cast("int").alias("_s"))
    with_lists = _with_lists(entries, by_dim, {"_e": "es", "_x": "vs"}, passes)
    near = neighbors.select(F.col("e").cast("long").alias("_e"), F.struct(F.col("p").cast("long").alias("p"), F.col("w").cast("double").alias("w")).alias("x"))
    if passes > 1:
        near = stored(near, "neighbours")

    def both(i: int) -> DataFrame:
        far = (with_lists(i) if passes > 1 else with_lists).select(
            F.lit(0).alias("_side"), F.col("_e").cast("long").alias("_e"), "_s", "_d", "_part", "_v", F.col("es").cast("array<long>").alias("es"), "vs")
        mine = near.filter(in_pass(F.col("_e"), passes, i)) if passes > 1 else near
        return far.unionByName(
            mine.groupBy("_e").agg(F.collect_list("x").alias("l")).join(salts, "_e")
            .select(F.lit(1).alias("_side"), "_e", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_s"), F.lit(None).cast("long").alias("_d"),
                    F.lit(None).cast("int").alias("_part"), F.lit(None).cast("double").alias("_v"), F.col("l.p").alias("es"), F.col("l.w").alias("vs")))

    def sums(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        far, near = (table.filter(pc.equal(table.column("_side"), i)).combine_chunks() for i in range(2))
        far = far.sort_by([("_e", "ascending"), ("_d", "ascending"), ("_part", "ascending")])

        def flat(t):
            es = t.column("es").combine_chunks()
            return (np.diff(es.offsets.to_numpy()), es.flatten().to_numpy().astype("int64"),
                    t.column("vs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64"), t.column("_e").to_numpy().astype("int64"))

        (nn, p, w, ne), (nf, q, v, fe) = flat(near), flat(far)
        ids, others = np.unique(ne), np.unique(p)
        num = den = np.zeros(len(fe))
        if len(ids) and len(others):
            key = np.searchsorted(ids, np.repeat(ne, nn)) * len(others) + np.searchsorted(others, p)
            o = np.argsort(key, kind="stable")
            key, w = key[o], w[o]
            first = np.r_[0, np.flatnonzero(np.diff(key)) + 1]      # a neighbour may be listed more than once
            key, w, size = key[first], np.add.reduceat(w, first), np.add.reduceat(np.abs(w), first)
            at, pos = np.searchsorted(ids, fe).clip(max=len(ids) - 1), np.searchsorted(others, q).clip(max=len(others) - 1)
            row = np.repeat(np.arange(len(fe)), nf)
            ok = (others[pos] == q) & (ids[at] == fe)[row]
            row, want, v = row[ok], at[row[ok]] * len(others) + pos[ok], v[ok]
            hit = np.searchsorted(key, want).clip(max=len(key) - 1)
            ok = key[hit] == want
            num = np.bincount(row[ok], weights=w[hit[ok]] * v[ok], minlength=len(fe))
            den = np.bincount(row[ok], weights=size[hit[ok]], minlength=len(fe))
        some = np.flatnonzero(den)
        return pa.table({"e": pa.array(fe[some], "int64"), "d": far.column("_d").combine_chunks().take(some).cast("int64"),
                         "a": far.column("_v").combine_chunks().take(some), "num": pa.array(num[some], "float64"), "den": pa.array(den[some], "float64")})

    parts = max(par, min(nb, math.ceil(total / 4_000_000)))
    in_parts = by_dim.filter(F.col("_n") > LIST_ROWS).limit(1).count() > 0

    def one(i: int) -> DataFrame:
        out = (both(i).withColumn("_b", block_of("_e", nb)).repartition(parts, "_b", "_s").groupBy("_b", "_s")
               .applyInArrow(sums, "e long, d long, a double, num double, den double"))
        if in_parts:
            out = out.groupBy("e", "d", "a").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
        return out.filter((F.col("num") > 0) & ~F.isnan("num")).select("e", "d", (F.col("num") / F.col("den")).alias("pred"), "a")

    return each_pass(passes, one, "seen")


def sparse_topk(long_df: DataFrame, entity: str, dim: str, value: str, k: int | None,
                block_rows: int = 2048, max_task_rows: int = 4_000_000,
                force_dim_slices: int | None = None, pass_rows: int | None = None) -> DataFrame:
    """Exact top-k cosine neighbours between the sparse vectors
    ``entity -> {dim: value}``.  Pairs with a zero dot product are not listed
    (they never share a dim).  Returns (e1, e2, score, rank), score = cosine,
    ranked by score descending then e2.

    Each dim's list of (entity, value, norm) goes to the entities on it, in
    chunks of ``LIST_ROWS`` if the dim is hot; what is shuffled are the co-occurrences,
    not copies of the table for every block.  Past ``pass_rows`` of them the entities
    are taken in passes, each stored before the next begins.
    """
    spark = long_df.sparkSession
    # materialise the input once: the sizing passes and the product read it
    base = stored(long_df.select(F.col(entity).cast("long").alias("_e"), F.col(dim).cast("long").alias("_d"),
                                 F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("_v")), "vectors")
    norms = base.groupBy("_e").agg(F.sum(F.col("_v") * F.col("_v")).alias("_q"))
    st = base.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs("_e")).alias("e"), F.max(F.abs("_v")).alias("v"),
                  F.every(F.col("_v") == F.floor("_v")).alias("whole")).first()
    if st["rows"] == 0:
        return spark.createDataFrame([], "e1 long, e2 long, score double, rank int")
    by_dim = base.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    work = base.join(by_dim, "_d").groupBy("_e").agg(F.sum("_n").alias("_work"))
    ws = work.agg(F.count(F.lit(1)).alias("n"), F.sum("_work").alias("all"), F.max("_work").alias("most")).first()
    qs = norms.agg(F.max("_q").alias("q")).first()
    par = max(1, spark.sparkContext.defaultParallelism)
    total, n_ent = int(ws["all"]), int(ws["n"])
    passes = passes_for(spark, total, pass_rows or PASS_ROWS)
    nd = force_dim_slices or max(1, math.ceil(int(ws["most"]) / max_task_rows))
    total, n_ent = math.ceil(total / passes), math.ceil(n_ent / passes)      # of a pass
    nb = max(math.ceil(n_ent / block_rows), math.ceil(4 * total / max_task_rows), min(2 * par, math.ceil(n_ent / MIN_BLOCK_ROWS)))
    parts = max(par, min(nb, math.ceil(total / 4_000_000)))
    id_type = "int" if st["e"] < 2 ** 31 else "long"
    v_type, q_type = _narrow(st, "v", "whole"), _narrow({"q": qs["q"], "whole": st["whole"]}, "q", "whole")

    entries = base.join(norms, "_e").select("_d", F.col("_e").cast(id_type).alias("_e"), F.col("_v").cast(v_type).alias("_v"),
                                            F.col("_q").cast(q_type).alias("_q"))
    rows = _with_lists(entries, by_dim, {"_e": "es", "_v": "vs", "_q": "qs"}, passes)

    def scored(e1, e2, dot, qa, qb) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return dot / (np.sqrt(qa) * np.sqrt(qb))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa
        e1, e2, dot, qa, qb = _dot_lists(pa.Table.from_pandas(pdf, preserve_index=False))
        score = scored(e1, e2, dot, qa, qb)
        i, rank = _best_of_rows(e1, e2, score, k)
        return pd.DataFrame({"e1": e1[i].astype("int64"), "e2": e2[i].astype("int64"), "score": score[i], "rank": rank.astype("int32")})

    def whole(some: DataFrame) -> DataFrame:
        some = some.withColumn("_b", block_of("_e", nb)).repartition(parts, "_b")
        return some.groupBy("_b").applyInPandas(best, "e1 long, e2 long, score double, rank int")

    if nd == 1:
        return each_pass(passes, lambda i: whole(rows(i) if passes > 1 else rows), "nearest")

    # Entities with too many co-occurrences for a task: slice the shared
    # dimension, emit partial dots, sum per pair.
    def partial(table):
        import pyarrow as pa
        e1, e2, dot, qa, qb = _dot_lists(table)
        return pa.table({"e1": pa.array(e1, "int64"), "e2": pa.array(e2, "int64"), "dot": pa.array(dot, "float64"),
                         "qa": pa.array(qa, "float64"), "qb": pa.array(qb, "float64")})

    large = work.filter(F.col("_work") > max_task_rows).select(F.col("_e").cast(id_type).alias("_e"))

    def both(rows: DataFrame) -> DataFrame:
        sliced = rows if force_dim_slices else rows.join(large, "_e", "left_semi")
        sliced = sliced.withColumn("_s", block_of("_d", nd, seed=17)).withColumn("_b", block_of("_e", nb))
        dots = (sliced.repartition(max(parts, 2 * par), "_b", "_s").groupBy("_b", "_s")
                .applyInArrow(partial, "e1 long, e2 long, dot double, qa double, qb double")
                .groupBy("e1", "e2").agg(F.sum("dot").alias("dot"), F.max("qa").alias("qa"), F.max("qb").alias("qb"))
                .filter(F.col("dot") != 0))
        found = dots.select("e1", "e2", (F.col("dot") / (F.sqrt("qa") * F.sqrt("qb"))).alias("score"))
        out = _final_topk(found.filter(~F.isnan("score")).withColumn("_key", -F.col("score")), k)
        return out if force_dim_slices else out.unionByName(whole(rows.join(large, "_e", "left_anti")))

    return each_pass(passes, lambda i: both(rows(i) if passes > 1 else rows), "nearest")


# --------------------------------------------------------------------------
# bipartite: left vectors x right vectors (e.g. user factors x item factors)

def bipartite_topk(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int,
                   exclude: DataFrame | None = None, block_rows: int = 2048,
                   n_left: int | None = None, n_right: int | None = None,
                   max_task_rows: int = 2_000_000) -> DataFrame:
    """Exact top-k right rows per left row by dot product (descending, ties by
    right id), skipping the (left, right) pairs listed in ``exclude``
    (columns l, r).  ``left``/``right``: (id_col, vec_col array<float|double>).

    Left rows are hashed into Bl blocks and right rows into Br large panels;
    each (block, panel) cell is one group holding both sides' vectors plus the
    excluded pairs that fall into the cell, gone through in tiles.  Returns (l, r, score, rank)."""
    spark = left.sparkSession
    nl = n_left if n_left is not None else left.count()
    nr = n_right if n_right is not None else right.count()
    par = max(1, spark.sparkContext.defaultParallelism)
    bl = _panel_counts(spark, nl, k, block_rows)[0]
    br = max(1, math.ceil(nr / min(PANEL_ROWS, 256 * block_rows)), math.ceil(2 * par / bl))
    if exclude is not None:
        from reco.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        exclude = exclude.select(F.col("l").cast("long").alias("l"),
                                 F.col("r").cast("long").alias("r")).checkpoint(eager=True)
        # a left block's excluded pairs spread over its br cells by the right
        # id: size br so the heaviest left row (a hot user) fits a cell
        heaviest = exclude.groupBy("l").count().agg(F.max("count")).first()[0] or 0
        bl = max(bl, math.ceil(exclude.count() / br / max_task_rows))
        br = max(br, math.ceil(int(heaviest) / max_task_rows))
    br = min(br, max(1, nr))
    L = left.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    R = right.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    L = L.select(F.lit(0).alias("_side"), "_id", "_v", block_of("_id", bl, 3).alias("_bl"),
                 F.explode(F.sequence(F.lit(0), F.lit(br - 1))).alias("_br"))
    R = R.select(F.lit(1).alias("_side"), "_id", "_v",
                 F.explode(F.sequence(F.lit(0), F.lit(bl - 1))).alias("_bl"), block_of("_id", br, 5).alias("_br"))
    parts = [L.withColumn("_x", F.lit(None).cast("long")), R.withColumn("_x", F.lit(None).cast("long"))]
    if exclude is not None:
        # hash the same (long) values as the vector rows, so pairs land in their cell
        ex = exclude.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))
        ex = ex.select(F.lit(2).alias("_side"), F.col("l").alias("_id"),
                       F.lit(None).cast("array<double>").alias("_v"),
                       block_of("l", bl, 3).alias("_bl"), block_of("r", br, 5).alias("_br"),
                       F.col("r").alias("_x"))
        parts.append(ex)
    allrows = parts[0].unionByName(parts[1])
    for p in parts[2:]:
        allrows = allrows.unionByName(p)

    def cell(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        a, b, ex = (table.filter(pc.equal(table.column("_side"), i)).sort_by("_id") for i in range(3))
        ida, idb = (t.column("_id").to_numpy().astype("int64") for t in (a, b))
        outs = [pa.table({"e1": pa.array([], "int64"), "e2": pa.array([], "int64"), "score": pa.array([], "float64"), "_key": pa.array([], "float64")})]
        if not len(a) or not len(b):
            return outs[0]
        xa, xb = (t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (a, b))
        # scaled row by row, which keeps a row's order, for the screening
        size = np.sqrt((xa * xa).sum(axis=1))
        B = (xb / (np.sqrt((xb * xb).sum(axis=1)).max() or 1.0)).astype("float32")
        el, er = ex.column("_id").to_numpy().astype("int64"), ex.column("_x").to_numpy().astype("int64")
        ri, ci = np.searchsorted(ida, el), np.searchsorted(idb, er)
        hit = (ri < len(ida)) & (ci < len(idb))
        hit[hit] = (ida[ri[hit]] == el[hit]) & (idb[ci[hit]] == er[hit])
        gone = np.unique(ri[hit] * len(idb) + ci[hit])
        for lo in range(0, len(ida), TILE[0]):
            rows = np.arange(lo, min(lo + TILE[0], len(ida)))
            mine = gone[np.searchsorted(gone, lo * len(idb)):np.searchsorted(gone, (rows[-1] + 1) * len(idb))]
            mr, mc = mine // len(idb) - lo, mine % len(idb)

            def drop(S: np.ndarray, at: int) -> None:
                m = (mc >= at) & (mc < at + S.shape[1])
                S[mr[m], mc[m] - at] = -np.inf

            A = (xa[rows] / np.where(size[rows] > 0, size[rows], 1.0)[:, None]).astype("float32")
            r, c = _screened(A, B, drop, k)
            left_in = ~np.isin((r + lo) * len(idb) + c, mine)
            r, c = r[left_in] + lo, c[left_in]
            score = np.einsum("ij,ij->i", xa[r], xb[c])
            o = np.lexsort((c, -score, r))
            r, c, score = r[o], c[o], score[o]
            first = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.array([], "int64")
            keep = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
            outs.append(pa.table({"e1": ida[r[keep]], "e2": idb[c[keep]], "score": score[keep], "_key": -score[keep]}))
        return pa.concat_tables(outs)

    local = allrows.repartition(bl * br, "_bl", "_br").groupBy("_bl", "_br").applyInArrow(
        cell, "e1 long, e2 long, score double, _key double")
    out = _final_topk(local, k)
    return out.select(F.col("e1").alias("l"), F.col("e2").alias("r"), "score", "rank")


# --------------------------------------------------------------------------
# sparse bipartite product: predictions num/den = (L . R) / (|L| . |R|)

def _accumulate_multi(li, ld, ri, rd, a: int, b: int, weights, max_pairs: int = 4_000_000,
                     sparse_ok: bool = False):
    """Like ``_accumulate`` but folds several (left weight, right weight)
    products over the same generated pairs: returns one a x b matrix each.
    With ``sparse_ok`` the result is tagged: ("dense", [matrices]) or, when the
    generated pairs touch under 1/8 of the cell, ("sparse", linear indices,
    [sums])."""
    outs = [np.zeros(a * b, dtype="float64") for _ in weights]
    if len(li) == 0 or len(ri) == 0 or a == 0 or b == 0:
        if sparse_ok:
            return ("sparse", np.array([], "int64"), [np.array([], "float64") for _ in weights])
        return [o.reshape(a, b) for o in outs]
    lo_ = np.argsort(ld, kind="stable")
    ro_ = np.argsort(rd, kind="stable")
    li, ld = li[lo_], ld[lo_]
    ri, rd = ri[ro_], rd[ro_]
    weights = [(lw[lo_], rw[ro_]) for lw, rw in weights]
    dl, sl, cl = np.unique(ld, return_index=True, return_counts=True)
    dr, sr, cr = np.unique(rd, return_index=True, return_counts=True)
    _, il, ir = np.intersect1d(dl, dr, assume_unique=True, return_indices=True)
    if len(il) == 0:
        if sparse_ok:
            return ("sparse", np.array([], "int64"), [np.array([], "float64") for _ in weights])
        return [o.reshape(a, b) for o in outs]
    sl, cl, sr, cr = sl[il], cl[il], sr[ir], cr[ir]
    npairs = cl * cr
    total = int(npairs.sum())
    sparse = sparse_ok and total * 8 < a * b

    def gen(g):
        cnt = npairs[g]
        rep = np.repeat(np.arange(len(g)), cnt)
        first = np.concatenate(([0], np.cumsum(cnt)[:-1]))
        t = np.arange(int(cnt.sum())) - first[rep]
        crr = cr[g][rep]
        lrow = sl[g][rep] + t // crr
        rrow = sr[g][rep] + t % crr
        return li[lrow] * b + ri[rrow], lrow, rrow

    if sparse:
        # few touched entries: accumulate only those (total < a*b/8 pairs)
        lin, lrow, rrow = gen(np.arange(len(npairs)))
        uniq, inv = np.unique(lin, return_inverse=True)
        sums = [np.bincount(inv, weights=lw[lrow] * rw[rrow], minlength=len(uniq)) for lw, rw in weights]
        return ("sparse", uniq, sums)
    cap = max(max_pairs, int(npairs.max()))
    bounds = np.cumsum(npairs)
    start = 0
    while start < len(npairs):
        base = bounds[start - 1] if start > 0 else 0
        end = max(int(np.searchsorted(bounds, base + cap, side="right")), start + 1)
        lin, lrow, rrow = gen(np.arange(start, end))
        for o, (lw, rw) in zip(outs, weights):
            o += np.bincount(lin, weights=lw[lrow] * rw[rrow], minlength=a * b)
        start = end
    res = [o.reshape(a, b) for o in outs]
    return ("dense", res) if sparse_ok else res


def _choose_blocks(n_l: int, n_r: int, rows_l: int, rows_r: int, max_cell: int, par: int) -> tuple[int, int]:
    """Block counts (BL, BR) minimising the replicated rows
    rows_l*BR + rows_r*BL with a dense cell of at most ``max_cell`` entries
    and at least 2 x parallelism cells."""
    best = None
    for bl in range(1, max(1, min(n_l, 4096)) + 1):
        br = max(1, math.ceil(math.ceil(n_l / bl) * n_r / max_cell))
        spread = min(math.ceil(2 * par / bl), math.ceil(n_r / MIN_BLOCK_ROWS))
        br = min(max(br, spread), max(1, n_r))
        cost = rows_l * br + rows_r * bl
        if best is None or cost < best[0]:
            best = (cost, bl, br)
    return best[1], best[2]


def _panel_cells(n_l: int, n_r: int, bytes_l: int, bytes_r: int, most: int, par: int) -> tuple[int, int]:
    """(left blocks, right panels) of ``unseen_topn`` that send the fewest bytes
    with at most ``most`` bytes of a side in a cell and 2 x parallelism cells."""
    low_l, low_r = (max(1, math.ceil(b / most)) for b in (bytes_l, bytes_r))
    best = None
    for bl in range(low_l, max(low_l, min(2 * par, math.ceil(n_l / MIN_BLOCK_ROWS))) + 1):
        br = max(low_r, min(math.ceil(2 * par / bl), math.ceil(n_r / MIN_BLOCK_ROWS)))
        cost = bytes_l * br + bytes_r * bl
        if best is None or cost < best[0]:
            best = (cost, bl, br)
    return best[1], best[2]


def unseen_topn(left: DataFrame, right: DataFrame, pairs: DataFrame | None, n: int | None, den_left_abs: bool = False,
                den_right_abs: bool = True, max_cell: int = 4_000_000, max_task_rows: int = 4_000_000,
                force_dim_slices: int | None = None) -> DataFrame:
    """``sparse_product`` of mode "unseen_topn"; without ``pairs`` the known
    pairs are the left rows' own (l, d).

    A side goes to its cells as one row an entity, with the lists of its dims and
    values in the narrowest types.  A cell is gone through in tiles of at most
    ``max_cell`` (l, r), so a cell may be as large as its rows allow and few copies
    are sent.  An entity with more than ``max_task_rows`` rows has them sliced
    (``sparse_product``)."""
    spark = left.sparkSession
    from reco.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)

    def once(t: DataFrame, e: str, x: str) -> DataFrame:
        return t.select(F.col(e).cast("long").alias("_e"), F.col("d").cast("long").alias("_d"),
                        F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias("_v")).checkpoint(eager=True)

    L, R = once(left, "l", "v"), once(right, "r", "w")

    def stats(t: DataFrame):
        by = t.groupBy("_e").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("_d")).alias("d"), F.max(F.abs("_v")).alias("v"),
                                 F.every(F.col("_v") == F.floor("_v")).alias("whole"))
        return by.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"), F.max("n").alias("most"),
                      F.greatest(F.max("d"), F.max(F.abs("_e"))).alias("id"), F.max("v").alias("v"), F.every("whole").alias("whole")).first()

    sl, sr = stats(L), stats(R)
    if not sl["entities"] or not sr["entities"]:
        return spark.createDataFrame([], "l long, r long, pred double, rank int")
    if force_dim_slices is not None or max(sl["most"], sr["most"]) > max_task_rows:
        back = [t.select(F.col("_e").alias(e), F.col("_d").alias("d"), F.col("_v").alias(x)) for t, e, x in ((L, "l", "v"), (R, "r", "w"))]
        known = L.select(F.col("_e").alias("l"), F.col("_d").alias("r"), F.col("_v").alias("a")) if pairs is None else pairs
        return sparse_product(*back, known, "unseen_topn", n, den_left_abs, den_right_abs, max_cell, max_task_rows, force_dim_slices)
    id_type = "int" if max(sl["id"], sr["id"]) < 2 ** 31 else "long"
    types = [_narrow(s, "v", "whole") for s in (sl, sr)]
    size = {"tinyint": 1, "int": 4, "long": 8, "double": 8}
    par = max(1, spark.sparkContext.defaultParallelism)
    bl, br = _panel_cells(int(sl["entities"]), int(sr["entities"]), *[int(s["rows"]) * (size[id_type] + size[t]) for s, t in zip((sl, sr), types)],
                          12 * max_task_rows, par)

    def lists(t: DataFrame, kind: str) -> DataFrame:
        return t.groupBy("_e").agg(F.collect_list(F.col("_d").cast(id_type)).alias("_ds"), F.collect_list(F.col("_v").cast(kind)).alias("_vs"))

    def side(t: DataFrame, which: int, b, p) -> DataFrame:
        vs = [(F.col("_vs") if i == which else F.lit(None).cast(f"array<{types[i]}>")).alias(f"_v{i}") for i in range(2)]
        return t.select(F.lit(which).cast("tinyint").alias("_side"), b.alias("_bl"), p.alias("_br"), "_e", "_ds", *vs)

    rows = (side(lists(L, types[0]), 0, block_of("_e", bl, 3), F.explode(F.sequence(F.lit(0), F.lit(br - 1))))
            .unionByName(side(lists(R, types[1]), 1, F.explode(F.sequence(F.lit(0), F.lit(bl - 1))), block_of("_e", br, 5))))
    if pairs is not None:
        known = (pairs.select(F.col("l").cast("long").alias("_e"), F.col("r").cast("long").alias("_r")).withColumn("_p", block_of("_r", br, 5))
                 .groupBy("_e", "_p").agg(F.collect_list(F.col("_r").cast("long")).alias("_ds")))
        rows = rows.withColumn("_ds", F.col("_ds").cast("array<long>")).unionByName(side(known, 2, block_of("_e", bl, 3), F.col("_p")))

    own = pairs is None

    def weigh(x: np.ndarray, by_size: bool) -> np.ndarray:
        return np.abs(x) if by_size else np.ones_like(x)

    def cell(table):
        import pyarrow as pa
        import pyarrow.compute as pc
        empty = pa.table({"l": pa.array([], "int64"), "r": pa.array([], "int64"), "pred": pa.array([], "float64"), "_key": pa.array([], "float64")})

        def flat(which: int):
            t = table.filter(pc.equal(table.column("_side"), which)).sort_by("_e")
            ds = t.column("_ds").combine_chunks()
            at = np.repeat(np.arange(len(t)), np.diff(ds.offsets.to_numpy()))
            vs = t.column(f"_v{which}").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64") if which < 2 else None
            return t.column("_e").to_numpy().astype("int64"), at, ds.flatten().to_numpy(zero_copy_only=False).astype("int64"), vs

        (ida, row, d, v), (idb, col, rd, w) = flat(0), flat(1)
        if not len(ida) or not len(idb):
            return empty
        o = np.lexsort((v, d, row))
        row, d, v = row[o], d[o], v[o]
        o = np.lexsort((w, col, rd))
        col, rd, w = col[o], rd[o], w[o]
        if own:
            kl, kr = row, d
        else:
            ke, kat, kr, _ = flat(2)
            kl = np.searchsorted(ida, ke)[kat]
            there = (kl < len(ida)) & (ida[kl.clip(max=len(ida) - 1)] == ke[kat])
            kl, kr = kl[there], kr[there]
        kc = np.searchsorted(idb, kr).clip(max=len(idb) - 1)
        there = idb[kc] == kr
        gone = np.unique(kl[there] * len(idb) + kc[there])
        dims, start, count = np.unique(rd, return_index=True, return_counts=True)
        pos = np.searchsorted(dims, d).clip(max=len(dims) - 1)
        there = dims[pos] == d
        row, v, start, count = row[there], v[there], start[pos[there]], count[pos[there]]
        fv, fw = weigh(v, den_left_abs), weigh(w, den_right_abs)
        done = np.r_[0, np.cumsum(count)]
        wide, outs = len(idb), [empty]
        tall = max(1, max_cell // wide)
        for lo in range(0, len(ida), tall):
            hi = min(lo + tall, len(ida))
            a, end = np.searchsorted(row, [lo, hi])
            num, den = np.zeros((hi - lo) * wide), np.zeros((hi - lo) * wide)
            while a < end:
                b = max(a + 1, min(end, int(np.searchsorted(done, done[a] + max_cell, "right")) - 1))
                which = np.repeat(np.arange(a, b), count[a:b])
                at = np.arange(done[a], done[b]) - done[which] + start[which]
                lin = (row[which] - lo) * wide + col[at]
                num += np.bincount(lin, v[which] * w[at], len(num))
                den += np.bincount(lin, fv[which] * fw[at], len(den))
                a = b
            mine = gone[np.searchsorted(gone, lo * wide):np.searchsorted(gone, hi * wide)]
            num[mine - lo * wide] = 0
            hit = np.flatnonzero(num > 0)
            pred = num[hit] / den[hit]
            i, _ = _best_of_rows(hit // wide, hit % wide, np.round(pred, 9), n)
            outs.append(pa.table({"l": ida[hit[i] // wide + lo], "r": idb[hit[i] % wide], "pred": pred[i], "_key": -np.round(pred[i], 9)}))
        return pa.concat_tables(outs)

    out = rows.repartition(bl * br, "_bl", "_br").groupBy("_bl", "_br").applyInArrow(cell, "l long, r long, pred double, _key double")
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.col("_key").asc(), F.col("r").asc())))
    return (best if n is None else best.filter(F.col("rank") <= n)).select("l", "r", "pred", "rank")


def sparse_product(left: DataFrame, right: DataFrame, pairs: DataFrame, mode: str, n: int | None = None,
                   den_left_abs: bool = False, den_right_abs: bool = True, max_cell: int = 4_000_000,
                   max_task_rows: int = 4_000_000, force_dim_slices: int | None = None) -> DataFrame:
    """pred[l, r] = sum_d v*w / sum_d f(v)*g(w) over shared dims d, where
    num > 0 (f, g = |x| or presence).

    ``left`` (l, d, v), ``right`` (r, d, w), ``pairs`` (l, r, a): the known
    (l, r) pairs with their value.  ``mode``:
      * "unseen_topn": per l, the n best r not in ``pairs`` by
        (round(pred, 9) desc, r) -> (l, r, pred, rank)
      * "seen": pairs with a prediction -> (l, r, pred, a)
      * "all": every prediction -> (l, r, pred)
    Cells (left block x right block) hold bounded row sets; when one block is
    too large (a hot entity) the shared dimension is sliced and partial sums
    are aggregated by Spark before the top-n."""
    spark = left.sparkSession
    L = left.select(F.col("l").cast("long").alias("l"), F.col("d").cast("long").alias("d"),
                    F.col("v").cast("double").alias("v"))
    R = right.select(F.col("r").cast("long").alias("r"), F.col("d").cast("long").alias("d"),
                     F.col("w").cast("double").alias("w"))
    P = pairs.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"),
                     F.col("a").cast("double").alias("a"))
    # Materialise both operands once (reliable checkpoint into the shared
    # folder): the sizing passes below and the product then read them instead
    # of recomputing their lineage (e.g. a whole similarity job).
    from reco.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    L = L.checkpoint(eager=True)
    R = R.checkpoint(eager=True)
    sl = L.agg(F.approx_count_distinct("l").alias("n"), F.count(F.lit(1)).alias("c")).first()
    sr = R.agg(F.approx_count_distinct("r").alias("n"), F.count(F.lit(1)).alias("c")).first()
    par = max(1, spark.sparkContext.defaultParallelism)
    bl, br = _choose_blocks(int(sl["n"] or 1), int(sr["n"] or 1), int(sl["c"] or 0), int(sr["c"] or 0),
                            max_cell, par)
    L = L.withColumn("_bl", block_of("l", bl, 3))
    R = R.withColumn("_br", block_of("r", br, 5))
    if force_dim_slices is not None:
        nd = force_dim_slices
    else:
        ml = L.groupBy("_bl").count().agg(F.max("count")).first()[0] or 0
        mr = R.groupBy("_br").count().agg(F.max("count")).first()[0] or 0
        nd = max(1, math.ceil((int(ml) + int(mr)) / max_task_rows))
    fl = (lambda x: np.abs(x)) if den_left_abs else (lambda x: np.ones_like(x))
    fr = (lambda x: np.abs(x)) if den_right_abs else (lambda x: np.ones_like(x))

    Lr = L.select(F.lit(0).alias("_side"), "_bl", F.explode(F.sequence(F.lit(0), F.lit(br - 1))).alias("_br"),
                  (block_of("d", nd, 17) if nd > 1 else F.lit(0)).alias("_s"),
                  "l", F.lit(None).cast("long").alias("r"), "d", F.col("v").alias("x"))
    Rr = R.select(F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.lit(bl - 1))).alias("_bl"), "_br",
                  (block_of("d", nd, 17) if nd > 1 else F.lit(0)).alias("_s"),
                  F.lit(None).cast("long").alias("l"), "r", "d", F.col("w").alias("x"))
    rows = Lr.unionByName(Rr)

    def matrices(pdf):
        lft = pdf[pdf["_side"] == 0]
        rgt = pdf[pdf["_side"] == 1]
        ida = np.unique(lft["l"].to_numpy("int64"))
        idb = np.unique(rgt["r"].to_numpy("int64"))
        li = np.searchsorted(ida, lft["l"].to_numpy("int64"))
        ri = np.searchsorted(idb, rgt["r"].to_numpy("int64"))
        v = lft["x"].to_numpy("float64")
        w = rgt["x"].to_numpy("float64")
        res = _accumulate_multi(li, lft["d"].to_numpy("int64"), ri, rgt["d"].to_numpy("int64"),
                                len(ida), len(idb), [(v, w), (fl(v), fr(w))], sparse_ok=True)
        return ida, idb, res

    def touched(res, nb_):
        """(rows, cols, num, den) of the entries with a shared dimension."""
        if res[0] == "sparse":
            _, lin, (num, den) = res
            return lin // nb_, lin % nb_, num, den
        num, den = res[1]
        r_, c_ = np.nonzero(den)
        return r_, c_, num[r_, c_], den[r_, c_]

    if nd > 1:
        def partial(pdf: pd.DataFrame) -> pd.DataFrame:
            ida, idb, res = matrices(pdf)
            r_, c_, num, den = touched(res, len(idb))
            return pd.DataFrame({"l": ida[r_], "r": idb[c_], "num": num, "den": den})
        agg = (rows.groupBy("_bl", "_br", "_s").applyInPandas(partial, "l long, r long, num double, den double")
               .groupBy("l", "r").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
               .filter(F.col("num") > 0).select("l", "r", (F.col("num") / F.col("den")).alias("pred")))
        if mode == "all":
            return agg
        if mode == "seen":
            return agg.join(P, ["l", "r"])
        un = agg.join(P, ["l", "r"], "left_anti")
        from reco.operators.ranking import top_n_per_group
        return top_n_per_group(un, ["l"], [F.round("pred", 9).desc(), F.col("r").asc()], n)

    Pr = P.select(F.lit(2).alias("_side"), block_of("l", bl, 3).alias("_bl"), block_of("r", br, 5).alias("_br"),
                  F.lit(0).alias("_s"), "l", "r", F.lit(None).cast("long").alias("d"), F.col("a").alias("x"))
    rows = rows.unionByName(Pr)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        ida, idb, res = matrices(pdf)
        kn = pdf[pdf["_side"] == 2]
        if res[0] == "sparse":
            return sparse_cell(ida, idb, res, kn)
        num, den = res[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            pred = np.where(num > 0, num / den, np.nan)
        pl = kn["l"].to_numpy("int64")
        pr = kn["r"].to_numpy("int64")
        pa = kn["x"].to_numpy("float64")
        ri = np.searchsorted(ida, pl)
        ci = np.searchsorted(idb, pr)
        ok = (ri < len(ida)) & (ci < len(idb))
        ok[ok] = (ida[ri[ok]] == pl[ok]) & (idb[ci[ok]] == pr[ok])
        ri, ci, pa = ri[ok], ci[ok], pa[ok]
        if mode == "seen":
            p = pred[ri, ci] if len(ri) else np.array([])
            m = ~np.isnan(p)
            return pd.DataFrame({"l": ida[ri][m], "r": idb[ci][m], "pred": p[m], "a": pa[m], "_key": 0.0})
        if mode == "all":
            r_, c_ = np.nonzero(~np.isnan(pred))
            return pd.DataFrame({"l": ida[r_], "r": idb[c_], "pred": pred[r_, c_], "a": np.nan, "_key": 0.0})
        key = np.where(np.isnan(pred), _KEY_INF, -np.round(np.nan_to_num(pred), 9))
        key[ri, ci] = _KEY_INF
        t = _local_topk(key, np.nan_to_num(pred), ida, idb, n, False)
        return pd.DataFrame({"l": t["e1"], "r": t["e2"], "pred": t["score"], "a": np.nan, "_key": t["_key"]})

    def sparse_cell(ida, idb, res, kn):
        nb_ = len(idb)
        r_, c_, num, den = touched(res, nb_)
        m = num > 0
        r_, c_, pred = r_[m], c_[m], num[m] / den[m]
        lin = r_ * nb_ + c_
        pl = kn["l"].to_numpy("int64")
        pr = kn["r"].to_numpy("int64")
        pa = kn["x"].to_numpy("float64")
        ri = np.searchsorted(ida, pl)
        ci = np.searchsorted(idb, pr)
        ok = (ri < len(ida)) & (ci < nb_)
        ok[ok] = (ida[ri[ok]] == pl[ok]) & (idb[ci[ok]] == pr[ok])
        klin = ri[ok] * nb_ + ci[ok]
        is_known = np.isin(lin, klin)
        if mode == "all":
            return pd.DataFrame({"l": ida[r_], "r": idb[c_], "pred": pred, "a": np.nan, "_key": 0.0})
        if mode == "seen":
            amap = dict(zip(klin.tolist(), pa[ok].tolist()))
            s_ = is_known
            a_ = np.array([amap[x] for x in lin[s_].tolist()], dtype="float64")
            return pd.DataFrame({"l": ida[r_[s_]], "r": idb[c_[s_]], "pred": pred[s_], "a": a_, "_key": 0.0})
        u = ~is_known
        r_, c_, pred = r_[u], c_[u], pred[u]
        kv = -np.round(pred, 9)
        o = np.lexsort((c_, kv, r_))
        r_, c_, kv, pred = r_[o], c_[o], kv[o], pred[o]
        if len(r_) == 0:
            return pd.DataFrame({"l": np.array([], "int64"), "r": np.array([], "int64"), "pred": [], "a": [],
                                 "_key": []}).astype({"pred": "float64", "a": "float64", "_key": "float64"})
        starts = np.r_[0, np.flatnonzero(np.diff(r_)) + 1]
        pos = np.arange(len(r_)) - np.repeat(starts, np.diff(np.r_[starts, len(r_)]))
        keep = pos < (n if n is not None else len(r_))
        return pd.DataFrame({"l": ida[r_[keep]], "r": idb[c_[keep]], "pred": pred[keep], "a": np.nan,
                             "_key": kv[keep]})

    out = rows.groupBy("_bl", "_br").applyInPandas(cell, "l long, r long, pred double, a double, _key double")
    if mode == "all":
        return out.select("l", "r", "pred")
    if mode == "seen":
        return out.select("l", "r", "pred", "a")
    w = Window.partitionBy("l").orderBy(F.col("_key").asc(), F.col("r").asc())
    r = out.withColumn("rank", F.row_number().over(w))
    if n is not None:
        r = r.filter(F.col("rank") <= n)
    return r.select("l", "r", "pred", "rank")
