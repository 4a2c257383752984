"""Mixing sources to target weights by fitting document lengths to budgets.

Each source has a target size.  Whole passes over the source cover the integer
part of target / size; the rest is a subset-sum: how many documents of each
exact length to take once more so that their lengths add up to the remaining
budget (each document as often as ``max_repeats`` still allows).  The counts by length are all that this needs, so a source of any size
is one histogram.  Most of the budget is spread over the lengths in proportion,
and the remainder is fitted by bounded-knapsack dynamic programming.  Documents
of one length are then chosen by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from reco.llm.common import free_name, stored
from reco.operators.ranking import global_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 42
DP_BUDGET = 1 << 16      # words left to the dynamic programme
DP_LIMIT = 1 << 22       # words it covers where only documents longer than that budget are left
HOT_SHARE = 1000         # a (source, size) with over 1/HOT_SHARE of all rows is split


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` -> with ``weight`` and ``target``.

    Sources in code point order (null last) get ``weights`` in turn and share
    the total size by weight; a target stops at ``max_repeats`` times its
    source, and what it can't use is shared by weight among the others.  That
    is ``min(cap, level * weight)`` with one level for all, found by repeated
    sums: only three numbers reach the driver a round.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank")
    w = stored(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                       ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
               .drop("_rank"), "targets")
    cap = (F.col("source_size") * max_repeats).cast("double")
    total = float(w.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > cap
        r = w.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if r[2] == n_capped or not r[1]:
            break
        n_capped, level = r[2], (total - (r[0] or 0.0)) / r[1]
    return w.withColumn("target", F.least(cap, F.col("weight") * (level or 0.0)))


def proportional(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The same share of every length, for most of the budget: an eighth (at
    most the programme's budget, at least two of the longest documents) is left
    to be fitted."""
    total = int((lengths * counts).sum())
    left = max(min(budget // 8, DP_BUDGET), 2 * int(lengths.max()))
    return np.array([int(c) * max(0, budget - left) // total for c in counts], dtype=np.int64)


def _programme(lengths: np.ndarray, left: np.ndarray, aim: int, top: int) -> np.ndarray:
    """How many of each length (at most ``left``) make the sum nearest to
    ``aim`` among those up to ``top``; the lower of two equally near ones."""
    # bounded knapsack: bit s of `reach` says that s words can be made;
    # first[s] is the bundle that first made them
    take = np.zeros(len(lengths), np.int64)
    full = (1 << (top + 1)) - 1
    reach, first, bundles = 1, np.full(top + 1, -1, dtype=np.int64), []
    for i in np.argsort(lengths, kind="stable"):
        length = int(lengths[i])
        n, size = min(int(left[i]), top // length), 1
        while n > 0 and not reach >> aim & 1:   # binary bundles of 1, 2, 4, ... documents
            size = min(size, n)
            new = (reach << (length * size)) & full & ~reach
            if new:
                at = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(at[: top + 1])] = len(bundles)
                bundles.append((i, size))
                reach |= new
            n -= size
            size *= 2
    s = (reach & ((1 << (aim + 1)) - 1)).bit_length() - 1
    above = reach >> (aim + 1)
    if above and (above & -above).bit_length() < aim - s:
        s = aim + (above & -above).bit_length()
    while s > 0:
        i, size = bundles[first[s]]
        take[i] += size
        s -= int(lengths[i]) * size
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, uses: int = 1, over: bool = False) -> np.ndarray:
    """How many documents of each length to take so that the lengths add up to
    ``budget`` as nearly as possible (lengths distinct and positive, ``0 <=
    budget <= sum``): never above it, or with ``over`` on either side.  Each of
    the ``counts`` documents can be taken ``uses`` times."""
    take = proportional(lengths, counts, budget)
    rest = budget - int((lengths * take).sum())
    counts = counts * uses
    # documents too long for the programme: one in coarser units, rounded up,
    # so that what is lost is at most a unit for each of the few that fit
    far = lengths > DP_LIMIT - DP_BUDGET
    if rest > DP_LIMIT and far.any():
        unit = -(-rest // DP_LIMIT)
        take[far] += _programme(-(-lengths[far] // unit), (counts - take)[far], rest // unit, rest // unit)
        rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):      # long documents first, down to the programme's budget
        if rest <= DP_BUDGET:
            break
        length, left = int(lengths[i]), int(counts[i] - take[i])
        spare = DP_BUDGET // 2 if length <= DP_LIMIT - DP_BUDGET else 0     # the programme can't take longer ones
        k = min(left, max(0, (rest - spare) // length))
        take[i] += k
        rest -= k * length
        if k < left and DP_BUDGET < length <= rest:     # one more fits: for the programme to choose, before shorter ones
            break
    aim = min(rest, DP_LIMIT)
    return take + _programme(lengths, counts - take, aim, aim + min(aim, DP_BUDGET) if over else aim)


def _plan_source(pdf: pd.DataFrame, max_repeats: int) -> pd.DataFrame:
    """Histogram rows of one source -> passes and extra documents per row."""
    size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    budget = int(target + 0.5)
    passes = budget // size if size else 0
    pdf = pdf.sort_values(["size", "bucket"], kind="stable").reset_index(drop=True)
    real = pdf["size"].to_numpy() > 0
    by_size = pdf[real].groupby("size")["n"].sum()
    extra = fit_counts(by_size.index.to_numpy(np.int64), by_size.to_numpy(np.int64), budget - passes * size,
                       max_repeats - passes, over=True) if 0 < size and passes < max_repeats else []
    left, out = dict(zip(by_size.index, extra)), []
    held = dict(by_size)
    for length, n in zip(pdf["size"], pdf["n"]):       # the rows of one length share its documents evenly
        k = -(-int(left.get(length, 0)) * int(n) // int(held[length])) if left.get(length, 0) else 0
        if k:
            left[length] -= k
        if length in held:
            held[length] -= n
        out.append(k)
    return pdf.assign(passes=passes, extra=np.array(out, dtype=np.int64))[
        ["source", "size", "bucket", "n", "source_size", "target", "passes", "extra"]]


PLAN = "source string, size long, bucket int, n long, source_size long, target double, passes long, extra long"
NAMES = ("size", "source_size", "target", "takes")


def mix(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id",
        weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, names: tuple = NAMES) -> DataFrame:
    """``docs`` with ``size, source_size, target, takes`` (how often the mix
    takes the document: 0 to ``max_repeats``; ``names`` gives other names) in
    place of same-named columns.

    Null sources form one source, last in order.  Documents of size 0 are taken
    as often as their source has whole passes.  Rows that repeat an id are
    documents of their own; which of several equal rows is taken makes no
    difference.  Reruns with one seed agree.  An empty table gives an empty
    result.
    """
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    taken = keep + list(names)
    src, siz, pick, bkt, ways = (free_name(taken, n) for n in ("_source", "_size", "_pick", "_bucket", "_ways"))
    src2, size2, bkt2, rnk = (free_name(taken, n) for n in ("_source2", "_size2", "_bucket2", "_rank"))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], size.cast("long").alias(siz),
                    F.col(f"`{source_col}`").cast("string").alias(src))
    d = d.withColumn(pick, F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), F.lit(1 << 40)))
    narrow = stored(d.select(src, siz, pick), "sizes")
    # at most HOT_SHARE groups can hold over 1/HOT_SHARE of the rows each
    n = narrow.count()
    hot = F.broadcast(narrow.groupBy(F.col(src).alias(src2), F.col(siz).alias(size2)).agg(F.count(F.lit(1)).alias("n"))
                      .filter(F.col("n") * HOT_SHARE > n)
                      .select(src2, size2, F.ceil(F.col("n") * HOT_SHARE / F.lit(max(n, 1))).alias(ways)))

    def bucketed(x: DataFrame) -> DataFrame:
        j = x.join(hot, F.col(src).eqNullSafe(F.col(src2)) & (F.col(siz) == F.col(size2)), "left").drop(src2, size2)
        return j.withColumn(bkt, F.floor(F.col(pick) * F.coalesce(ways, F.lit(1)) / F.lit(1 << 40)).cast("int")).drop(ways)

    hist = stored(bucketed(narrow).groupBy(F.col(src).alias("source"), F.col(siz).alias("size"), F.col(bkt).alias("bucket"))
                  .agg(F.count(F.lit(1)).alias("n")), "lengths")
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                             weights, max_repeats)
    t = targets.select(F.col("source").alias(src2), "source_size", "target")
    plan = (hist.join(t, F.col("source").eqNullSafe(F.col(src2))).drop(src2)
            .groupBy("source").applyInPandas(lambda pdf: _plan_source(pdf, max_repeats), PLAN))
    own = free_name(taken, "_plan")
    plan = stored(plan, "plan").select(F.col("source").alias(src2), F.col("size").alias(size2), F.col("bucket").alias(bkt2),
                                       F.struct("n", "source_size", "target", "passes", "extra").alias(own))
    j = bucketed(d).join(plan, F.col(src).eqNullSafe(F.col(src2)) & (F.col(siz) == F.col(size2)) & (F.col(bkt) == F.col(bkt2)))
    order = Window.partitionBy(src, siz, bkt).orderBy(pick)
    n, extra = F.col(f"{own}.n"), F.col(f"{own}.extra")
    takes = F.col(f"{own}.passes") + F.expr(f"{own}.extra div {own}.n") + (F.col(rnk) <= extra % n).cast("long")
    return (j.withColumn(rnk, F.row_number().over(order))
            .select(*[F.col(f"`{c}`") for c in keep], F.col(siz).alias(names[0]), F.col(f"{own}.source_size").alias(names[1]),
                    F.col(f"{own}.target").alias(names[2]), takes.alias(names[3])))


def mixed_rows(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the
    columns of ``docs``, whatever their names."""
    own = tuple(free_name(docs.columns, f"_{n}") for n in NAMES)
    m = mix(docs, size, names=own, **options)
    again = free_name(docs.columns + list(own), "_again")
    return (m.filter(F.col(own[3]) > 0)
            .withColumn(again, F.explode(F.sequence(F.lit(1), F.col(own[3]))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
