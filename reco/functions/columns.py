"""Scalar column functions.

Every function returns a built-in ``Column`` expression, so it stays inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_int(x: ColumnOrName) -> Column:
    """``int(x)``; malformed input becomes null instead of failing."""
    return _c(x).try_cast("int")


def confidence_step(r: ColumnOrName, threshold: float = 2.0) -> Column:
    """R <= threshold -> 0, otherwise r."""
    r = _c(r)
    return F.when(r <= threshold, F.lit(0.0)).otherwise(r.cast("double"))


# Fixed values (defaults of log_confidence): offset 1.005, scale 1e8, plus r.
def log_confidence(r: ColumnOrName, scale: float = 1e8, add_linear: bool = True,
                   offset: float = 1.005) -> Column:
    """ln(offset + r*scale) + r.  X5 variants: ``scale=1, add_linear=True``
    and ``scale=100, add_linear=False``."""
    r = _c(r).cast("double")
    v = F.log(F.lit(offset) + r * F.lit(scale))
    return v + r if add_linear else v


def tier_weight(r: ColumnOrName, tier: ColumnOrName, weights: dict[str, float]) -> Column:
    """Multiply by a per-tier weight (1 when the tier is not listed)."""
    w = F.lit(1.0)
    for name, val in weights.items():
        w = F.when(_c(tier) == name, F.lit(float(val))).otherwise(w)
    return _c(r).cast("double") * w


def preference(r: ColumnOrName, threshold: float = 3.0) -> Column:
    """1 if r > threshold else 0 (scores 1-3 dislike, 4-5 like)."""
    return F.when(_c(r) > threshold, F.lit(1)).otherwise(F.lit(0))


def cosine(dot: ColumnOrName, norm_sq_a: ColumnOrName, norm_sq_b: ColumnOrName) -> Column:
    """Dot / (sqrt(|a|^2) * sqrt(|b|^2))."""
    return _c(dot) / (F.sqrt(_c(norm_sq_a)) * F.sqrt(_c(norm_sq_b)))


def cosine_distance(cos: ColumnOrName) -> Column:
    """2(1 - cos) = |a - b|^2 of unit vectors, in [0, 4]."""
    return 2.0 * (1.0 - _c(cos))


def distance_to_weight(d: ColumnOrName) -> Column:
    """1 - d/2, which equals the cosine again."""
    return 1.0 - _c(d) / 2.0


def like_label(p: ColumnOrName, threshold: float = 0.70) -> Column:
    """X11: 1.0 if p > threshold else 0.0."""
    return F.when(_c(p) > threshold, F.lit(1.0)).otherwise(F.lit(0.0))


def abs_error(a: ColumnOrName, b: ColumnOrName) -> Column:
    """|a - b|."""
    return F.abs(_c(a) - _c(b))


def squared_error(a: ColumnOrName, b: ColumnOrName) -> Column:
    """(a - b)^2."""
    return F.pow(_c(a) - _c(b), 2)


def percent_rank_expr(position: ColumnOrName, n: ColumnOrName, inclusive: bool = False) -> Column:
    """W2 / W2b from a 1-based position and a group size.

    W2: 100*(i-1)/n (n=1 -> [0], n=2 -> [0, 50]).
    W2b: 100*(i-1)/(n-1), with n=1 -> 0."""
    i, n = _c(position).cast("double"), _c(n).cast("double")
    if not inclusive:
        return 100.0 * (i - 1) / n
    return F.when(n <= 1, F.lit(0.0)).otherwise(100.0 * (i - 1) / (n - 1))


SPLIT_PRIME = 2147483647  # 2^31 - 1


def split_multipliers(seed: int, salt: int = 0, n: int = 2) -> list[int]:
    """``n`` multipliers and an offset below ``SPLIT_PRIME``, all drawn from
    (seed, salt), so that splits of different seeds are independent and an
    inner split (another salt) is independent of the outer one of its seed."""
    rng = random.Random(f"split-{salt}-{seed}")
    return [rng.randrange(1, SPLIT_PRIME) for _ in range(n)] + [rng.randrange(SPLIT_PRIME)]


def hash_bucket(cols: list[ColumnOrName], seed: int = 0, buckets: int = 100, salt: int = 0) -> Column:
    """Deterministic split bucket in [0, buckets): a pairwise independent hash
    ``((sum(col_i * m_i) + c) mod p) mod buckets`` whose multipliers come from
    the seed.  Plain integer arithmetic, so the same split is reproducible in
    any SQL engine and under task retries (M18, SURVEY §7.4)."""
    *multipliers, acc = split_multipliers(seed, salt, len(cols))
    p = F.lit(SPLIT_PRIME).cast("long")
    acc = F.lit(acc).cast("long")
    for c, m in zip(cols, multipliers):
        acc = acc + F.pmod(F.pmod(_c(c).cast("long"), p) * F.lit(m).cast("long"), p)
    return F.pmod(F.pmod(acc, p), F.lit(buckets))
