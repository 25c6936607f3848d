"""Macros over a fixed, short list of columns.

They expand to plain arithmetic, which stays inside whole-stage codegen; higher-order functions are
kept for arrays of unknown length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

EPS = 1e-9  # fixed value: the epsilon of the guarded divisions
TINY = 2.220446049250313e-16


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def mean(cols: Sequence[Column]) -> Column:
    return total(cols) / len(cols)


def count_true(conds: Sequence[Column]) -> Column:
    return total([F.when(c, F.lit(1.0)).otherwise(0.0) for c in conds])


def greatest(cols: Sequence[Column]) -> Column:
    return F.greatest(*cols)


def least(cols: Sequence[Column]) -> Column:
    return F.least(*cols)


def clean(col: Column) -> Column:
    """NaN, infinity and null become 0."""
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(col)


def quantile_sorted(sorted_arr: Column, n: int, p: float) -> Column:
    pos = (n - 1) * p
    lo = int(pos)
    frac = pos - lo
    a = F.element_at(sorted_arr, lo + 1)
    if frac == 0:
        return a
    return a + (F.element_at(sorted_arr, lo + 2) - a) * frac


def central_moment(cols: Sequence[Column], mu: Column, k: int) -> Column:
    def power(d: Column) -> Column:
        return reduce(lambda a, b: a * b, [d] * k)
    return total([power(c - mu) for c in cols]) / len(cols)


def summary(df, cols: Sequence[Column], prefix: str):
    """Thirteen distribution statistics of a short vector, as columns ``<prefix>_*`` of ``df``."""
    n = len(cols)
    p = f"__{prefix}"
    df = df.withColumns({f"{p}_mu": mean(cols), f"{p}_s": F.array_sort(F.array(*cols))})
    mu, s = F.col(f"{p}_mu"), F.col(f"{p}_s")
    df = df.withColumns({f"{p}_m2": central_moment(cols, mu, 2), f"{p}_m3": central_moment(cols, mu, 3),
                         f"{p}_m4": central_moment(cols, mu, 4)})
    m2, m3, m4 = (F.col(f"{p}_m{k}") for k in (2, 3, 4))
    spread = m2 > (mu * TINY) * (mu * TINY)
    g1 = m3 / F.pow(m2, F.lit(1.5)) * ((n * (n - 1)) ** 0.5 / (n - 2))
    g2 = ((n * n - 1.0) * m4 / (m2 * m2) - 3.0 * (n - 1) ** 2) / ((n - 2) * (n - 3))
    lo, hi = F.element_at(s, 1), F.element_at(s, n)
    q25, q50, q75 = (quantile_sorted(s, n, q) for q in (0.25, 0.5, 0.75))
    std = F.sqrt(m2)
    return df.withColumns({
        f"{prefix}_min": lo, f"{prefix}_max": hi, f"{prefix}_mean": mu, f"{prefix}_std": std,
        f"{prefix}_median": q50, f"{prefix}_q25": q25, f"{prefix}_q75": q75, f"{prefix}_iqr": q75 - q25,
        f"{prefix}_range": hi - lo, f"{prefix}_sum": total(cols),
        f"{prefix}_cv": std / (F.abs(mu) + EPS),
        f"{prefix}_skew": F.when(spread, g1).otherwise(0.0),
        f"{prefix}_kurt": F.when(spread, g2).otherwise(0.0),
    }).drop(f"{p}_mu", f"{p}_s", f"{p}_m2", f"{p}_m3", f"{p}_m4")


SUMMARY_NAMES = ["min", "max", "mean", "std", "median", "q25", "q75", "iqr", "range", "sum", "cv", "skew", "kurt"]


def linear_fit(x: Sequence[Column], y: Sequence[Column]) -> tuple[Column, Column]:
    """Least-squares slope and R squared of y on x, with guarded denominators."""
    mx, my = mean(x), mean(y)
    sxx = total([(a - mx) * (a - mx) for a in x])
    syy = total([(b - my) * (b - my) for b in y])
    sxy = total([(a - mx) * (b - my) for a, b in zip(x, y)])
    return sxy / (sxx + EPS), (sxy * sxy) / (sxx * syy + EPS)


def distinct_count(cols: Sequence[Column]) -> Column:
    """How many different values; value i counts when no earlier one equals it."""
    fresh = [F.lit(1.0)]
    for i in range(1, len(cols)):
        seen = reduce(lambda a, b: a | b, [cols[j] == cols[i] for j in range(i)])
        fresh.append(F.when(seen, 0.0).otherwise(1.0))
    return total(fresh)


def first_index_of(cols: Sequence[Column], target: Column) -> Column:
    out = F.lit(float(len(cols) - 1))
    for i in reversed(range(len(cols) - 1)):
        out = F.when(cols[i] == target, F.lit(float(i))).otherwise(out)
    return out
