"""Neighbour-based mutual information against the definition, and its order of dependent and free columns."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import profile


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def slow(x, y, k=3):
    n = [i for i in range(len(x)) if sum(y == y[i]) > 1]
    x, y = x[n], y[n]
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(np.delete(x[y == y[i]], list(np.flatnonzero(y == y[i])).index(i)) - x[i]))
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(x == x[i]) if r == 0 else max(sum((x > x[i] - r) & (x < x[i] + r)), 1)
        total += digamma(kk) - digamma(len(own) + 1) - digamma(int(m))
    return max(digamma(len(x)) + total / len(x), 0.0)


def test_equals_the_definition_in_slices_of_any_size(spark):
    rng = np.random.default_rng(6)
    y = np.array([0] * 60 + [1] * 25 + [2] * 3 + [3])  # a class of three, and a row alone in its class
    a, b, c = y + rng.normal(size=len(y)), np.round(rng.normal(size=len(y)) * 2), np.full(len(y), 4.0)
    rows = [(int(y[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(len(y))]
    odd = [(None, 1.0, 1.0, 1.0), (0, None, None, None), (1, float("nan"), float("nan"), float("nan"))]
    df = spark.createDataFrame(rows + odd, "label_id int, a double, b double, c double")
    want = {"a": slow(a, y), "b": slow(b, y), "c": slow(c, y)}
    for size in (3, 10**5):
        got = {r["feature"]: r["mutual_info"] for r in profile.neighbour_information(df, ["a", "b", "c"], rows=size).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-8) for f in want), (size, got, want)
    assert want["a"] > want["b"] and want["c"] == 0.0
    assert profile.neighbour_information(df.limit(0), ["a"]).count() == 0


def test_digamma_of_whole_numbers(spark):
    rows = spark.range(1, 400).select("id", profile.digamma(F.col("id")).alias("d")).collect()
    assert all(math.isclose(r["d"], digamma(r["id"]), abs_tol=1e-9) for r in rows)
