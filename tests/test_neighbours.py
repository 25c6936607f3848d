"""Nearest rows of other folds: as a plain search has them, whatever the cells; shuffled bytes follow the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import models as M, neighbours as N


def frame(spark, x, y, fold, ids):
    rows = [(int(i), None if c is None else int(c), None if f is None else int(f), v.tolist()) for i, c, f, v in zip(ids, y, fold, x)]
    return spark.createDataFrame(rows, "row_id long, y int, fold int, x array<double>").select("row_id", "y", "fold", array_to_vector("x").alias("features"))


def plain(x, y, fold, ids, scales, k):
    """Every row against every other, as written in the definition."""
    out = {}
    for i in range(len(x)):
        if fold[i] not in scales:
            continue
        mean, factor = scales[fold[i]]
        a, b = (x[i] - mean) * factor, (x - mean) * factor
        d = np.sqrt(((a - b) ** 2).sum(-1))
        use = [j for j in range(len(x)) if fold[j] is not None and fold[j] != fold[i] and y[j] is not None]
        near = sorted((d[j], ids[j], y[j]) for j in use)[:k]
        if near:
            out[ids[i]] = [(float(a), int(b), int(c)) for a, b, c in near]
    return out


@pytest.mark.parametrize("kind", ["normal", "lattice", "copies", "lines"])
def test_as_a_plain_search(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    n = 900
    x = rng.normal(size=(n, 14)) * np.r_[1e4, 1e-3, np.ones(12)]
    if kind == "lattice":
        x = rng.integers(0, 3, (n, 5)).astype(float)
    if kind == "copies":
        x = x[rng.integers(0, 40, n)]
    if kind == "lines":
        x = np.column_stack([np.exp(rng.normal(size=n) * 6), np.zeros(n)])
    y, fold, ids = rng.integers(0, 4, n).tolist(), rng.integers(0, 3, n).tolist(), rng.permutation(n) * 7
    y[3], fold[5] = None, None
    factor = np.divide(1.0, x.std(0), out=np.zeros(x.shape[1]), where=x.std(0) > 0)
    scales = {0: (x.mean(0), factor), 2: (x.mean(0) * 1.1, factor * np.linspace(1, 2, x.shape[1]))}
    monkeypatch.setattr(N, "LEAST_ROWS", 60)
    monkeypatch.setattr(N, "LEAF_ROWS", 8)
    got = {r.row_id: [tuple(v) for v in r.near] for r in N.other_folds(frame(spark, x, y, fold, ids), scales, 5).collect()}
    assert got == plain(x, y, fold, ids.tolist(), scales, 5)


def test_few_rows(spark):
    x = np.arange(6.0).reshape(6, 1)
    d = frame(spark, x, [0, 1, 0, 1, 0, 1], [0, 0, 0, 0, 1, 1], range(6))
    got = {r.row_id: r.probs for r in M.neighbour_folds(d, [0, 1], 3).collect()}
    assert got == {i: [0.5, 0.5, 0.0] for i in range(6)}
    assert M.neighbour_folds(d.filter("fold = 0"), [0], 3).count() == 0 == M.neighbour_folds(d.limit(0), [0, 1], 3).count()
    one = M.fit_predict("neighbours", d.filter("row_id < 3"), d.filter("row_id >= 3"), 2).select("row_id", "y", "probs").orderBy("row_id").collect()
    assert [tuple(r) for r in one] == [(i, i % 2, [2 / 3, 1 / 3]) for i in (3, 4, 5)]


def test_shuffled_bytes_follow_the_rows(spark):
    d = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"),
                                   array_to_vector(F.array(*[F.rand(i) for i in range(3)], *[F.lit(1.0)] * 11)).alias("features")).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert M.out_of_fold(d, "neighbours", range(5)).count() == 20_000
    assert written() - before < 20 * 20_000 * 14 * 8
