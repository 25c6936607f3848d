"""Boosted trees against a plain form of one tree, planted classes and odd rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, models

SCHEMA = "row_id bigint, fold int, y int, x array<double>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector("x")))


@pytest.fixture(scope="module")
def planted():
    """Three classes cut out of two columns, a third column of noise; one class needs both columns."""
    x = np.random.default_rng(8).normal(size=(900, 3))
    y = np.where(x[:, 0] > 0.3, np.where(x[:, 1] > 0, 2, 1), 0)
    return [(i, i % 3, int(y[i]), x[i].tolist()) for i in range(len(x))]


def accuracy(rows):
    return rows.select(F.avg((F.array_position("probs", F.array_max("probs")) - 1 == F.col("y")).cast("double"))).first()[0]


def test_first_tree_is_the_best_cut(spark, planted):
    """Round one, level one: the chosen split has the largest gain of all splits, counted here without bins' help."""
    t = boosting.fit(frame(spark, planted), 3, params={"maxIter": 1, "maxDepth": 1, "stepSize": 1.0})
    x, y = np.array([r[3] for r in planted]), np.array([r[2] for r in planted])
    prior = (np.bincount(y, minlength=3) + 1) / (len(y) + 3)
    for k in range(3):
        g, h = prior[k] - (y == k), np.full(len(y), prior[k] * (1 - prior[k]))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = {}
        for j in range(3):
            for b, edge in enumerate(t.edges[0][j]):
                left = x[:, j] <= edge
                gains[j, b] = score(left) + score(~left) - score(np.ones(len(y), bool))
        j, b = max(gains, key=gains.get)
        assert (t.feature[0, 0, k, 0], t.border[0, 0, k, 0]) == (j, b)
        left = x[:, j] <= t.edges[0][j][b]
        want = [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
        assert np.allclose(t.leaf[0, 0, k], want, atol=1e-4)


def test_held_out_rows_of_planted_classes(spark, planted):
    rows = models.out_of_fold(frame(spark, planted), "boosted", [0, 1, 2], 3, {"maxIter": 12, "maxDepth": 3, "stepSize": 0.3})
    assert rows.count() == 900 and accuracy(rows) > 0.95
    assert rows.filter((F.size("probs") != 3) | (F.abs(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9)).count() == 0


def test_folds_grow_as_if_alone_and_order_does_not_matter(spark, planted):
    """The model of a fold equals one fitted on the other folds' rows, with rows dealt over many tasks in another order."""
    params = {"maxIter": 12, "maxDepth": 2, "stepSize": 0.3}
    d = frame(spark, planted)
    both = boosting.fit(d, 3, [0, 1], params=params)
    alone = boosting.fit(d.filter("fold <> 1").orderBy(F.desc("row_id")).repartition(5), 3, params=params)
    assert (both.feature[:, 1] == alone.feature[:, 0]).all() and (both.border[:, 1] == alone.border[:, 0]).all()
    assert np.allclose(both.leaf[:, 1], alone.leaf[:, 0])
    assert not (both.feature[:, 0] == alone.feature[:, 0]).all() or not np.allclose(both.leaf[:, 0], alone.leaf[:, 0])


def test_merge_over_many_tasks(spark, planted, monkeypatch):
    params = {"maxIter": 2, "maxDepth": 2}
    one = boosting.fit(frame(spark, planted).coalesce(1), 3, params=params)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    many = boosting.fit(frame(spark, planted).repartition(7), 3, params=params)
    assert (one.feature == many.feature).all() and np.array_equal(one.leaf, many.leaf)


def test_odd_rows(spark):
    """Null features, classes out of range, NaN, a constant column, one class only, no rows."""
    rows = [(i, i % 2, 1 if i % 4 < 2 else 0, [float(i % 4), 7.0]) for i in range(40)]
    odd = [(40, 0, 1, None), (41, 0, None, [1.0, 7.0]), (42, 1, 9, [1.0, 7.0]), (43, 1, 0, [float("nan"), 7.0])]
    d = frame(spark, rows + odd)
    t = boosting.fit(d, 2, params={"maxIter": 3, "maxDepth": 2, "stepSize": 0.5})
    got = {r["row_id"]: r["probs"] for r in boosting.score(t, d).collect()}
    assert len(got) == 44 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())
    assert all((got[i][1] > 0.5) == (i % 4 < 2) for i in range(40))
    lone = boosting.fit(d.filter("y = 1"), 2, params={"maxIter": 1, "maxDepth": 2})
    assert boosting.score(lone, d.limit(1)).first()["probs"][1] > 0.5
    none = boosting.fit(d.filter("false"), 2)
    assert boosting.score(none, d.limit(1)).first()["probs"] == [0.5, 0.5]
