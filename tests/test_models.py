"""Invariants of fitted results."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SF


@pytest.mark.parametrize("name", ["m05_mixture_components", "m18_hill_climb", "m28_probe_features", "m29_probe_quality", "m33_importance", "a29_bootstrap_gain"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_weights_sum_to_one(spark):
    w = entry.queries()["m18_hill_climb"](spark, SF).toPandas()["weight"]
    assert np.isclose(w.sum(), 1)


def test_out_of_fold_rows_are_probabilities(spark, tables):
    from tessera.operators import models
    from tessera.plans.models import data
    d = data(tables)
    oof = models.out_of_fold(d, "forest", [0, 1]).toPandas()
    assert oof["row_id"].is_unique and np.allclose(np.vstack(oof["probs"]).sum(axis=1), 1)


def test_shuffled_labels_score_low(spark):
    assert entry.queries()["m24_shuffled_control"](spark, SF).first()["accuracy"] < 0.35


def test_probes_recover_planted_targets(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from tessera.operators import models
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    rows = [(i, v.tolist(), int(v[0] > 0), int(v[1] > 0), float(2 * v[2] - v[3] + 1)) for i, v in enumerate(x)] + [(400, [0.0] * 4, None, 0, None)]
    d = spark.createDataFrame(rows, "row_id bigint, x array<double>, side int, y int, level double").withColumn("features", array_to_vector("x"))
    classes, levels = {"side": 2}, ["level"]
    block = models.probe_block(d.filter("row_id % 2 = 0"), d.filter("row_id % 2 = 1"), classes, levels, reg=1e-4)
    report = {(r["probe"], r["metric"]): r["value"] for r in models.probe_report(block, classes, levels).collect()}
    true = np.array([r[2] for r in rows if r[0] % 2])
    assert report["side", "accuracy"] > 0.95 and report["side", "auc"] > 0.99 and report["level", "r2"] > 0.999
    assert np.isclose(report["side", "majority"], max(true.mean(), 1 - true.mean()))
    vectors = models.probe_vectors(block, classes, levels, ["row_id"]).toPandas()
    assert len(vectors) == 200 and {len(v) for v in vectors["features"]} == {6}


def test_spec_keys_tell_points_apart(spark):
    from tessera.operators import search
    base = spark.createDataFrame([("full",), ("top60",)], "features string")
    specs = search.stage_specs(base, {"a": {"n": [1, 2], "r": [0.5]}, "b": {"k": [1]}})
    assert specs.count() == 6 == specs.select("spec_key").distinct().count()
    assert search.open_specs(specs, specs.filter("model = 'a'")).count() == 2
    bags = search.switched(specs, {"features": ["full"], "bag": [1, 5]})
    assert bags.count() == 12 and set(bags.columns) == {"model", "params", "spec_key", "features", "bag"}
