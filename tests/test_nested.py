"""Nested label-aware chains against one plain fit per model, and what a held-out row may change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fitted


def frame(spark, changed=None):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        y = int(rng.integers(0, 10))
        x = [float(v) for v in np.round(rng.gamma(1 + y, 2.0, int(rng.integers(1, 7))), 3)]
        rows.append((i, (y + 1) % 10 if i == changed else y, int(rng.integers(0, 3)), int(rng.integers(0, 2)), x))
    rows += [(900, 1, 0, 1, []), (901, 2, 1, 0, None), (902, 3, 1, 0, [None, 2.0]), (903, 3, 1, 0, [2.0])]
    return spark.createDataFrame(rows, "flow_id long, label_id int, fold int, inner int, seq array<double>"), rows


def scores(df, **more):
    got = fitted.nested_chains(df, "flow_id", "label_id", "seq", 6, outers=3, inners=2, **more).collect()
    return {(r["flow_id"], r["held"]): (r["role"], r["ll"]) for r in got}


def plain(rows, o, i, bins=6):
    """Chains of the rows that a model may see, in plain Python."""
    seen = [r for r in rows if r[2] != o and r[3] != i]
    values = np.array([v for r in seen for v in r[4]])
    edges = np.unique(np.round(np.quantile(values, [k / bins for k in range(1, bins)]), 12))
    place = lambda x: np.searchsorted(edges, np.round(x, 12), "right")
    init, trans = np.full((10, bins + 1), 0.5), np.full((10, bins + 1, bins + 1), 0.5)
    for r in seen:
        s = place(r[4])
        init[r[1], s[0]] += 1
        for a, b in zip(s, s[1:]):
            trans[r[1], a, b] += 1
    init, trans = np.log(init / init.sum(1, keepdims=True)), np.log(trans / trans.sum(2, keepdims=True))
    return lambda x: init[:, place(x)[0]] + sum((trans[:, a, b] for a, b in zip(place(x), place(x)[1:])), np.zeros(10))


def test_nested_chains_equal_one_fit_per_model(spark):
    df, rows = frame(spark)
    got = scores(df)
    clean = [(*r[:4], [v for v in r[4] if v is not None]) for r in rows if r[4]]
    fits = {(o, i): plain(clean, o, i) for o in range(3) for i in (-1, 0, 1)}
    assert set(got) == {(r[0], o) for r in clean for o in range(3)}  # a row without values has no score
    for r in clean:
        for o in range(3):
            role, ll = got[r[0], o]
            assert role == ("valid" if r[2] == o else "train")
            assert ll == pytest.approx(list(fits[o, -1 if r[2] == o else r[3]](r[4])), abs=1e-9)
    assert fitted.nested_chains(df.limit(0), "flow_id", "label_id", "seq", 6, outers=3, inners=2).collect() == []


def test_a_changed_label_leaves_its_own_scores_alone(spark):
    before, after = scores(frame(spark)[0]), scores(frame(spark, changed=17)[0])
    assert all(before[17, o] == after[17, o] for o in range(3))
    assert any(before[k] != after[k] for k in before if k[0] != 17)


def test_inner_folds_are_even_within_class_and_outer_fold(spark):
    df = frame(spark)[0].drop("inner")
    cells = fitted.nested_inner(df, "flow_id", "label_id", inners=4).groupBy("label_id", "fold", "inner").count().collect()
    by = {}
    for r in cells:
        by.setdefault((r["label_id"], r["fold"]), []).append(r["count"])
    assert all(max(n) - min(n) <= 1 for n in by.values() if len(n) == 4)
    rows = fitted.nested_inner(df, "flow_id", "label_id", inners=4)
    assert rows.count() == df.count() and rows.filter(F.col("inner").between(0, 3)).count() == df.count()
