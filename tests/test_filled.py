"""Best stored points, pooled figure, failures and guard of the document runs, and mixtures that settle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes, docs, evaluate, fitted


def test_best_points(spark):
    points = spark.createDataFrame([("x", "p2", 0.7), ("x", "p1", 0.7), ("x", "p0", 0.6), ("y", "q", 0.5), ("z", "r", 0.0), (None, "n", 0.9), ("y", "m", None)], "family string, point string, group_acc double")
    assert evaluate.best_points(points, ["x", "y"]) == {"x": "p1", "y": "q"}
    for missing in ("z", "other"):
        with pytest.raises(ValueError):
            evaluate.best_points(points, ["x", missing])
    rows = [(i, i % 2, m, (i % 2) if i < n else 1 - i % 2) for m, n in (("p1", 30), ("q", 10)) for i in range(40)]
    out = evaluate.compare_best(spark.createDataFrame(rows, "row_id long, y int, model string, pred int"), points, "x", "y").first()
    assert (out["point_a"], out["point_b"], out["a_only"], out["b_only"]) == ("p1", "q", 20, 0)
    assert out["p_value"] == pytest.approx(2 * 0.5 ** 20, rel=1e-9) and out["verdict"] == "A significantly better"


def test_pooled_figure(spark):
    pred = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (1, 1, 50.0, 50.0, 60.0, 60.0, 0.2, 0), (2, 0, 0.0, 0.0, 10.0, 10.0, 0.8, 1)],
                                 "image_id long, cand_id long, x1 double, y1 double, x2 double, y2 double, score double, part int")
    gt = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 10.0, 10.0), (3, 1, 0.0, 0.0, 9.0, 9.0)], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = boxes.pooled_figure(pred, gt).first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"], got["pairs"], got["gt_boxes"]) == (2, 0, 0, 1.0, 2, 2)  # image 3 was answered by no part
    assert 0.2 < got["threshold"] <= 0.8
    with pytest.raises(ValueError):
        boxes.pooled_figure(pred.withColumn("part", F.col("cand_id").cast("int")), gt)


def test_failures_and_guard(spark):
    listing = spark.createDataFrame([("a", "a", 1, "1_x.docx", "one two"), ("a", "a", 2, "2_x.docx", "three")], "folder string, case_id string, track int, name string, text string")
    cases = spark.createDataFrame([("a",), ("gone",), ("gone",), ("also gone",)], "case_id string")
    got = docs.evidence_run(cases, listing).first()
    assert (got["cases"], got["failures"], got["cases_with_notice"]) == (1, "also gone, gone", 1)
    assert docs.evidence_run(cases.filter("case_id = 'a'"), listing).first()["failures"] == ""
    sections = spark.createDataFrame([("a", i) for i in range(3)], "case_id string, section_no int")
    assert {tuple(r) for r in docs.section_guard(cases, sections, 3).collect()} == {("a", 3, True), ("gone", 0, False), ("also gone", 0, False)}


def test_mixture_settles_where_plain_em_does(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-3, 1, 300), rng.normal(4, 0.5, 100)])
    rows = [(0, float(v)) for v in x] + [(1, float(v)) for v in rng.normal(0, 1, 10)]
    df = spark.createDataFrame(rows, "y int, v double")
    got = {(r["k"], r["comp"]): r for r in fitted.mixture_em(df, ["v"], "y", tolerance=1e-6).collect()}
    w, m, s = np.array([0.5, 0.5]), x.mean() + np.array([-0.5, 0.5]) * np.sqrt(x.var() + 1e-4), np.full(2, x.var() + 1e-4)
    trace = []
    for _ in range(got[0, 0]["rounds"]):
        d = np.log(w) - 0.5 * ((x[:, None] - m) ** 2 / s + np.log(2 * np.pi * s))
        ll = np.logaddexp(d[:, 0], d[:, 1])
        trace.append(ll.mean())
        r = np.exp(d - ll[:, None])
        w, m = r.mean(0), (r * x[:, None]).sum(0) / r.sum(0)
        s = (r * x[:, None] ** 2).sum(0) / r.sum(0) - m ** 2 + 1e-4
    for c in (0, 1):
        assert [got[0, c]["w"], got[0, c]["m_v"], got[0, c]["v_v"], got[0, c]["ll"]] == pytest.approx([w[c], m[c], s[c], trace[-1]], abs=1e-7)
    assert trace[-1] - trace[-2] < 1e-6 <= trace[-2] - trace[-3] and got[0, 0]["fell"] == 0
    assert got[1, 0]["m_v"] == pytest.approx(got[1, 1]["m_v"]) and got[1, 0]["rounds"] <= 3  # too few rows: one component
    few = fitted.mixture_em(df, ["v"], "y", rounds=2).collect()
    assert {r["rounds"] for r in few} == {2} and len(few) == 4
