"""Fits use all cores: rows are spread by their number, independent fits run at a time."""

from threading import Barrier

from pyspark.sql import functions as F

from tessera.operators import models as M


def test_few_bytes_are_spread_by_rows(spark):
    rows = spark.range(20_000).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("double").alias("x"))
    got = M.assemble(rows, ["x"], ["row_id"])
    assert got.rdd.getNumPartitions() == 5
    assert got.count() == 20_000 and got.select("row_id").distinct().count() == 20_000
    assert M.assemble(rows.limit(10), ["x"], ["row_id"]).rdd.getNumPartitions() == 1
    assert M.assemble(rows.limit(0), ["x"], ["row_id"]).count() == 0


def test_fits_run_at_a_time_and_keep_their_order(spark):
    meet = Barrier(3)

    def run(i):
        meet.wait(60)  # passes only if three run at once
        return spark.range(i).count()

    assert M.side_by_side(spark, run, [5, 3, 9], 3) == [5, 3, 9]
    assert M.side_by_side(spark, run, []) == []


def test_heads_are_added_without_a_join(spark, tables):
    from tessera.plans.models import Q, data
    d = data(tables)
    got = M.hierarchical(d.filter("fold <> 0"), d.filter("fold = 0"), params=Q["forest"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert len(rows) == d.filter("fold = 0").count() and all(abs(sum(r["probs"]) - 1) < 1e-9 and len(r["probs"]) == 10 for r in rows)
    scaled = M.hierarchical(d.filter("fold <> 0"), d.filter("fold = 0"), "logistic", {"maxIter": 2}).collect()
    assert len(scaled) == len(rows) and all(abs(sum(r["probs"]) - 1) < 1e-9 for r in scaled)
