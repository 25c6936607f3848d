"""Sums of probabilities are made once per row."""

import re

import __spark_entry__ as entry
from tests.conftest import SF


def test_no_sum_inside_a_loop_over_classes(spark):
    plan = entry.queries()["p10_prior_correction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not re.search(r"lambda x_\d+#\d+ / aggregate\(", plan)
