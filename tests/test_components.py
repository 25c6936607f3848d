"""Connected components: few rounds in whatever order the ids of a chain lie, and planning that does not grow with them."""

import numpy as np

from tessera.operators import raster
from tessera.session import recut


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ids = rng.permutation(6_000).tolist()  # two chains in random order of ids
    chain = [*zip(ids[:4_000], ids[1:4_000]), *zip(ids[4_000:], ids[4_001:])]
    written = []
    monkeypatch.setattr(raster, "recut", lambda df: written.append(df) or recut(df))
    nodes = spark.range(6_001).withColumnRenamed("id", "node")
    got = {r.node: r.label for r in raster.connected(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {6_000: 6_000} | {i: min(part) for part in (ids[:4_000], ids[4_000:]) for i in part}
    assert got == want
    assert len(written) <= 2 + 2 * 14


def test_size_estimates_do_not_grow_with_rounds(spark):
    digits, d = [], spark.range(10)
    for _ in range(6):
        other = d.withColumnRenamed("id", "b")
        d = recut(d.join(other, d["id"] == other["b"]).select("id"))
        digits.append(len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert digits[-1] == digits[0]


def test_odd_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    label = lambda rows: [r.label for r in raster.connected(nodes, edges(rows)).orderBy("node").collect()]
    assert label([]) == [0, 1, 2, 3, 4] == label([(2, 2), (9, 3)])
    assert label([(4, 1), (4, 1), (1, 4), (3, 0)]) == [0, 1, 2, 0, 1]
    assert raster.connected(nodes.limit(0), edges([(1, 2)])).count() == 0
