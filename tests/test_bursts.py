"""Burst groups of flows that are cut into slices, against a plain walk over each flow."""

import random

from pyspark.sql import functions as F

from tessera.operators import flows

GAPS = [0.001, 0.02]


def walk(rows):
    """(flow, threshold) -> groups, largest by packets and by bytes, mean splitting gap, packets per group."""
    out = {}
    for f in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: r[1])
        for x in GAPS:
            groups, splits = [[mine[0][3]]], []
            for a, b in zip(mine, mine[1:]):
                if b[2] - a[2] >= x:
                    groups.append([])
                    splits.append(b[2] - a[2])
                groups[-1].append(b[3])
            out[f, x] = (len(groups), max(map(len, groups)), max(map(sum, groups)), round(sum(splits) / len(splits) if splits else 0.0, 9), round(len(mine) / len(groups), 9))
    return out


def packets(seed=4, hot=3000):
    rng = random.Random(seed)
    rows = []
    for f, n in [(0, hot), (1, 1), (2, 7), (3, 8), (4, 9), (None, 5)]:
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.0005, 0.001, 0.01, 0.02, 0.3]) if f != 2 else 0.0
            rows.append((f, i, t, rng.randrange(1, 1500)))
    rng.shuffle(rows)
    return rows


SCHEMA = "flow bigint, i bigint, t double, size bigint"


def test_slices_equal_a_walk(spark):
    rows = packets()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = walk(rows)
    for size in (1, 8, 100, 10**6):
        got = {(r["flow"], r["threshold"]): (r["n_groups"], r["group_max_packets"], r["group_max_bytes"], round(r["group_gap_mean"], 9), round(r["packets_per_group"], 9))
               for r in flows.burst_table(df, "flow", "i", "t", "size", GAPS, size).collect()}
        assert got == want, size


def test_no_task_orders_a_hot_flow(spark):
    """One flow holds nearly all packets; no task gets more than a few slices of it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(packets(hot=4000), SCHEMA)
        per_task = flows.burst_rows(df, "flow", "i", "t", "size", GAPS, 50).groupBy(F.spark_partition_id()).count()
        assert per_task.agg(F.max("count")).first()[0] <= 400
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_nulls_and_empty(spark):
    """Missing numbers come first; a missing time splits nothing; no packets, no rows."""
    rows = [(1, None, 0.0, 5), (1, 0, 1.0, 6), (1, 1, None, 7), (1, 2, 3.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["threshold"]: r for r in flows.burst_table(df, "flow", "i", "t", "size", GAPS, 1).collect()}
    assert all(r["n_groups"] == 2 and r["group_max_packets"] == 3 and r["group_max_bytes"] == 13 and r["group_gap_mean"] == 1.0 for r in got.values())
    assert flows.burst_table(df.limit(0), "flow", "i", "t", "size", GAPS).count() == 0
