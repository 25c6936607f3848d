"""Boosted trees for many classes, grown from histograms that Spark adds up.

All classes, and all folds of an out-of-fold run, grow side by side: a level of all their trees is one job.
Rows lie in blocks of binned columns; a task adds the gradients of its blocks per (tree, node, feature, bin), the
partial tables of a tree meet in one task as a stream of cells of fixed size, and only chosen splits reach the driver.
Gradients are fixed-point integers, so a sum does not depend on the order of tasks and a rerun finds the same trees.

Rows without features or without a class in range take no part in a fit.  Columns that are NaN, or rows without
features, fall into the last bin when scored.  A fit without rows gives equal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.session import cut

DEFAULTS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "maxBins": 32, "reg": 1.0, "minChild": 0.5}
#: Fixed-point unit of gradients and curvatures.
UNIT = float(1 << 20)
#: Rounds after which the blocks are written anew with their margins; between, tasks add the newest trees themselves.
REFRESH = 10
#: Levels of a tree that are compared column by column.
LOOKED_AT = 4
#: Partial tables merged by one task before the last merge.
FAN_IN = 64
BLOCK = "bins binary, y binary, weight binary, margin binary"


@dataclass
class Trees:
    """Models side by side: split feature and bin per inner node, value per leaf; a node without a split sends all rows left."""
    edges: list[list[np.ndarray]]  # model, feature -> increasing borders
    base: np.ndarray  # model, class
    feature: np.ndarray  # round, model, class, inner node
    border: np.ndarray
    leaf: np.ndarray  # round, model, class, leaf


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin = number of borders below the value; NaN lies above all."""
    return np.array([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], np.uint8).T  # a column lies together


def descend(bins: np.ndarray, feature: np.ndarray, border: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row, counted inside its level, after ``levels`` splits."""
    at = np.zeros(len(bins), np.uint8)
    columns = bins.T
    for level in range(min(levels, LOOKED_AT)):  # few nodes: whole columns are compared, each row keeps its own node's answer
        first = (1 << level) - 1
        above = np.zeros(len(bins), bool)
        for node in range(first, 2 * first + 1):
            above |= (columns[feature[node]] > int(border[node])) & (at == node - first)
        at = 2 * at + above.view(np.uint8)
    at = at.astype(np.int64)
    rows = np.arange(len(bins)) if levels > LOOKED_AT else None
    for level in range(LOOKED_AT, levels):
        node = at + (1 << level) - 1
        at = 2 * at + (bins[rows, feature[node]] > border[node])
    return at


def add_trees(margin: np.ndarray, bins: np.ndarray, t: Trees, model: int, rounds: range, depth: int) -> None:
    for r in rounds:
        for k in range(margin.shape[1]):
            margin[:, k] += t.leaf[r, model, k, descend(bins, t.feature[r, model, k], t.border[r, model, k], depth)]


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def borders(rows: DataFrame, held: Sequence[int | None], dim: int, bins: int) -> list[list[np.ndarray]]:
    """Quantile borders per model and feature from the rows the model is fitted on; one aggregate."""
    probs = [i / bins for i in range(1, bins)]
    own = lambda h: F.lit(True) if h is None else F.coalesce(F.col("fold") != h, F.lit(True))
    aggs = [F.percentile_approx(F.when(own(h) & ~F.isnan(F.col("x")[j]), F.col("x")[j]), probs).alias(f"q{m}_{j}") for m, h in enumerate(held) for j in range(dim)]
    got = rows.agg(*aggs).first()  # models x features x bins numbers
    return [[np.unique(np.array(got[f"q{m}_{j}"] or [], float)) for j in range(dim)] for m in range(len(held))]


def fit(data: DataFrame, n: int, held: Sequence[int | None] = (None,), weight: str | None = None, params: dict | None = None) -> Trees:
    """One model per entry of ``held``, fitted on the rows of all other folds (None: on all rows)."""
    p = DEFAULTS | dict(params or {})
    depth, n_bins, models = p["maxDepth"], p["maxBins"], len(held)
    fold = F.col("fold") if "fold" in data.columns else F.lit(None).cast("int")
    rows = data.filter(F.col("features").isNotNull() & F.col("y").between(0, n - 1)).select(
        F.col("y").cast("int").alias("y"), fold.cast("int").alias("fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), vector_to_array("features").alias("x"))
    first = rows.first()
    shape = (p["maxIter"] if first else 0, models, n)
    t = Trees([[] for _ in held], np.zeros((models, n)), np.zeros((*shape, (1 << depth) - 1), np.int32), np.full((*shape, (1 << depth) - 1), n_bins, np.int32), np.zeros((*shape, 1 << depth)))
    if first is None:
        return t
    dim = len(first["x"])
    t.edges = borders(rows, held, dim, n_bins)
    for r in rows.groupBy("fold", "y").agg(F.sum("w").alias("w")).collect():  # folds x classes
        for m, h in enumerate(held):
            if h is None or r["fold"] != h:
                t.base[m, r["y"]] += r["w"]
    t.base = np.log((t.base + 1) / (t.base.sum(axis=1, keepdims=True) + n))

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            if len(f):
                x, own = np.array(f["x"].tolist(), float), f["fold"].to_numpy(float)
                live = np.stack([np.ones(len(f)) if h is None else own != h for h in held]) * f["w"].to_numpy(float)
                margin = np.repeat(t.base[:, None, :], len(f), axis=1)
                yield pd.DataFrame({"bins": [np.stack([to_bins(x, e) for e in t.edges]).tobytes()], "y": [f["y"].to_numpy(np.int32).tobytes()],
                                    "weight": [live.tobytes()], "margin": [margin.tobytes()]})

    def opened(f: pd.DataFrame, rounds: range) -> Iterator[tuple]:
        for b in f.itertuples(index=False):
            y = np.frombuffer(b.y, np.int32)
            bins = np.frombuffer(b.bins, np.uint8).reshape(models, len(y), dim)
            bins = np.ascontiguousarray(bins.transpose(0, 2, 1)).transpose(0, 2, 1)  # a column lies together
            margin = np.frombuffer(b.margin).reshape(models, len(y), n).copy()
            for m in range(models):
                add_trees(margin[m], bins[m], newest, m, range(len(rounds)), depth)
            yield b, y, bins, np.frombuffer(b.weight).reshape(models, len(y)), margin

    def level_tables(level: int, rounds: range):
        """Partial tables of one level: per tree one cell of (gradient, curvature) x node x feature x bin."""
        def tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = (1 << level) * dim * n_bins
            total = np.zeros((models * n, 2, size), np.int64)
            seen = False
            for f in parts:
                for _, y, bins, live, margin in opened(f, rounds):
                    seen = True
                    for m in range(models):
                        use = live[m] > 0
                        b, w, probs = bins[m].T[:, use].T, live[m][use], softmax(margin[m][use])
                        place = b.T.astype(np.int64) + np.arange(dim)[:, None] * n_bins  # feature, row
                        still = y[use]
                        for k in range(n):
                            g = np.rint((probs[:, k] - (still == k)) * w * UNIT)
                            h = np.rint(probs[:, k] * (1 - probs[:, k]) * w * UNIT)
                            cell = place
                            if level:
                                cell = place + descend(b, grown.feature[0, m, k], grown.border[0, m, k], level) * (dim * n_bins)
                            for i, v in enumerate((g, h)):
                                total[m * n + k, i] += sum(np.bincount(c, v, size) for c in cell).astype(np.int64)
            if seen:
                yield pd.DataFrame({"tree": np.arange(models * n, dtype=np.int32), "cells": [c.tobytes() for c in total]})
        return tables

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums per tree; a task keeps one table for each tree it meets."""
        total: dict[int, np.ndarray] = {}
        for f in parts:
            for tree, cells in zip(f["tree"], f["cells"]):
                v = np.frombuffer(cells, np.int64)
                total[tree] = total[tree] + v if tree in total else v
        yield pd.DataFrame({"tree": np.array(list(total), np.int32), "cells": [v.tobytes() for v in total.values()]})

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The split of most gain of every node; equal gains go to the first feature and bin."""
        for f in merge(parts):
            for tree, cells in zip(f["tree"], f["cells"]):
                g, h = np.frombuffer(cells, np.int64).reshape(2, -1, dim, n_bins) / UNIT
                gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                share = lambda a, b: a * a / (b + p["reg"])
                gain = share(gl, hl) + share(gt - gl, ht - hl) - share(gt, ht)
                gain[(hl < p["minChild"]) | (ht - hl < p["minChild"])] = 0
                gain, node = gain.reshape(len(gain), -1), np.arange(len(gain))
                best = gain.argmax(axis=1)
                some = gain[node, best] > 1e-9
                left = lambda part, whole: np.where(some, part.reshape(len(node), -1)[node, best], whole[:, 0, 0])
                value = lambda a, b: -p["stepSize"] * a / (b + p["reg"])
                lg, lh = left(gl, gt), left(hl, ht)
                yield pd.DataFrame({"tree": np.full(len(node), tree, np.int32), "node": node.astype(np.int32), "feature": np.where(some, best // n_bins, 0).astype(np.int32),
                                    "border": np.where(some, best % n_bins, n_bins).astype(np.int32), "low": value(lg, lh), "high": value(gt[:, 0, 0] - lg, ht[:, 0, 0] - lh)})

    def refreshed(rounds: range):
        def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in parts:
                for b, _, _, _, margin in opened(f, rounds):
                    yield pd.DataFrame({"bins": [b.bins], "y": [b.y], "weight": [b.weight], "margin": [margin.tobytes()]})
        return write

    state = cut(rows.mapInPandas(blocks, BLOCK))
    wide = state.rdd.getNumPartitions() > FAN_IN
    done = 0
    for r in range(p["maxIter"]):
        if r - done >= REFRESH:
            newest = Trees(t.edges, t.base, t.feature[done:r], t.border[done:r], t.leaf[done:r])
            state = cut(state.mapInPandas(refreshed(range(done, r)), BLOCK))
            done = r
        rounds = range(done, r)
        newest = Trees(t.edges, t.base, t.feature[done:r], t.border[done:r], t.leaf[done:r])
        grown = Trees(t.edges, t.base, t.feature[r:r + 1], t.border[r:r + 1], t.leaf[r:r + 1])
        for level in range(depth):
            tables = state.mapInPandas(level_tables(level, rounds), "tree int, cells binary")
            if wide:
                tables = tables.withColumn("part", F.spark_partition_id() % FAN_IN).repartition("tree", "part").drop("part").mapInPandas(merge, "tree int, cells binary")
            splits = tables.repartition("tree").mapInPandas(choose, "tree int, node int, feature int, border int, low double, high double")
            for s in splits.collect():  # one row per node of this level
                m, k = divmod(s["tree"], n)
                at = (1 << level) - 1 + s["node"]
                t.feature[r, m, k, at], t.border[r, m, k, at] = s["feature"], s["border"]
                if level == depth - 1:
                    t.leaf[r, m, k, 2 * s["node"]:2 * s["node"] + 2] = s["low"], s["high"]
    return t


def score(t: Trees, rows: DataFrame, held: Sequence[int | None] = (None,)) -> DataFrame:
    """Adds ``probs``; a row is scored by the model of its fold (None: by the one model), rows of other folds are left out."""
    models = {h: m for m, h in enumerate(held)}
    depth = int(np.log2(t.leaf.shape[-1]))
    if None not in models:
        rows = rows.filter(F.col("fold").isin(list(models)))

    @F.pandas_udf("array<double>")
    def probabilities(x: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros((len(x), t.base.shape[1]))
        for h, m in models.items():
            mine = np.ones(len(x), bool) if h is None else (fold == h).to_numpy()
            if mine.any():
                blank = [np.nan] * len(t.edges[m])
                margin = np.repeat(t.base[m][None], mine.sum(), axis=0)
                if len(t.leaf):
                    add_trees(margin, to_bins(np.array([blank if v is None else v for v in x[mine]], float), t.edges[m]), t, m, range(len(t.leaf)), depth)
                out[mine] = softmax(margin)
        return pd.Series(out.tolist())

    return rows.withColumn("probs", probabilities(F.when(F.col("features").isNotNull(), vector_to_array("features")), F.col("fold") if "fold" in rows.columns else F.lit(None).cast("int")))
