"""Nearest rows of other folds, exact, without comparing every row with every other.

Rows are dealt into cells of a k-d tree, which hold near rows together.  A query first meets the rows of its own cell;
the distance of its ``k``-th neighbour there is a bound, and it goes on only to cells whose box is not beyond it.  Inside
a cell the same is done with leaves.  So rows are shuffled twice, whatever their number, and each fold's distances, in
its own scaling, are taken from the same cells.  The tree is made from a sample, which decides the cells' sizes only.

Equal distances go to the lower id.  Rows that repeat a point are searched once, and of a point's rows no more than the
first ``k`` can be neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut

#: Rows of a cell, about.
CELL_ROWS = 32_768
#: Rows that make a cell of its own worth while where cores are idle.
LEAST_ROWS = 2_000
LEAF_ROWS = 128
#: Sampled rows per cell, and in all at least.
SAMPLED, SAMPLE = 50, 20_000
#: Numbers of a block of distances.
BLOCK = 4_000_000
#: Part of the squared norms by which a squared distance may be off when it comes from a product of matrices.
SLACK = 1e-12
UNLABELLED = -(1 << 62)


@dataclass
class Tree:
    """Inner nodes (column, border, next node at or below the border, next node above it) and leaves as rows; leaf i is node -1 - i."""
    nodes: np.ndarray
    borders: np.ndarray
    root: int
    leaves: list[np.ndarray]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        at = np.full(len(x), self.root)
        while len(live := np.flatnonzero(at >= 0)):
            column, low, high = self.nodes[at[live]].T
            at[live] = np.where(x[live, column] <= self.borders[at[live]], low, high)
        return -1 - at


def grow(x: np.ndarray, rows: int) -> Tree:
    """Halves along the column of most deviation until a leaf has at most ``rows`` rows or one point."""
    nodes, borders, leaves = [], [], []

    def build(own: np.ndarray) -> int:
        part = x[own]
        spread = part.std(0) * (part.max(0) > part.min(0)) if len(own) > rows else np.zeros(1)
        if not spread.max() > 0:
            leaves.append(own)
            return -len(leaves)
        column = int(spread.argmax())
        v = part[:, column]
        border = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        if border == v.max():
            border = v[v < border].max()
        at = len(nodes)
        nodes.append([column, 0, 0])
        borders.append(border)
        nodes[at][1:] = build(own[v <= border]), build(own[v > border])
        return at

    root = build(np.arange(len(x)))
    return Tree(np.array(nodes, int).reshape(-1, 3), np.array(borders, float), root, leaves)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        beside = np.maximum(np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]), 0.0)
        out += beside * beside
    return out


def search(q: np.ndarray, reach: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows per query no farther than ``reach``; by query, distance and id."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if not len(q) or not len(x):
        return none
    leaves = grow(x, LEAF_ROWS).leaves
    low, high = (np.stack([f(x[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    norms, peak = (x * x).sum(1), np.array([(x[own] ** 2).sum(1).max() for own in leaves])
    parts = [none]
    step = max(1, BLOCK // max(len(leaves), LEAF_ROWS))
    for start in range(0, len(q), step):
        a = q[start:start + step]
        size, far = (a * a).sum(1), reach[start:start + step] ** 2
        best = np.full((len(a), k), np.inf)
        box = box_distances(a, low, high)
        home = box.argmin(1)
        pairs = []

        def visit(sel: np.ndarray, leaf: int) -> None:
            own = leaves[leaf]
            for at in range(0, len(sel), max(1, BLOCK // len(own))):
                s = sel[at:at + max(1, BLOCK // len(own))]
                d = size[s, None] + norms[own] - 2 * (a[s] @ x[own].T)
                both = np.concatenate([best[s], d], axis=1)
                best[s] = np.partition(both, k - 1, axis=1)[:, :k]
                far[s] = np.minimum(far[s], np.maximum(best[s].max(1), 0.0))
                i, j = np.nonzero(d <= (far[s] + SLACK * (size[s] + peak[leaf]))[:, None])
                pairs.append((s[i], own[j]))

        open_ = lambda leaf: box[:, leaf] <= far + SLACK * (size + peak[leaf])
        for leaf in np.unique(home):
            visit(np.flatnonzero((home == leaf) & open_(leaf)), leaf)
        for leaf in range(len(leaves)):
            visit(np.flatnonzero((home != leaf) & open_(leaf)), leaf)
        i, j = (np.concatenate(c) for c in zip(*pairs)) if pairs else none[:2]
        d = np.concatenate([none[2], *[np.sqrt(((a[i[at:at + BLOCK // 8]] - x[j[at:at + BLOCK // 8]]) ** 2).sum(-1)) for at in range(0, len(i), BLOCK // 8)]])
        use = d <= reach[start:start + step][i]
        i, j, d = i[use], j[use], d[use]
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        parts.append((i[first] + start, j[first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each different point, and the number of the point of each row."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number.ravel()


def firsts(number: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of lowest id of each point."""
    order = np.lexsort((ids, number))
    n = number[order]
    return order[np.arange(len(n)) - np.searchsorted(n, n) < k]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1) if len(whole) else np.zeros((0, 1))


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One list per owner; ``owner`` does not decrease."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def other_folds(data: DataFrame, scales: dict[int, tuple[np.ndarray, np.ndarray]], k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of other folds for every row of the folds in ``scales``: row_id, y, fold, near (dist, id, y in order).

    ``data`` has row_id, y, fold, features; ``scales`` gives each fold the means and factors of its columns.  Rows without
    a class are answered but are no neighbours; a row that no other fold can answer is left out.
    """
    spark = data.sparkSession
    rows = data.filter(F.col("fold").isNotNull()).select(
        F.col("row_id").cast("long").alias("row_id"), F.coalesce(F.col("y").cast("long"), F.lit(UNLABELLED)).alias("y"), F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"))
    total = rows.count()
    cells = max(-(-total // CELL_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)), 1)
    every = max(1, total // max(SAMPLE, SAMPLED * cells))
    found = rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0).select("x").toPandas()["x"] if total else []
    sample = np.vstack([np.asarray(v, float) for v in found]) if len(found) else np.zeros((0, 1))
    deviation = sample.std(0) if len(sample) else np.ones(1)
    units = np.where(deviation > 0, deviation, 1.0)
    tree = grow(sample / units, -(-len(sample) // cells)) if len(sample) else Tree(np.zeros((0, 3), int), np.zeros(0), -1, [])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(tree.place(matrix(b.column("x")) / units).astype(np.int32)))

    held = rows.mapInArrow(placed, "row_id long, y long, fold int, x array<double>, cell int")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x, cell = matrix(b.column("x")), b.column("cell").to_numpy()
            x, cell = (v[b.column("y").to_numpy() != UNLABELLED] for v in (x, cell))
            for c in np.unique(cell):
                low, high = x[cell == c].min(0), x[cell == c].max(0)
                seen[c] = (np.minimum(low, seen[c][0]), np.maximum(high, seen[c][1])) if c in seen else (low, high)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *[pa.array([v[i].tolist() for v in seen.values()]) for i in (0, 1)]], names=["cell", "low", "high"])

    dim = sample.shape[1]
    ends = held.mapInArrow(boxes, "cell int, low array<double>, high array<double>").groupBy("cell").agg(
        F.array(*[F.min(F.get("low", F.lit(j))) for j in range(dim)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(j))) for j in range(dim)]).alias("high")).collect()  # one row per cell
    cell_no = np.array([r["cell"] for r in ends], int)
    lows, highs = (np.array([r[c] for r in ends], float).reshape(len(ends), -1) for c in ("low", "high"))

    def trained(fold: int, t: dict) -> tuple[np.ndarray, ...]:
        """Rows that can be neighbours for a fold: scaled, their ids and classes."""
        use = np.flatnonzero((t["fold"] != fold) & (t["y"] != UNLABELLED))
        use = use[firsts(t["point"][use], t["row_id"][use], k)]
        mean, factor = scales[fold]
        return (t["x"][use] - mean) * factor, t["row_id"][use], t["y"][use]

    def opened(table: pa.Table) -> dict:
        t = {c: table.column(c).to_numpy() for c in ("row_id", "y", "fold")} | {"x": matrix(table.column("x"))}
        return t | {"point": points(t["x"])[1]}

    near = pa.struct([("dist", pa.float64()), ("id", pa.int64()), ("y", pa.int64())])

    def answers(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray, y: np.ndarray, n: int) -> pa.Array:
        flat = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[j]), pa.array(y[j])], fields=list(near))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(n + 1)).astype(np.int32)), flat)

    def at_home(table: pa.Table) -> pa.Table:
        t, out = opened(table), []
        cell = table.column("cell")[0].as_py()
        for fold in np.unique(t["fold"]):
            if int(fold) not in scales:
                continue
            mine = np.flatnonzero(t["fold"] == fold)
            first, number = points(t["x"][mine])
            order = np.lexsort((t["row_id"][mine], number))
            mean, factor = scales[fold]
            q = (t["x"][mine][first] - mean) * factor
            x, ids, y = trained(fold, t)
            i, j, d = search(q, np.full(len(q), np.inf), x, ids, k)
            count = np.bincount(i, minlength=len(q))
            last = np.full(len(q), np.inf)
            full = np.flatnonzero(count == k)
            last[full] = d[np.cumsum(count)[full] - 1]
            goes = []
            step = max(1, BLOCK // max(len(ends), 1))
            low, high = (lows - mean) * factor, (highs - mean) * factor
            size = np.maximum(low * low, high * high).sum(1)
            for at in range(0, len(q), step):
                a = q[at:at + step]
                slack = SLACK * ((a * a).sum(1)[:, None] + size)
                goes.append((box_distances(a, low, high) <= last[at:at + step, None] ** 2 + slack) & (cell_no != cell))
            goes = np.concatenate(goes)
            to, target = np.nonzero(goes)
            sent = np.unique(to)
            members = mine[order]
            out.append(pa.table([
                pa.array(t["row_id"][members[np.searchsorted(number[order], np.arange(len(first)))]]), pa.array(np.full(len(q), fold, np.int32)),
                lists(t["row_id"][members], number[order], len(q)), lists(t["y"][members], number[order], len(q)), answers(i, j, d, ids, y, len(q)),
                lists(t["x"][mine][first][sent].ravel(), np.repeat(sent, dim), len(q)), pa.array(last), lists(cell_no[target].astype(np.int32), to, len(q)),
            ], names=ASKED))
        return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in EMPTY], names=ASKED)

    ASKED = ["query", "fold", "rows", "classes", "near", "x", "reach", "cells"]
    EMPTY = pa.schema([("query", pa.int64()), ("fold", pa.int32()), ("rows", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())), ("near", pa.list_(near)),
                       ("x", pa.list_(pa.float64())), ("reach", pa.float64()), ("cells", pa.list_(pa.int32()))])
    found = cut(held.groupBy("cell").applyInArrow(at_home, "query long, fold int, rows array<long>, classes array<long>, near array<struct<dist double, id long, y long>>, x array<double>, reach double, cells array<int>"))

    def beyond(asks: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and table.num_rows:
            t, q, fold, reach, query = opened(table), matrix(asks.column("x")), *(asks.column(c).to_numpy() for c in ("fold", "reach", "query"))
            for f in np.unique(fold):
                own = np.flatnonzero(fold == f)
                mean, factor = scales[f]
                x, ids, y = trained(f, t)
                i, j, d = search((q[own] - mean) * factor, reach[own], x, ids, k)
                some = np.unique(i)
                out.append(pa.table([pa.array(query[own][some]), pa.array(np.full(len(some), f, np.int32)), answers(np.searchsorted(some, i), j, d, ids, y, len(some))], names=["query", "fold", "more"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(near))], names=["query", "fold", "more"])

    asks = found.filter(F.size("cells") > 0).select(F.explode("cells").alias("cell"), "query", "fold", "x", "reach")
    more = asks.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(beyond, "query long, fold int, more array<struct<dist double, id long, y long>>")
    more = more.groupBy("query", "fold").agg(F.flatten(F.collect_list("more")).alias("more"))  # k rows of each cell that was asked
    kept = ["query", "fold", "rows", "classes", "near"]
    asking = found.filter(F.size("cells") > 0).select(*kept).join(more, ["query", "fold"], "left")
    asking = asking.withColumn("near", F.slice(F.array_sort(F.concat("near", F.coalesce("more", F.array().cast("array<struct<dist:double,id:bigint,y:bigint>>")))), 1, k))
    whole = found.filter(F.size("cells") == 0).select(*kept).unionByName(asking.select(*kept)).filter(F.size("near") > 0)
    each = whole.select("fold", "near", F.explode(F.arrays_zip(F.col("rows").alias("row_id"), F.col("classes").alias("y"))).alias("r"))
    return each.select("r.row_id", F.when(F.col("r.y") != UNLABELLED, F.col("r.y")).cast("int").alias("y"), "fold", "near")


def shares(near: str, n: int) -> Column:
    """Share of each class among the neighbours."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.size(F.filter(near, lambda r: r["y"] == c)) / F.size(near))
