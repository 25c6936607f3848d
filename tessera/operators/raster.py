"""Long-form rasters ``(image_id, y, x, ...)``: box ink, box refit, local maxima, difference blobs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.operators.boxes import GEO, IMAGE_ROWS
from tessera.operators.ordered import crowded
from tessera.session import cut, recut

tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))


#: Pixel rows of a band in images with many boxes.
BAND = 8


def _measured(boxes: DataFrame, raster: DataFrame, limits: tuple[Column, Column, Column, Column], aggs: Sequence[Column]) -> DataFrame:
    """Boxes with aggregates over the pixels inside ``limits`` (x from, y from, x to, y to); a box without pixels stays.

    Pixels stream past the boxes of their image, which are the side that is held: pixels are neither sorted nor broadcast,
    as the optimiser does not know how many an explode makes.  Images with many boxes meet their pixels by bands of rows.
    """
    names = ["__x0", "__y0", "__x1", "__y1"]
    lim = boxes.withColumns(dict(zip(names, limits)))
    px = raster.withColumnRenamed("image_id", "__image")
    x0, y0, x1, y1 = (F.col(n) for n in names)
    near = (F.col("__image") == F.col("image_id")) & (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    collect = lambda j: j.groupBy(*boxes.columns).agg(*aggs)

    def small(b: DataFrame, p: DataFrame) -> DataFrame:
        return collect(p.join(b.hint("shuffle_hash"), near, "right"))

    def large(b: DataFrame, p: DataFrame) -> DataFrame:
        b = b.withColumn("__band", F.explode_outer(F.sequence(F.floor(y0 / BAND), F.floor((y1 - 1) / BAND))))
        return collect(p.withColumn("__own", F.floor(F.col("y") / BAND)).join(b.hint("shuffle_hash"), near & (F.col("__own") == F.col("__band")), "right"))

    many = crowded(boxes, ["image_id"], IMAGE_ROWS)
    if many is None:
        return small(lim, px)
    its = many.withColumnRenamed("image_id", "__image")
    return (small(lim.join(many, "image_id", "left_anti"), px.join(its, "__image", "left_anti"))
            .unionByName(large(lim.join(many, "image_id", "left_semi"), px.join(its, "__image", "left_semi"))))


def whole(c: str) -> Column:
    return F.col(c).cast("int")


def _inked(boxes: DataFrame, raster: DataFrame) -> DataFrame:
    limits = F.greatest(whole("x1"), F.lit(0)), F.greatest(whole("y1"), F.lit(0)), whole("x2"), whole("y2")
    ink = _measured(boxes, raster, limits, [F.count("y").alias("__n"), F.avg("t_ink").alias("t_mean"), F.avg("p_ink").alias("p_mean")])
    return ink.filter("__n > 0").drop("__n")


def box_ink(boxes: DataFrame, raster: DataFrame) -> DataFrame:
    """Mean ink of both sides inside each box; boxes without pixels are left out."""
    return _inked(boxes, raster).select("image_id", "box_id", "t_mean", "p_mean")


def polarity_filter(boxes: DataFrame, raster: DataFrame, limit: float = 3.0) -> DataFrame:
    """Drop deletions (template inked, photo blank) and empty boxes."""
    return _inked(boxes, raster).filter(~((F.col("t_mean") > limit) & (F.col("p_mean") < limit)))


def polarity_counts(ink: DataFrame, limit: float = 3.0) -> DataFrame:
    t, p = F.col("t_mean"), F.col("p_mean")
    return ink.agg(F.count(F.lit(1)).alias("boxes"), tally((t < limit) & (p > limit)).alias("additions"), tally((p < limit) & (t > limit)).alias("deletions"),
                   tally((t >= limit) & (p >= limit)).alias("modifications"), F.avg(F.when(p > t, 1.0).otherwise(0.0)).alias("more_ink_share"))


def snap_to_ink(boxes: DataFrame, raster: DataFrame, w: int, h: int, pad: int = 6, limit: float = 25.0,
                margin: tuple[int, int, int, int] = (0, 0, 1, 1), max_shift: float = 6.0) -> DataFrame:
    """Refit each box to the differing pixels near it, when that moves no side by more than ``max_shift``."""
    lo = lambda c: F.greatest(F.col(c) - pad, F.lit(0.0)).cast("int")
    hi = lambda c, n: F.least(F.col(c) + pad, F.lit(float(n))).cast("int")
    diff = raster.filter(F.abs(F.col("p_ink") - F.col("t_ink")) > limit).select("image_id", "y", "x")
    j = _measured(boxes, diff, (lo("x1"), lo("y1"), hi("x2", w), hi("y2", h)), [
        F.count("y").alias("n"), (F.min("x") - margin[0]).alias("n_x1"), (F.min("y") - margin[1]).alias("n_y1"),
        (F.max("x") + 1 + margin[2]).alias("n_x2"), (F.max("y") + 1 + margin[3]).alias("n_y2")])
    shift = F.greatest(*[F.abs(F.col(f"n_{c}") - F.col(c)) for c in GEO])
    ok = (F.col("n") >= 3) & (shift <= max_shift)
    return j.select("image_id", "box_id", *[F.when(ok, F.col(f"n_{c}").cast("double")).otherwise(F.col(c)).alias(c) for c in GEO], ok.alias("snapped"))


#: Side of a tile.
TILE = 32


def tiles(raster: DataFrame, halo: int, side: int = TILE) -> DataFrame:
    """Pixel rows as tiles (image_id, ty, tx, pixels); a tile also holds the ``halo`` pixels around its square.

    A tile has at most (side + 2 * halo) squared pixels, whatever the image's size.  A frame that has ``pixels`` is taken as it is.
    """
    if "pixels" in raster.columns:
        return raster
    px = raster
    for c in "yx":
        px = px.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))))
    held = px.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct(*[c for c in raster.columns if c != "image_id"])).alias("pixels"))
    # tiles that only a halo reaches have no pixel of their own
    return held.filter(F.exists("pixels", lambda p: (F.floor(p["y"] / side) == F.col("ty")) & (F.floor(p["x"] / side) == F.col("tx"))))


def _laid(batch: pa.RecordBatch, halo: int, side: int):
    """Pixels of a batch with their tile's number and their place in it, and the extent of the places."""
    cells = batch.column("pixels")
    t = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
    px = cells.flatten()
    corner = lambda c: batch.column(f"t{c}").to_numpy()[t] * side - halo
    y, x = (px.field(i).to_numpy(zero_copy_only=False) - corner(c) for i, c in ((px.type.get_field_index("y"), "y"), (px.type.get_field_index("x"), "x")))
    return t, px, y, x, (batch.num_rows, int(y.max()) + 1, int(x.max()) + 1)


def _around(grid: np.ndarray, pick, fill) -> np.ndarray:
    """``pick`` over the 3x3 neighbourhood of every place."""
    g = np.pad(grid, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    g = pick(pick(g[:, :-2], g[:, 1:-1]), g[:, 2:])
    return pick(pick(g[:, :, :-2], g[:, :, 1:-1]), g[:, :, 2:])


def _peaks(grid: DataFrame, side: int) -> DataFrame:
    """Pixels whose score no neighbour exceeds."""
    fields = grid.schema["pixels"].dataType.elementType.fields
    schema = T.StructType([grid.schema["image_id"], *fields])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t, px, y, x, shape = _laid(batch, 1, side)
            score = px.field(px.type.get_field_index("score"))
            known = score.is_valid().to_numpy(zero_copy_only=False)
            v = score.to_numpy(zero_copy_only=False).astype(float)
            v = np.where(known, np.where(np.isnan(v), np.inf, v), -np.inf)
            dense = np.full(shape, -np.inf)
            dense[t, y, x] = v
            top = _around(dense, np.maximum, -np.inf)[t, y, x]
            at = np.flatnonzero(known & (v == top) & (y >= 1) & (y <= side) & (x >= 1) & (x <= side))
            kept = px.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(t[at])), *kept.flatten()], names=["image_id", *[f.name for f in fields]])

    return grid.select("image_id", "ty", "tx", "pixels").mapInArrow(run, schema)


def heatmap_boxes(grid: DataFrame, top: int = 64, min_score: float = 0.05, stride: int = 4, side: int = TILE) -> DataFrame:
    """Local maxima of a score grid as boxes: the best cells per image, ties by position.

    Maxima are found tile by tile; only they are ranked.
    """
    peaks = _peaks(tiles(grid, 1, side), side).filter(F.col("score") >= min_score)
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "y", "x")
    best = peaks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    cx, cy = F.col("x") * float(stride), F.col("y") * float(stride)
    bw, bh = F.greatest(F.col("w"), F.lit(1.0)), F.greatest(F.col("h"), F.lit(1.0))
    return best.select("image_id", "rank", "score", (cx - bw / 2).alias("x1"), (cy - bh / 2).alias("y1"), (cx + bw / 2).alias("x2"), (cy + bh / 2).alias("y2"))


#: Pixels around a tile that its closed mask and the row beyond it depend on.
CLOSING = 3


def closed_tiles(raster: DataFrame, limit: float = 25.0, side: int = TILE) -> DataFrame:
    """Components of the difference mask after a 3x3 closing (grow, then shrink), tile by tile.

    Kind 0 is a component (``ry``, ``rx``: its first pixel) with its extent and area.  Where one goes on in another tile,
    kind 1 lists its own pixels at the tile's edge and kind 2 the pixels that it touches beyond.
    """
    own = ["image_id", "ry", "rx", "kind", "y", "x", "x1", "y1", "x2", "y2", "area"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t, px, y, x, shape = _laid(batch, CLOSING, side)
            m = np.full(shape, -1, np.int8)
            t_ink, p_ink = (px.field(px.type.get_field_index(c)) for c in ("t_ink", "p_ink"))
            known = t_ink.is_valid().to_numpy(zero_copy_only=False) & p_ink.is_valid().to_numpy(zero_copy_only=False)
            apart = np.abs(p_ink.to_numpy(zero_copy_only=False) - t_ink.to_numpy(zero_copy_only=False))
            m[t, y, x] = known & ~(apart <= limit)
            there = m >= 0
            closed = there & (_around(np.where(there, _around(m, np.maximum, -1), 2), np.minimum, 2) == 1)
            lo, hi = CLOSING, CLOSING + side
            core = np.zeros(shape[1:], bool)
            core[lo:hi, lo:hi] = True
            ring = np.zeros(shape[1:], bool)
            ring[lo - 1:hi + 1, lo - 1:hi + 1] = True
            inner, outer = closed & core, closed & ring & ~core
            size = shape[1] * shape[2]
            label = np.where(inner, np.arange(size, dtype=np.int32).reshape(shape[1:]), size)
            while True:
                low = np.where(inner, _around(label, np.minimum, size), size)
                if (low == label).all():
                    break
                label = low
            ti, yi, xi = np.nonzero(inner)
            if not len(ti):
                continue
            key = ti * size + label[ti, yi, xi]
            order = np.argsort(key, kind="stable")
            key, ti, yi, xi = key[order], ti[order], yi[order], xi[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            img = batch.column("image_id").to_numpy()
            top, left = (batch.column(f"t{c}").to_numpy() * side - CLOSING for c in "yx")
            gy, gx = yi + top[ti], xi + left[ti]
            k, kt = key[start], ti[start]
            root = lambda keys, tt: (keys % size // shape[2] + top[tt], keys % size % shape[2] + left[tt])
            zero = np.zeros(len(start), np.int64)
            out = [(img[kt], *root(k, kt), zero, zero, zero, np.minimum.reduceat(gx, start), np.minimum.reduceat(gy, start),
                    np.maximum.reduceat(gx, start) + 1, np.maximum.reduceat(gy, start) + 1, np.diff(np.r_[start, len(key)]))]
            if outer.any():
                beyond = np.pad(outer, ((0, 0), (1, 1), (1, 1)))
                hits = [(key[h], ti[h], (gy + dy)[h], (gx + dx)[h]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for h in [beyond[ti, yi + 1 + dy, xi + 1 + dx]]]
                refs = [np.concatenate(c) for c in zip(*hits)]
                edge = np.isin(key, refs[0]) & ((yi == lo) | (yi == hi - 1) | (xi == lo) | (xi == hi - 1))
                for kind, (kk, tt, yy, xx) in ((1, (key[edge], ti[edge], gy[edge], gx[edge])), (2, refs)):
                    z = np.zeros(len(kk), np.int64)
                    out.append((img[tt], *root(kk, tt), z + kind, yy, xx, z, z, z, z, z))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=own)

    held = raster if "pixels" in raster.columns else raster.select("image_id", "y", "x", "t_ink", "p_ink")
    held = tiles(held, CLOSING, side).select(F.col("image_id").cast("bigint"), "ty", "tx", "pixels")
    return held.mapInArrow(run, ", ".join(f"{c} long" for c in own))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``nodes`` (node), ``edges`` (a, b) -> (node, label = smallest node).

    In a round a node takes the smallest label among its neighbours and hands it on to the node its own label names, so
    whole regions merge at once; then labels jump to the label of their label.  So the rounds grow with the logarithm of
    the longest chain, in whatever order its ids lie.  Every round is cut from its lineage and from the planner's size
    estimate.  All sides grow with the rows, so none is broadcast.
    """
    both = recut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = recut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near.hint("merge"), labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("m"))
        told = F.explode(F.array(F.struct("node", "old", "m"), F.struct(F.col("old").alias("node"), F.lit(None).alias("old"), "m"))).alias("t")
        low = recut(low.select(told).groupBy("t.node").agg(F.min("t.m").alias("label"), F.min("t.old").alias("old")))
        up = low.select(F.col("node").alias("p"), F.col("label").alias("pl"))
        nxt = recut(low.join(up.hint("merge"), F.col("label") == F.col("p"), "left").select("node", F.least("label", "pl").alias("label"), "old"))
        moved = nxt.filter("label <> old").limit(1).count()
        labels = nxt.select("node", "label")
        if not moved:
            return labels


def difference_blobs(raster: DataFrame, min_area: int = 12, limit: float = 25.0, side: int = TILE) -> DataFrame:
    """Eight-neighbour components of the closed difference mask as boxes with an area score.

    A component inside one tile is complete there; only those that go on in another tile are joined as a graph.
    """
    parts = cut(closed_tiles(raster, limit, side).withColumn("node", F.struct("image_id", "ry", "rx")).drop("ry", "rx"))
    whole = parts.filter("kind = 0").select("image_id", "node", "x1", "y1", "x2", "y2", "area")
    if not parts.filter("kind > 0").isEmpty():
        owned = parts.filter("kind = 1").select("image_id", "y", "x", F.col("node").alias("a"))
        edges = owned.join(parts.filter("kind = 2").select("image_id", "y", "x", F.col("node").alias("b")), ["image_id", "y", "x"])
        labels = connected(owned.select(F.col("a").alias("node")).distinct(), edges.select("a", "b"))
        named = whole.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
        whole = named.groupBy("image_id", "node").agg(*[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")], F.sum("area").alias("area"))
    return whole.filter(F.col("area") >= min_area).select("image_id", "x1", "y1", "x2", "y2", "area", F.least(F.lit(1.0), F.col("area") / 200.0).alias("score"))
