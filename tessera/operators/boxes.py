"""Boxes: overlap joins, one-to-one matching, scores, geometry, fusion.

Boxes are ``(image_id, id, x1, y1, x2, y2)``.  Joins between box sets never pair a whole image: both
sides are spread over grid cells, identical boxes are collapsed to one geometry first, and a pair is
emitted only in the cell that holds the top-left corner of its intersection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.draws import hash_text, unit

from tessera.operators.ordered import crowded, ordinal
from tessera.session import cut

GEO = ["x1", "y1", "x2", "y2"]
#: Boxes of one side up to which an image is paired as one group; images with more go over grid cells and rounds.
IMAGE_ROWS = 256
n_rows = lambda name="n": F.count(F.lit(1)).alias(name)
tally = lambda cond: F.sum(F.when(cond, 1).otherwise(0))


# ---- overlap join ----------------------------------------------------------------------------

def _cells(df: DataFrame, cell: float) -> DataFrame:
    """One row per grid cell a box reaches into."""
    idx = lambda c: F.floor(F.col(c) / cell)
    return (df.withColumn("cx", F.explode(F.sequence(idx("x1"), F.greatest(idx("x1"), idx("x2")))))
            .withColumn("cy", F.explode(F.sequence(idx("y1"), F.greatest(idx("y1"), idx("y2"))))))


def overlap(px: dict[str, Column], gx: dict[str, Column]) -> Column:
    w = F.least(px["x2"], gx["x2"]) - F.greatest(px["x1"], gx["x1"])
    h = F.least(px["y2"], gx["y2"]) - F.greatest(px["y1"], gx["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou_value(px: dict[str, Column], gx: dict[str, Column]) -> Column:
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    inter = overlap(px, gx)
    union = area(px) + area(gx) - inter
    return F.when(union > 0, inter / F.greatest(union, F.lit(1e-9))).otherwise(0.0)


def geometry_pairs(a: DataFrame, b: DataFrame, cell: float = 64.0) -> DataFrame:
    """Intersecting pairs of distinct geometries with their IoU; columns of b carry the prefix ``g_``."""
    left = _cells(a.select("image_id", *GEO).distinct(), cell)
    right = b.select("image_id", *[F.col(c).alias(f"g_{c}") for c in GEO]).distinct()
    right = _cells(right.select("image_id", *[F.col(f"g_{c}").alias(c) for c in GEO]), cell).select(
        "image_id", "cx", "cy", *[F.col(c).alias(f"g_{c}") for c in GEO])
    j = left.join(right, ["image_id", "cx", "cy"])
    px, gx = {c: F.col(c) for c in GEO}, {c: F.col(f"g_{c}") for c in GEO}
    home = ((F.floor(F.greatest("x1", "g_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("y1", "g_y1") / cell) == F.col("cy")))
    return j.filter(home & (overlap(px, gx) > 0)).select("image_id", *GEO, *[f"g_{c}" for c in GEO], iou_value(px, gx).alias("iou"))


def by_image_size(pred: DataFrame, gt: DataFrame, small: Callable, large: Callable) -> DataFrame:
    """``small(pred, gt)`` over images with at most ``IMAGE_ROWS`` boxes a side, ``large(pred, gt)`` over the others.

    Most images are small: all their steps share one exchange by image, and nothing is written between them.
    """
    sides = [crowded(d.select("image_id"), ["image_id"], IMAGE_ROWS) for d in (pred, gt)]
    sides = [m for m in sides if m is not None]
    if not sides:
        return small(pred, gt)
    many = reduce(lambda a, b: a.union(b), sides).distinct()
    part = lambda how: [d.join(many, "image_id", how) for d in (pred, gt)]
    return small(*part("left_anti")).unionByName(large(*part("left_semi")))


def _partners(df: DataFrame, other: DataFrame, *names: str) -> DataFrame:
    """Rows of ``df`` with ``__near``: the boxes of ``other`` in the same image that intersect it, as (names, iou)."""
    held = other.groupBy("image_id").agg(F.collect_list(F.struct(*GEO, *names)).alias("__near"))
    own = {c: F.col(c) for c in GEO}
    meets = F.filter("__near", lambda g: overlap(own, g) > 0)
    return df.join(held, "image_id", "left").withColumn("__near", F.transform(meets, lambda g: F.struct(iou_value(own, g).alias("iou"), *[g[n].alias(n) for n in names])))


def iou_join(pred: DataFrame, gt: DataFrame, cell: float = 64.0) -> DataFrame:
    """Every intersecting (candidate, truth) pair of an image with its IoU."""
    return by_image_size(pred, gt, _iou_join_small, lambda p, g: _iou_join_cells(p, g, cell))


def _iou_join_small(pred: DataFrame, gt: DataFrame) -> DataFrame:
    g = gt.select("image_id", "box_id", *[F.col(c).alias(f"g_{c}") for c in GEO])
    px, gx = {c: F.col(c) for c in GEO}, {c: F.col(f"g_{c}") for c in GEO}
    pairs = pred.select("image_id", "cand_id", "score", *GEO).join(g, "image_id").filter(overlap(px, gx) > 0)
    return pairs.select("image_id", "cand_id", "box_id", "score", iou_value(px, gx).alias("iou"))


def _iou_join_cells(pred: DataFrame, gt: DataFrame, cell: float) -> DataFrame:
    pairs = geometry_pairs(pred, gt, cell)
    g = gt.select("image_id", "box_id", *[F.col(c).alias(f"g_{c}") for c in GEO])
    p = pred.select("image_id", "cand_id", "score", *GEO)
    return p.join(pairs, ["image_id", *GEO]).join(g, ["image_id", *[f"g_{c}" for c in GEO]]).select("image_id", "cand_id", "box_id", "score", "iou")


# ---- matching --------------------------------------------------------------------------------

def truth_classes(gt: DataFrame) -> DataFrame:
    """Identical truth boxes as one class with a capacity; it is named by its lowest box id."""
    return gt.groupBy("image_id", *[F.col(c).alias(f"g_{c}") for c in GEO]).agg(F.min("box_id").alias("cls"), n_rows("cap"))


def greedy_match(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Score-ordered one-to-one matching: candidates in score order take the best free truth box.

    Images with few boxes are visited in this order, one array per image.  In the others it runs as a stable matching in
    which every truth box prefers the higher score (``_match_rounds``).  Ties: equal scores by lower candidate id, equal
    IoU by lower truth id (in rounds: by the lowest id of the identical boxes).  ``keys`` are extra columns of ``pred``
    that separate independent runs.
    """
    found = lambda p, g: (_visited(p, g, threshold, keys).filter(F.col("__hit").isNotNull())
                          .select(*keys, "image_id", "cand_id", F.col("__hit.box_id").alias("box_id"), F.col("__hit.iou").alias("iou")))
    return by_image_size(pred, gt, found, lambda p, g: _match_rounds(p, g, threshold, keys))


def _visited(pred: DataFrame, gt: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """Candidates with ``__hit`` (iou, box_id) or null; needs images that fit an array."""
    low = lambda e: F.struct(e["iou"].alias("iou"), (-e["box_id"]).alias("low"), e["box_id"].alias("box_id"))
    edges = F.transform(F.filter("__near", lambda e: e["iou"] >= threshold), low)
    cand = F.struct(F.col("score").alias("by"), (-F.col("cand_id")).alias("low"), edges.alias("edges"), F.struct(*pred.columns).alias("row"))
    line = _partners(pred, gt, "box_id").groupBy(*keys, "image_id").agg(F.sort_array(F.collect_list(cand), asc=False).alias("line"))
    none = F.array().cast(f"array<struct<iou:double,low:bigint,box_id:{gt.schema['box_id'].dataType.simpleString()}>>")

    def visit(hits: Column, c: Column) -> Column:
        free = F.filter(c["edges"], lambda e: ~F.coalesce(F.array_contains(hits["box_id"], e["box_id"]), F.lit(False)))
        return F.concat(hits, F.array(F.array_max(free)))

    hits = line.select(F.col("line.row").alias("row"), F.aggregate("line", none, visit).alias("hit"))
    return hits.select(F.explode(F.arrays_zip("row", "hit")).alias("v")).select("v.row.*", F.col("v.hit").alias("__hit"))


def _match_rounds(pred: DataFrame, gt: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """The matching in parallel rounds: each candidate proposes to its best remaining truth, a truth keeps the highest
    scores it has room for, and every pair below that bar is dropped for good.

    The rounds end when nothing is dropped; no image is ever gathered in one task.
    """
    keys = list(keys)
    pairs = geometry_pairs(pred, gt).filter(F.col("iou") >= threshold)
    cls = truth_classes(gt)
    p = pred.select(*keys, "image_id", "cand_id", "score", *GEO)
    edges = cut(p.join(pairs, ["image_id", *GEO]).join(cls, ["image_id", *[f"g_{c}" for c in GEO]])
                .select(*keys, "image_id", "cand_id", "score", "cls", "cap", "iou"))
    node, group = keys + ["image_id", "cand_id"], keys + ["image_id", "cls"]
    alive = edges.count()
    while True:
        best = edges.groupBy(*node).agg(F.max_by(F.struct("cls", "cap", "iou", "score"), F.struct("iou", -F.col("cls"))).alias("b")).select(*node, "b.*")
        ranked = best.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "cand_id")))
        bar = ranked.filter(F.col("r") == F.col("cap")).select(*group, F.col("score").alias("bar"), F.col("cand_id").alias("bar_id"))
        above = F.col("bar").isNull() | (F.col("score") > F.col("bar")) | ((F.col("score") == F.col("bar")) & (F.col("cand_id") <= F.col("bar_id")))
        nxt = cut(edges.join(bar, group, "left").filter(above).drop("bar", "bar_id"))
        left = nxt.count()
        if left == alive:
            return best.select(*node, F.col("cls").alias("box_id"), "iou")
        edges, alive = nxt, left


def flag_matches(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates with ``tp``."""
    def rounds(p: DataFrame, g: DataFrame) -> DataFrame:
        hit = _match_rounds(p, g, threshold, keys).select(*keys, "image_id", "cand_id", F.lit(True).alias("tp"))
        return p.join(hit, [*keys, "image_id", "cand_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))

    return by_image_size(pred, gt, lambda p, g: _visited(p, g, threshold, keys).withColumn("tp", F.col("__hit").isNotNull()).drop("__hit"), rounds)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = tp / F.greatest(tp + fp, F.lit(1))
    r = tp / F.greatest(tp + fn, F.lit(1))
    return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def image_counts(flagged: DataFrame, gt: DataFrame) -> DataFrame:
    """TP, FP and FN per image over the union of images of both sides."""
    a = flagged.groupBy("image_id").agg(tally(F.col("tp")).alias("tp"), tally(~F.col("tp")).alias("fp"))
    g = gt.groupBy("image_id").agg(n_rows("n_gt"))
    j = a.join(g, "image_id", "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select("image_id", z("tp").alias("tp"), z("fp").alias("fp"), (z("n_gt") - z("tp")).alias("fn"))


def global_f1(flagged: DataFrame, gt: DataFrame) -> DataFrame:
    c = image_counts(flagged, gt).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def threshold_grid(lo: float = 0.05, hi: float = 0.95, step: float = 0.01) -> list[float]:
    return [float(x) for x in np.arange(lo, hi, step)]


def sweep(flagged: DataFrame, truth_counts: DataFrame, keys: Sequence[str] = (), grid: Sequence[float] | None = None) -> DataFrame:
    """Precision, recall and F1 at every threshold.

    A later candidate never changes an earlier match, so the matches at a threshold are the matches of
    the full run with a score at or above it: candidates fall into one bin per threshold and bins add up.
    ``truth_counts`` holds (keys, n_gt).
    """
    keys, grid = list(keys), list(grid or threshold_grid())
    arr = F.array(*[F.lit(g) for g in grid])
    by_score = flagged.groupBy(*keys, "score").agg(tally(F.col("tp")).alias("tp"), n_rows("n"))
    bins = (by_score.withColumn("b", F.size(F.filter(arr, lambda g: g <= F.col("score")))).groupBy(*keys, "b")
            .agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")))
    # a generator makes every threshold present; at most one row per bin and key after it
    empty = truth_counts.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("b"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"))
    dense = bins.unionByName(empty).groupBy(*keys, "b").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    down = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("b"))
    cum = dense.withColumn("tp", F.sum("tp").over(down)).withColumn("n", F.sum("n").over(down)).filter("b > 0")
    cum = cum.join(truth_counts, keys) if keys else cum.withColumn("n_gt", truth_counts.scalar())
    cum = cum.withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return cum.select(*keys, F.element_at(arr, F.col("b")).alias("threshold"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def best_threshold(swept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest F1; the lowest threshold wins a tie."""
    cols = ["threshold", "tp", "fp", "fn", "precision", "recall", "f1"]
    return swept.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("f1", -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def pooled_figure(pred: DataFrame, gt: DataFrame, part: str = "part") -> DataFrame:
    """One sweep over the candidates of all parts together: best threshold with its scores, pairs (images) and gt_boxes.

    Only truth of the images that the parts answered counts.  An image that two parts answered is an error.
    """
    sides = pred.groupBy("image_id").agg(F.min(part).alias("a"), F.max(part).alias("b"))
    twice = [r[0] for r in sides.filter("a <> b").orderBy("image_id").limit(3).collect()]
    if twice:
        raise ValueError(f"images answered by two parts: {twice}")
    own = gt.join(sides.select("image_id"), "image_id", "left_semi")
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    best = best_threshold(sweep(flag_matches(pred.drop(part), own), count(own, "n_gt")))
    return best.withColumn("pairs", count(sides, "n").scalar()).withColumn("gt_boxes", count(own, "n").scalar())


# ---- best partner ----------------------------------------------------------------------------

def best_truth(pred: DataFrame, gt: DataFrame, positive: float = 0.35, negative: float = 0.20) -> DataFrame:
    """Best truth per candidate and its band; ties go to the lowest truth id."""
    def small(p: DataFrame, g: DataFrame) -> DataFrame:
        ranked = F.transform("__near", lambda e: F.struct(e["iou"].alias("iou"), (-e["box_id"]).alias("low"), e["box_id"].alias("box_id")))
        return _partners(p, g, "box_id").select(*pred.columns, F.array_max(ranked).alias("m"))

    def cells(p: DataFrame, g: DataFrame) -> DataFrame:
        pairs = geometry_pairs(p, g).join(truth_classes(g), ["image_id", *[f"g_{c}" for c in GEO]])
        top = pairs.groupBy("image_id", *GEO).agg(F.max_by(F.struct("iou", (-F.col("cls")).alias("low"), F.col("cls").alias("box_id")), F.struct("iou", -F.col("cls"))).alias("m"))
        return p.join(top, ["image_id", *GEO], "left").select(*pred.columns, "m")

    iou = F.coalesce(F.col("m.iou"), F.lit(0.0))
    band = F.when(iou >= positive, "positive").when(iou < negative, "negative").otherwise("ignored")
    out = by_image_size(pred, gt, small, cells)
    return out.select(*pred.columns, iou.alias("best_iou"), F.col("m.box_id").alias("best_box_id"), band.alias("band"))


def best_candidate(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Best IoU per truth box, 0 when nothing overlaps it."""
    def small(p: DataFrame, g: DataFrame) -> DataFrame:
        return _partners(g, p).select(*gt.columns, F.array_max(F.transform("__near", lambda e: e["iou"])).alias("best_iou"))

    def cells(p: DataFrame, g: DataFrame) -> DataFrame:
        top = geometry_pairs(p, g).groupBy("image_id", *[f"g_{c}" for c in GEO]).agg(F.max("iou").alias("best_iou"))
        top = top.select("image_id", *[F.col(f"g_{c}").alias(c) for c in GEO], "best_iou")
        return g.join(top, ["image_id", *GEO], "left").select(*gt.columns, "best_iou")

    return by_image_size(pred, gt, small, cells).withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))


def longest_side() -> Column:
    return F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def recall_ceiling(best: DataFrame, small: float = 12.0, threshold: float = 0.5) -> DataFrame:
    hit, tiny = F.col("best_iou") >= threshold, longest_side() < small
    return best.agg(n_rows("boxes"), tally(hit).alias("reachable"), (tally(hit) / n_rows()).alias("ceiling"), tally(tiny).alias("small_boxes"), tally(hit & tiny).alias("small_reachable"))


def error_causes(best: DataFrame, bins: Sequence[tuple[float, float, str]]) -> DataFrame:
    """Matched, proposed but loose, never proposed - by size of the longest side."""
    side = longest_side()
    name = F.coalesce(*[F.when((side >= lo) & (side < hi), n) for lo, hi, n in bins])
    b = F.col("best_iou")
    return best.groupBy(name.alias("size_bin")).agg(n_rows("boxes"), tally(b >= 0.5).alias("matched"), tally((b > 0) & (b < 0.5)).alias("loose"), tally(b == 0).alias("never_proposed"))


# ---- geometry --------------------------------------------------------------------------------

def clip(df: DataFrame, w: Column, h: Column, min_side: float = 2.0) -> DataFrame:
    lim = lambda c, hi: F.least(F.greatest(F.col(c), F.lit(0.0)), hi)
    out = df.withColumns({"x1": lim("x1", w), "x2": lim("x2", w), "y1": lim("y1", h), "y2": lim("y2", h)})
    return out.filter((F.col("x2") - F.col("x1") > min_side) & (F.col("y2") - F.col("y1") > min_side))


def axis_origins(n: Column, tile: int, stride: int) -> Column:
    """Tile starts along one axis; the last tile is flush with the edge."""
    last = n - tile
    regular = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(stride).cast("bigint"))
    return F.when(last <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_union(regular, F.array(last.cast("bigint"))))


def tile_origins(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """All tiles of every image; ``images`` is (image_id, w, h)."""
    return (images.withColumn("ty", F.explode(axis_origins(F.col("h"), tile, stride)))
            .withColumn("tx", F.explode(axis_origins(F.col("w"), tile, stride))))


def boxes_in_tiles(boxes: DataFrame, tile: int, stride: int, min_visible: float = 0.7) -> DataFrame:
    """Boxes in tile coordinates where enough of their area is visible; needs ``w`` and ``h`` of the image.

    The tiles a box can touch follow from arithmetic on its corners, so there is no join.
    """
    near = lambda arr, lo, hi: F.filter(arr, lambda o: (o < F.col(hi)) & (o + tile > F.col(lo)))
    b = (boxes.withColumn("ty", F.explode(near(axis_origins(F.col("h"), tile, stride), "y1", "y2")))
         .withColumn("tx", F.explode(near(axis_origins(F.col("w"), tile, stride), "x1", "x2"))))
    return local_boxes(b, tile, min_visible)


def local_boxes(b: DataFrame, tile: int, min_visible: float = 0.7) -> DataFrame:
    area = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    lim = lambda c, o: F.least(F.greatest(F.col(c) - F.col(o), F.lit(0.0)), F.lit(float(tile)))
    b = b.withColumn("__area", area).withColumns({"x1": lim("x1", "tx"), "x2": lim("x2", "tx"), "y1": lim("y1", "ty"), "y2": lim("y2", "ty")})
    seen = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return b.filter(seen / F.col("__area") >= min_visible).drop("__area")


def crop_window(df: DataFrame, w: Column, h: Column, context: float = 2.5) -> DataFrame:
    """Square context window around a box, inside the image, rounded half to even."""
    side = F.least(F.greatest(longest_side() * context, F.lit(32.0)), F.lit(256.0))
    df = df.withColumn("__s", side)
    lim = lambda c, n: F.rint(F.least(F.greatest(c - F.col("__s") / 2, F.lit(0.0)), F.greatest(n - F.col("__s"), F.lit(0.0)))).cast("int")
    return (df.withColumn("crop_x", lim((F.col("x1") + F.col("x2")) / 2, w)).withColumn("crop_y", lim((F.col("y1") + F.col("y2")) / 2, h))
            .withColumn("crop_side", F.rint("__s").cast("int")).drop("__s"))


def in_crop(df: DataFrame, prefix: str, crop: int = 96) -> list[Column]:
    scale = crop / F.col("crop_side")
    return [((F.col(f"{prefix}{c}") - F.col("crop_x" if c[0] == "x" else "crop_y")) * scale).alias(f"local_{prefix}{c}") for c in GEO]


def view_boxes(df: DataFrame, tile: Column, inverse: bool = False) -> DataFrame:
    """Dihedral map of boxes by the flags ``hflip``, ``vflip``, ``transpose``; the inverse undoes it last first."""
    def flip(d: DataFrame, flag: str, lo: str, hi: str) -> DataFrame:
        f = F.col(flag) == 1
        return d.withColumns({lo: F.when(f, tile - F.col(hi)).otherwise(F.col(lo)), hi: F.when(f, tile - F.col(lo)).otherwise(F.col(hi))})

    def swap(d: DataFrame) -> DataFrame:
        f = F.col("transpose") == 1
        return d.withColumns({a: F.when(f, F.col(b)).otherwise(F.col(a)) for a, b in (("x1", "y1"), ("y1", "x1"), ("x2", "y2"), ("y2", "x2"))})

    steps = [lambda d: flip(d, "hflip", "x1", "x2"), lambda d: flip(d, "vflip", "y1", "y2"), swap]
    return reduce(lambda d, s: s(d), reversed(steps) if inverse else steps, df)


def training_windows(images: DataFrame, gt: DataFrame, n: int, tile: int, positive: float = 0.5, jitter: int = 200, seed: int = 0) -> DataFrame:
    """Repeatable window sampling: a share of windows centre on a truth box of the image, the rest is uniform.

    The box of a window is the one with the smallest hash of (image, window, box): a map-side combined
    minimum per window, so an image with many boxes is not gathered.  Windows are dealt after the join by image.
    """
    first = lambda i: F.min_by(F.struct("box_id", *GEO), hash_text(seed, "image_id", f"__w{i}", "box_id"))
    numbered = gt.select("image_id", *GEO, "box_id", *[F.lit(i).alias(f"__w{i}") for i in range(n)])
    picks = numbered.groupBy("image_id").agg(F.array(*[first(i) for i in range(n)]).alias("__picks"))
    d = images.join(picks, "image_id", "left").withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = d.withColumn("p", F.get("__picks", F.col("win"))).withColumn("centred", unit(seed, "image_id", "win") < positive)
    use = F.col("centred") & F.col("p").isNotNull()

    def start(lo: str, hi: str, size: str, k: int) -> Column:
        room = F.greatest(F.col(size) - tile, F.lit(0))
        centre = (F.col(f"p.{lo}") + F.col(f"p.{hi}")) / 2 - tile / 2 + F.floor(unit(seed + k, "image_id", "win") * (2 * jitter + 1)) - jitter
        free = F.floor(unit(seed + k + 10, "image_id", "win") * (room + 1))
        return F.when(use, F.floor(F.least(F.greatest(centre, F.lit(0.0)), room))).otherwise(F.least(free, room)).cast("bigint")

    return d.select("image_id", "win", "w", "h", use.alias("centred"), start("x1", "x2", "w", 1).alias("tx"), start("y1", "y2", "h", 2).alias("ty"))


# ---- ranking ---------------------------------------------------------------------------------

def top_per_image(df: DataFrame, k: int = 40) -> DataFrame:
    """The rank limit is applied on the map side as well, so a large image ships k rows per task."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "cand_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(banded: DataFrame, per_positive: int = 8, sizes: DataFrame | None = None) -> DataFrame:
    """All positives and the best-scored negatives, up to ``per_positive`` per positive (at least that many).

    Images are ranked in one sort; in images with more rows than one task orders, negatives are ranked in slices.
    ``sizes`` is any frame with as many rows per image, for where that is cheaper to count.
    """
    positive, negative = F.col("band") == "positive", F.col("band") == "negative"

    def whole(d: DataFrame) -> DataFrame:
        # negatives come first, so that their row number is their rank
        order = Window.partitionBy("image_id").orderBy(negative.desc(), F.desc("score"), "cand_id")
        d = d.withColumn("__r", F.row_number().over(order)).withColumn("__pos", tally(positive).over(Window.partitionBy("image_id")))
        return d.filter(positive | (negative & (F.col("__r") <= per_positive * F.greatest("__pos", F.lit(1))))).drop("__r", "__pos")

    def slices(d: DataFrame) -> DataFrame:
        npos = d.groupBy("image_id").agg((per_positive * F.greatest(tally(positive), F.lit(1))).alias("quota"))
        ranked = ordinal(d.filter(negative), ["image_id"], [F.desc("score"), "cand_id"], "__r")
        kept = ranked.join(npos, "image_id").filter(F.col("__r") < F.col("quota")).drop("__r", "quota")
        return kept.unionByName(d.filter(positive))

    many = crowded((banded if sizes is None else sizes).select("image_id"), ["image_id"])
    if many is None:
        return whole(banded)
    return whole(banded.join(many, "image_id", "left_anti")).unionByName(slices(banded.join(many, "image_id", "left_semi")))


# ---- derived data ----------------------------------------------------------------------------

def merge_shards(shards: Sequence[DataFrame], key: str = "image_id") -> DataFrame:
    """Union of per-shard records, the last shard wins per key; older records have no provenance columns."""
    tagged = [s.withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    last = pool.groupBy(key).agg(F.max("shard").alias("shard"))
    return pool.join(last, [key, "shard"])


def fold_safe(derived: DataFrame, folds: DataFrame, k: int = 5) -> DataFrame:
    """(fold, derived row) pairs that are safe to train on.

    Rows made from the test split are always safe, rows made from a training page are safe in every
    fold that does not validate on it, rows without a source are dropped.
    """
    src = derived.join(folds.select(F.col("image_id").alias("src_idx"), F.col("fold").alias("src_fold")), "src_idx", "left")
    every = src.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ok = (F.col("src_split") == "test") | ((F.col("src_split") == "train") & F.col("src_idx").isNotNull()
                                           & (F.col("src_fold").isNull() | (F.col("src_fold") != F.col("fold"))))
    return every.filter(ok).drop("src_fold")


def blend_scores(df: DataFrame, score: str, verifier: Sequence[str], b: float = 0.5) -> DataFrame:
    """v^b * s^(1-b) per verifier, averaged."""
    parts = [F.pow(F.col(v), F.lit(b)) * F.pow(F.col(score), F.lit(1 - b)) for v in verifier]
    return df.withColumn("blended", sum(parts[1:], parts[0]) / len(parts))


# fixed values of the crop, fusion and matching rules: 2.5, 32, 256, 0.35, 0.20, 0.7

# ---- fusion ----------------------------------------------------------------------------------

def islands(df: DataFrame, cell: float = 16.0) -> DataFrame:
    """Cut each image into blocks whose hulls are disjoint, by empty stripes in x and then in y.

    A fused box is an average of its members, so it stays inside their hull: boxes of different blocks
    can never meet.  Stripes are found on occupied grid cells, at most image size / cell per image.
    """
    def split(d: DataFrame, keys: list[str], lo: str, hi: str, out: str) -> DataFrame:
        first = F.floor(F.col(lo) / cell)
        occ = d.select(*keys, F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(hi) / cell)))).alias("__c")).distinct()
        w = Window.partitionBy(*keys).orderBy("__c")
        occ = occ.withColumn("__new", F.coalesce(F.col("__c") - F.lag("__c").over(w) > 1, F.lit(False)).cast("int"))
        occ = occ.withColumn(out, F.sum("__new").over(w)).drop("__new")
        return d.withColumn("__c", first).join(occ, keys + ["__c"]).drop("__c")

    d = split(df, ["image_id"], "x1", "x2", "slab")
    return split(d, ["image_id", "slab"], "y1", "y2", "block")


#: Boxes of a block that are fused without arrays.
FEW_BOXES = 16


def _fuse_few(boxes: list[list[float]], scores: list[float], iou_thr: float, n_sources: int) -> list[tuple]:
    """``_fuse`` for a handful of boxes, where array steps cost more than they save; the same sums in the same order."""
    fused: list[list[float]] = []
    members: list[list[int]] = []
    for i, (x1, y1, x2, y2) in enumerate(boxes):
        j, top = -1, 0.0
        for k, (a1, b1, a2, b2) in enumerate(fused):
            w, h = min(x2, a2) - max(x1, a1), min(y2, b2) - max(y1, b1)
            if w > 0 and h > 0:
                union = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - w * h
                v = w * h / max(union, 1e-9) if union > 0 else 0.0
                if v > top:
                    j, top = k, v
        if j < 0 or top < iou_thr:
            fused.append([x1, y1, x2, y2])
            members.append([i])
        else:
            members[j].append(i)
            total = sum(scores[m] for m in members[j])
            fused[j] = [sum(boxes[m][c] * scores[m] for m in members[j]) / total for c in range(4)]
    return _fused_rows(fused, members, scores, n_sources)


def _fuse(boxes: list[list[float]], scores: list[float], iou_thr: float, n_sources: int) -> list[tuple]:
    """Running weighted averages over boxes in visiting order; each box meets all fused ones in one array step."""
    if len(boxes) <= FEW_BOXES:
        return _fuse_few(boxes, scores, iou_thr, n_sources)
    fused = np.zeros((min(len(boxes), 64), 4))
    members: list[list[int]] = []
    for i, (x1, y1, x2, y2) in enumerate(boxes):
        f = fused[:len(members)]
        inter = np.clip(np.minimum(x2, f[:, 2]) - np.maximum(x1, f[:, 0]), 0, None) * np.clip(np.minimum(y2, f[:, 3]) - np.maximum(y1, f[:, 1]), 0, None)
        union = (x2 - x1) * (y2 - y1) + (f[:, 2] - f[:, 0]) * (f[:, 3] - f[:, 1]) - inter
        iou = np.where((union > 0) & (inter > 0), inter / np.maximum(union, 1e-9), 0.0)
        j = int(iou.argmax()) if len(iou) else -1
        if j < 0 or iou[j] <= 0 or iou[j] < iou_thr:
            if len(members) == len(fused):
                fused = np.concatenate([fused, np.zeros_like(fused)])
            fused[len(members)] = (x1, y1, x2, y2)
            members.append([i])
        else:
            members[j].append(i)
            total = sum(scores[m] for m in members[j])
            fused[j] = [sum(boxes[m][c] * scores[m] for m in members[j]) / total for c in range(4)]
    return _fused_rows(fused[:len(members)].tolist(), members, scores, n_sources)


def _fused_rows(fused: list[list[float]], members: list[list[int]], scores: list[float], n_sources: int) -> list[tuple]:
    out = []
    for f, m in zip(fused, members):
        score = sum(scores[i] for i in m) / len(m) * min(len(m), n_sources) / n_sources
        out.append((*f, min(max(score, 0.0), 1.0), len(m)))
    return out


def fuse_boxes(df: DataFrame, n_sources: int, iou_thr: float = 0.55) -> DataFrame:
    """Weighted box fusion.

    The visit order carries state, so each disjoint block is one small sequential unit.  An image with few boxes is such
    a unit as it stands; the others are cut into blocks, and a box alone in its block needs no state and stays in the JVM.
    Units are hash-partitioned, sorted in visit order, and many run in one Arrow batch.
    """
    cols = df.select("image_id", "cand_id", *[F.col(c).cast("double").alias(c) for c in GEO], "score")
    many = crowded(df.select("image_id"), ["image_id"], IMAGE_ROWS)
    if many is None:
        return _fuse_images(cols, n_sources, iou_thr)
    return (_fuse_images(cols.join(many, "image_id", "left_anti"), n_sources, iou_thr)
            .unionByName(_fuse_islands(cols.join(many, "image_id", "left_semi"), n_sources, iou_thr)))


FUSED = "image_id long, x1 double, y1 double, x2 double, y2 double, score double, members long"


def _fuse_images(cols: DataFrame, n_sources: int, iou_thr: float) -> DataFrame:
    # one row per image, in visit order
    box = F.struct((-F.col("score")).alias("by"), "cand_id", F.array(*GEO).alias("geo"), "score")
    line = cols.groupBy("image_id").agg(F.sort_array(F.collect_list(box)).alias("line"))
    line = line.select("image_id", "line.geo", "line.score")

    def run(batches):
        for pdf in batches:
            rows = [(i, *r) for i, g, s in zip(pdf["image_id"].tolist(), pdf["geo"], pdf["score"])
                    for r in _fuse([x.tolist() for x in g], s.tolist(), iou_thr, n_sources)]
            yield pd.DataFrame(rows, columns=["image_id", *GEO, "score", "members"])

    return line.mapInPandas(run, FUSED)


def _fuse_islands(cols: DataFrame, n_sources: int, iou_thr: float) -> DataFrame:
    key = ["image_id", "slab", "block"]
    # the candidates feed several steps: written once instead of being computed for each of them
    placed = cut(islands(cut(cols)))
    alone = placed.join(placed.groupBy(*key).agg(n_rows("__n")), key)
    single = alone.filter("__n = 1").select(
        "image_id", *GEO, F.least(F.greatest(F.col("score") / n_sources, F.lit(0.0)), F.lit(1.0)).alias("score"), F.lit(1).cast("long").alias("members"))

    def run(batches):
        held = []  # pieces of the block that may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf[key].to_numpy()
            begins = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            if held and (held[-1][key].to_numpy()[-1] != ids[0]).any():
                yield whole_block(held)
                held = []
            if len(begins):
                yield whole_block([*held, pdf.iloc[:begins[0]]])
                if len(begins) > 1:
                    yield fuse_blocks(pdf.iloc[begins[0]:begins[-1]], [x - begins[0] for x in begins])
                held = []
            held.append(pdf.iloc[begins[-1] if len(begins) else 0:])
        if held:
            yield whole_block(held)

    def whole_block(pieces: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(pieces, ignore_index=True)
        return fuse_blocks(pdf, [0, len(pdf)])

    def fuse_blocks(pdf: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        geo, sc, img = pdf[GEO].to_numpy(float).tolist(), pdf["score"].tolist(), pdf["image_id"].tolist()
        rows = [(img[a], *r) for a, b in zip(cuts, cuts[1:]) for r in _fuse(geo[a:b], sc[a:b], iou_thr, n_sources)]
        return pd.DataFrame(rows, columns=["image_id", *GEO, "score", "members"])

    work = (alone.filter("__n > 1").select(*key, "cand_id", *GEO, "score").repartition(*key)
            .sortWithinPartitions(*key, F.desc("score"), "cand_id"))
    fused = work.mapInPandas(run, FUSED)
    return single.unionByName(fused)
