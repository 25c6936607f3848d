"""Peaks and components of images larger than a tile equal plain loops over whole images."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import raster


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(4)
    spots = {(i, y, x): (rng.random() < 0.3) for i in (3, 8) for y in range(30) for x in range(37) if rng.random() < 0.9}
    # a long bar through many tiles
    spots |= {(8, 20, x): True for x in range(2, 35)}
    rows = [(i, y, x, 0.0, 40.0 if v else 0.0, float(rng.integers(0, 20)) / 10, 4.0, 5.0) for (i, y, x), v in spots.items()]
    return rows, spark.createDataFrame(rows, "image_id long, y int, x int, t_ink double, p_ink double, score double, w double, h double").repartition(5)


def near(y, x):
    return [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def test_peaks(image):
    rows, df = image
    want = set()
    for i in (3, 8):
        s = {(r[1], r[2]): r[5] for r in rows if r[0] == i}
        peaks = [(-v, y, x) for (y, x), v in s.items() if all(s.get(p, -1) <= v for p in near(y, x)) and v >= 0.05]
        want |= {(i, k + 1, -v, x * 4.0 - 2, y * 4.0 - 2.5) for k, (v, y, x) in enumerate(sorted(peaks)[:64])}
    for side in (8, 64):
        got = {(r.image_id, r["rank"], r.score, r.x1, r.y1) for r in raster.heatmap_boxes(df.select("image_id", "y", "x", "score", "w", "h"), side=side).collect()}
        assert got == want


def test_components(image):
    rows, df = image
    want = []
    for i in (3, 8):
        m = {(r[1], r[2]): r[4] > 25 for r in rows if r[0] == i}
        g = {p: any(m.get(q, False) for q in near(*p)) for p in m}
        left = {p for p in m if all(g.get(q, True) for q in near(*p))}
        while left:
            todo, comp = [left.pop()], []
            while todo:
                p = todo.pop()
                comp.append(p)
                todo += (more := [q for q in near(*p) if q in left])
                left.difference_update(more)
            ys, xs = zip(*comp)
            if len(comp) >= 3:
                want.append((i, min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(comp)))
    assert any(w[3] - w[1] > 16 for w in want)
    for side in (8, 64):
        got = [(r.image_id, r.x1, r.y1, r.x2, r.y2, r.area) for r in raster.difference_blobs(df, min_area=3, side=side).collect()]
        assert sorted(got) == sorted(want)


def test_a_tile_needs_no_order_of_pixels(tables):
    text = raster._peaks(tables.grid_tiles, 32)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Sort" not in text
    long = tables.raster.filter("image_id < 40")
    same = lambda d: sorted(map(tuple, raster.difference_blobs(d).collect()))
    assert same(long) == same(tables.raster_tiles.filter("image_id < 40"))
    assert tables.raster_tiles.select("image_id", F.inline("pixels")).exceptAll(tables.raster).isEmpty()
