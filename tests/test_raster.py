from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import components, raster
from voxelweave.session import materialize
from voxelweave.sources import synthetic


def frame(spark, grid):
    return spark.createDataFrame([("i", x, y, float(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], "image_id string, x int, y int, v double")


def grid(df, column="v"):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1))
    for r in rows:
        out[r["y"], r["x"]] = r[column]
    return out


def test_kernels():
    for sigma in (0.5, 1, 2.5):
        k = raster.gaussian_kernel(sigma)
        assert np.isclose(sum(k), 1) and len(k) % 2 == 1 and np.allclose(k, k[::-1])
    for sigma in (0, -1):
        with pytest.raises(raster.RasterError):
            raster.gaussian_kernel(sigma)


def test_blur_and_sobel(spark):
    assert np.allclose(grid(raster.gaussian_blur(frame(spark, np.full((17, 21), 128)), 2)), 128, atol=1e-3)
    step = np.full((12, 20), 20.0)
    step[:, 10:] = 220
    blurred = grid(raster.gaussian_blur(frame(spark, step), 1.5))
    assert 20 < blurred[6, 9] < 220 and np.isclose(blurred[6, 0], 20, atol=0.5)
    g = raster.sobel(frame(spark, step))
    assert np.abs(grid(g, "gx"))[:, 9:11].min() > 100 and np.abs(grid(g, "gy")).max() == 0
    thin = grid(raster.non_maximum_suppression(g))
    assert 1 <= (thin[6] > 0).sum() <= 2
    flat = raster.sobel(frame(spark, step.T))
    assert np.abs(grid(flat, "gy"))[9:11].min() > 100 and np.abs(grid(flat, "gx")).max() == 0


def test_tiles_and_chains_give_the_same(spark):
    """Stencils on small tiles, in one tile, and three steps in one shuffle; images that start anywhere."""
    rng = np.random.default_rng(8)
    image = rng.integers(0, 255, (19, 23)).astype(float)
    df = frame(spark, image).withColumn("x", F.col("x") - 7).withColumn("y", F.col("y") + 40)
    key = lambda d: sorted(map(tuple, d.collect()))
    kernel = raster.gaussian_kernel(1.2)
    padded = np.pad(image, 4, mode="edge")
    slow = sum(w * v * padded[4 + a : 23 + a, 4 + b : 27 + b] for a, w in zip(range(-4, 5), kernel, strict=True) for b, v in zip(range(-4, 5), kernel, strict=True))
    got = {(r["x"] + 7, r["y"] - 40): r["v"] for r in raster.gaussian_blur(df, 1.2, tile=5).collect()}
    assert np.allclose([[got[x, y] for x in range(23)] for y in range(19)], slow)
    steps = raster.non_maximum_suppression(raster.sobel(raster.gaussian_blur(df, 1.2)))
    assert key(steps) == key(raster.ridges(df, kernel, tile=6)) == key(raster.ridges(df, kernel))
    whole = df.withColumn("v", F.col("v").cast("int"))
    assert raster.convolve(whole, [1, 2, 1], [1, 2, 1]).schema["v"].dataType.typeName() == "long"
    plan = raster.ridges(df, kernel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_images_with_odd_rows(spark):
    rows = [(i, x, y, 1) for i in ("a", None) for x in range(3) for y in range(2)]
    make = lambda r: spark.createDataFrame(r, "image_id string, x int, y int, v int")
    got = raster.convolve(make([*rows, ("a", 1, 1, 5), ("a", None, 1, 5)]), [1, 1, 1]).collect()
    assert sorted(map(str, got)) == sorted(map(str, raster.convolve(make(rows), [1, 1, 1]).collect())) and {r["v"] for r in got} == {3}
    assert raster.sobel(make([])).count() == 0
    for wrong in (rows[1:], [*rows[1:], ("a", 0, 0, None)]):
        with pytest.raises(Exception, match="missing pixels|null samples"):
            raster.sobel(make(wrong)).collect()


def test_hysteresis_chain(spark):
    weak = np.zeros((3, 9))
    weak[1] = [90, 30, 30, 30, 30, 0, 0, 0, 30]
    for low, high in ((20, 60), (60, 20)):
        got = grid(components.hysteresis_threshold(frame(spark, weak), low, high))
        assert (got[1] > 0).tolist() == [True] * 5 + [False] * 4


def test_components(spark):
    three = np.zeros((20, 20))
    three[1:5, 1:5], three[1:5, 8:14], three[10:16, 10:16] = 1, 1, 1
    for tile in (components.TILE, 4):
        labels = materialize(components.connected_components(frame(spark, three), tile=tile), "labels")
        stats = components.component_stats(labels).orderBy("label").collect()
        assert [r["label"] for r in stats] == [1, 2, 3] and [r["area"] for r in stats] == [16, 24, 36]
        assert (stats[0]["min_x"], stats[0]["max_x"], stats[0]["centroid_x"], stats[0]["width"]) == (1, 4, 2.5, 4)
    diagonal = np.zeros((6, 6))
    diagonal[1, 1] = diagonal[2, 2] = 1
    count = lambda c, a=1: components.component_stats(components.connected_components(frame(spark, diagonal), c, a)).count()
    assert (count(8), count(4), count(8, 3)) == (1, 2, 0)
    with pytest.raises(raster.RasterError):
        components.connected_components(frame(spark, diagonal), 6)


def _flood(image: np.ndarray, eight: bool) -> np.ndarray:
    """Labels in raster order by flooding."""
    out, label = np.zeros(image.shape, int), 0
    for y, x in zip(*np.nonzero(image), strict=True):
        if out[y, x]:
            continue
        label, stack = label + 1, [(y, x)]
        while stack:
            b, a = stack.pop()
            if 0 <= b < image.shape[0] and 0 <= a < image.shape[1] and image[b, a] and not out[b, a]:
                out[b, a] = label
                stack += [(b + dy, a + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if eight or not (dx and dy)]
    return out


def test_components_over_many_tiles(spark):
    """Spirals and noise that cross many seams, in several tiles and in one."""
    rng = np.random.default_rng(5)
    image = (rng.random((23, 29)) < 0.55).astype(int)
    image[1::4, 1:-1] = 1
    for eight, tile in ((True, 5), (False, 5), (False, 64)):
        got = grid(components.connected_components(frame(spark, image), 8 if eight else 4, tile=tile), "label")
        assert (got == _flood(image, eight)).all()


@pytest.mark.parametrize("tile", [1024, 2])
def test_repeated_pixels_and_null_images(spark, tile):
    schema = "image_id string, x int, y int, v double"
    rows = [(i, x, 0, 1.0) for i in ("a", None) for x in (0, 1, 2, 4, 5)] + [("a", 1, 0, 1.0), ("a", 3, 0, None), ("a", None, 0, 1.0), (None, 7, 0, 0.0)]
    df = spark.createDataFrame(rows, schema)
    got = components.connected_components(df, tile=tile).collect()
    assert len(got) == len(rows)
    want = {0: 1, 1: 1, 2: 1, 3: 0, 4: 2, 5: 2, 7: 0, None: 0}
    assert all(r["label"] == want[r["x"]] for r in got)
    on = components.hysteresis_threshold(df.withColumn("v", df["v"] * 10 + df["x"]), 10, 15, tile=tile).collect()
    assert len(on) == len(rows) and {r["x"] for r in on if r["v"]} == {4, 5}
    assert components.connected_components(df.where("false"), tile=tile).count() == 0


def test_no_group_is_larger_than_a_tile(spark, monkeypatch):
    label = components._label_a_tile

    def watched(offsets):
        run = label(offsets)

        def counted(pixels):
            assert len(pixels) <= 16
            return run(pixels)

        return counted

    monkeypatch.setattr(components, "_label_a_tile", watched)
    got = components.connected_components(frame(spark, np.ones((11, 13))), 4, tile=4)
    assert got.where("label = 1").count() == 143


def test_generated_scene_has_five_regions(spark):
    image = synthetic.make_test_image(spark, 160, 120, 2.0, 9)
    mask = materialize(raster.threshold(raster.gaussian_blur(image, 1.4), 110), "mask")
    assert components.component_stats(components.connected_components(mask, 8, 40)).count() == 5


def test_conversions(spark):
    red = spark.createDataFrame([("i", 0, 0, c, v) for c, v in enumerate((255, 0, 0))], "image_id string, x int, y int, c int, v int")
    assert raster.to_grayscale(red).first()["v"] == 76
    signed = frame(spark, [[-50, 0, 150]])
    assert grid(raster.to_image8(signed)).tolist() == [[0, 0, 150]] and grid(raster.normalize_to_image8(signed)).tolist() == [[0, 64, 255]]
    assert grid(raster.normalize_to_image8(frame(spark, [[0, 0], [0, 0]]))).max() == 0
    colours = components.colorize_labels(spark.createDataFrame([("i", 0, 0, 0), ("i", 1, 0, 1)], "image_id string, x int, y int, label long")).orderBy("x").collect()
    assert tuple(colours[0])[3:] == (0, 0, 0) and all(60 <= v <= 255 for v in tuple(colours[1])[3:])


def test_raster_holds_every_event(spark, tmp_path):
    import datetime

    from voxelweave.plans import adapters

    day = datetime.datetime(2024, 1, 1)
    rows = [(1, day, 5.0, 7), (2, day + datetime.timedelta(days=3), 560.2, 7), (3, day + datetime.timedelta(days=40), 12.0, 7), (4, day - datetime.timedelta(days=2), -31.0, 7)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["x"], r["y"]): r["v"] for r in adapters.raster(spark, str(tmp_path), False).collect()}
    assert {k for k, v in got.items() if v} == {(0, 0), (3, 56), (40, 1), (-2, -4)} and len(got) == 43 * 61


def test_images_that_are_not_sound(spark):
    rows = [(x, y, 7) for x in range(3) for y in range(2)]
    make = lambda r: spark.createDataFrame([("i", *p) for p in r], "image_id string, x int, y int, v int")
    assert [tuple(r) for r in raster.image_check(make(rows)).collect()] == [("i", 3, 2, 1, True)]
    for wrong in (rows[1:], [*rows, rows[0]], [*rows[1:], (0, 0, 256)], [*rows[1:], (0, 0, None)], [*rows, (-1, 0, 3)]):
        with pytest.raises(raster.RasterError):
            raster.require_image8(make(wrong))
    assert raster.require_image8(make(rows)).count() == 6 and raster.image_check(make(rows).where("false")).count() == 0
