"""Seeded synthetic clouds and images: every value is a hash of seed, row and stream, so any partitioning gives the same rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.raster import to_image8

SEED = 7_350_911


def uniform01(seed: int, stream: int, row: str = "id") -> Column:
    """Uniform in [0, 1) from 52 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col(row)), 12).cast("double") / float(1 << 52)


def uniform(low: float, high: float, seed: int, stream: int) -> Column:
    return F.lit(float(low)) + uniform01(seed, stream) * F.lit(float(high - low))


def normal(seed: int, stream: int, row: str = "id") -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(1 - uniform01(seed, 2 * stream, row))) * F.cos(2 * math.pi * uniform01(seed, 2 * stream + 1, row))


def _cloud(rows: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    return rows.select(F.col("id").alias("point_id"), *(c.cast("float").alias(n) for c, n in zip((x, y, z), "xyz", strict=True)))


def make_plane(spark: SparkSession, count: int, half: float = 4.0, z: float = 0.0, seed: int = SEED) -> DataFrame:
    """A uniform square."""
    return _cloud(spark.range(count), uniform(-half, half, seed, 0), uniform(-half, half, seed, 1), F.lit(z))


def make_sphere(spark: SparkSession, count: int, radius: float = 1.0, center=(-1.5, 1.2, 1.0), seed: int = SEED) -> DataFrame:
    """A sphere's surface, uniform by area: the cosine of the polar angle is uniform."""
    c, a = uniform(-1, 1, seed, 0), uniform(0, 2 * math.pi, seed, 1)
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    return _cloud(spark.range(count), center[0] + radius * s * F.cos(a), center[1] + radius * s * F.sin(a), center[2] + radius * c)


def make_box(spark: SparkSession, count: int, half: float = 0.8, center=(1.6, -1.0, 0.8), seed: int = SEED) -> DataFrame:
    """A cube's surface: one of six faces, then a place on it."""
    face = F.floor(uniform01(seed, 0) * 6).cast("int") % 6
    side = F.when(face % 2 == 0, F.lit(half)).otherwise(-half)
    a, b = uniform(-half, half, seed, 1), uniform(-half, half, seed, 2)
    axis = F.floor(face / 2)
    x = F.when(axis == 0, side).otherwise(a)
    y = F.when(axis == 0, a).when(axis == 1, side).otherwise(b)
    z = F.when(axis == 2, side).otherwise(b)
    return _cloud(spark.range(count), center[0] + x, center[1] + y, center[2] + z)


def uniform_cloud(spark: SparkSession, count: int, half: float = 5.0, seed: int = SEED) -> DataFrame:
    return _cloud(spark.range(count), *(uniform(-half, half, seed, k) for k in range(3)))


#: Sizes of the default scene; the defaults of the shapes above are its places.
@dataclass(frozen=True)
class SceneOptions:
    plane_points: int = 30_000
    sphere_points: int = 20_000
    box_points: int = 20_000
    seed: int = SEED


def make_scene(spark: SparkSession, options: SceneOptions = SceneOptions()) -> DataFrame:  # noqa: B008
    """Plane, sphere and box, in this order: ids of each begin where those before it end."""
    o = options
    sphere, box = make_sphere(spark, o.sphere_points, seed=o.seed + 1), make_box(spark, o.box_points, seed=o.seed + 2)
    after = lambda cloud, n: cloud.withColumn("point_id", F.col("point_id") + n)
    return make_plane(spark, o.plane_points, seed=o.seed).unionByName(after(sphere, o.plane_points)).unionByName(after(box, o.plane_points + o.sphere_points))


def add_gaussian_noise(points: DataFrame, sigma: float, seed: int = SEED) -> DataFrame:
    if sigma <= 0:
        return points
    return points.select(*((F.col(c) + sigma * normal(seed, "xyz".index(c), "point_id")).cast("float").alias(c) if c in ("x", "y", "z") else F.col(c) for c in points.columns))


def random_subset(points: DataFrame, keep: float, seed: int = SEED) -> DataFrame:
    """Each point with probability keep (clamped to 0..1)."""
    return points.where(uniform01(seed, 0, "point_id") < F.lit(min(max(keep, 0.0), 1.0)))


#: Fixed values of the test image, as shares of width and height (discs: radius as a share of the smaller): place and grey.
RECTANGLES = [(0.08, 0.12, 0.32, 0.45, 210.0), (0.55, 0.10, 0.90, 0.30, 160.0), (0.40, 0.60, 0.62, 0.88, 235.0)]
DISCS = [(0.80, 0.68, 0.11, 190.0), (0.16, 0.76, 0.075, 130.0)]
BACKGROUND, SLOPE = 30.0, 25.0


def make_test_image(spark: SparkSession, width: int = 320, height: int = 240, noise_sigma: float = 3.0, seed: int = SEED, image_id: str = "scene") -> DataFrame:
    """Grey (image_id, x, y, v): a sloping background, three rectangles, two discs and noise."""
    p = spark.range(width * height).withColumn("x", (F.col("id") % width).cast("int")).withColumn("y", F.floor(F.col("id") / width).cast("int"))
    x, y = F.col("x"), F.col("y")
    v = F.lit(BACKGROUND) + SLOPE * x / width
    for x0, y0, x1, y1, grey in RECTANGLES:
        v = F.when((x >= int(x0 * width)) & (x < int(x1 * width)) & (y >= int(y0 * height)) & (y < int(y1 * height)), grey).otherwise(v)
    for cx, cy, r, grey in DISCS:
        v = F.when(F.pow(x - cx * width, 2) + F.pow(y - cy * height, 2) <= (r * min(width, height)) ** 2, grey).otherwise(v)
    noise = noise_sigma * normal(seed, 0) if noise_sigma > 0 else F.lit(0.0)
    return to_image8(p.select(F.lit(image_id).alias("image_id"), "x", "y", (v + noise).alias("v")))
