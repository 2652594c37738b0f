"""Aggregates and projections over point clouds: DataFrames with x, y, z and any group columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions.geometry import RigidTransform
from voxelweave.operators.positions import with_positions

FIXED = 1_000_000  # steps a unit of the fixed-point sums


def fixed(c: str | Column) -> Column:
    """A coordinate in whole steps: sums of these don't depend on the order of rows or the number of partitions."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * FIXED).cast("long")


def fixed_mean(c: str | Column) -> Column:
    return F.sum(fixed(c)).cast("double") / F.count("*").cast("double") / FIXED


def bounds(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest coordinates; nulls for an empty cloud."""
    return points.groupBy(*by).agg(*(f(k).cast("double").alias(f"{name}_{k}") for name, f in (("min", F.min), ("max", F.max)) for k in "xyz"))


def extent(box: DataFrame) -> DataFrame:
    """bounds() with extents (0 for an empty cloud) and the widest axis (the lower one of equals)."""
    out = box.select("*", *(F.coalesce(F.col(f"max_{k}") - F.col(f"min_{k}"), F.lit(0.0)).alias(f"extent_{k}") for k in "xyz"))
    x, y, z = (F.col(f"extent_{k}") for k in "xyz")
    return out.withColumn("widest_axis", F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2))


def centroid(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean coordinates by fixed-point sums; zeros for an empty cloud. n_points is the size."""
    return points.groupBy(*by).agg(*(F.coalesce(fixed_mean(k), F.lit(0.0)).alias(f"centroid_{k}") for k in "xyz"), F.count("*").alias("n_points"))


def storage_bytes(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bytes of the coordinates as 32-bit floats."""
    return points.groupBy(*by).agg((F.count("*") * 12).alias("storage_bytes"))


def transform(points: DataFrame, pose: RigidTransform) -> DataFrame:
    """The cloud moved by a pose: one projection of three linear expressions."""
    moved = dict(zip("xyz", pose.columns(), strict=True))
    return points.select(*(moved.get(c, F.col(c)) if c in moved else F.col(c) for c in points.columns))


def numbered(points: DataFrame, by: str | None = None) -> DataFrame:
    """The cloud with point_id from 0 in the order of its ids, without gaps; with `by` within each cloud."""
    return with_positions(points.withColumnRenamed("point_id", "__id"), ["__id"], by, "point_id").select(points.columns)


def point_at(points: DataFrame, position: int) -> DataFrame:
    """The point at a position (from 0) in the order of ids; no row beyond the end."""
    return with_positions(points, ["point_id"], None, "__position").where(F.col("__position") == position).drop("__position")


def with_point(points: DataFrame, position: int, x: float, y: float, z: float) -> DataFrame:
    """The cloud with other coordinates at a position."""
    new = dict(zip("xyz", (x, y, z), strict=True))
    here = F.col("__position") == position
    placed = with_positions(points, ["point_id"], None, "__position")
    return placed.select(*(F.when(here, F.lit(new[c])).otherwise(F.col(c)).cast(points.schema[c].dataType).alias(c) if c in new else F.col(c) for c in points.columns))


def union(clouds: Sequence[DataFrame]) -> DataFrame:
    """Clouds one after another, with point_id from 0 in the order of clouds and their ids, without gaps; null ids come first in theirs."""
    out = None
    for k, cloud in enumerate(clouds):
        own = cloud.withColumn("__cloud", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return with_positions(out.withColumnRenamed("point_id", "__id"), ["__cloud", "__id"], None, "point_id").select(clouds[0].columns)
