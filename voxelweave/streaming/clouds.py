"""Cloud operators under Structured Streaming.

Projections and filters (transform, threshold) run on streams as they are. Voxels need a fixed origin, as a stream
has no smallest coordinates yet; with a watermark on an event time, cells are kept by time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.cloud import fixed_mean


def voxel_stream(points: DataFrame, leaf: float, origin=(0.0, 0.0, 0.0), time: str | None = None, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Centroids of cells counted from a fixed origin; with `time`, of each window, closed once the watermark has passed."""
    if not leaf > 0:
        raise ValueError("the leaf must be positive")
    cells = points.select("*", *(F.floor((F.col(k).cast("double") - F.lit(float(o))) / F.lit(float(leaf))).cast("long").alias(f"i{k}") for k, o in zip("xyz", origin, strict=True)))
    keys = ["ix", "iy", "iz"]
    if time:
        cells = cells.withWatermark(time, late)
        keys = [F.window(time, window).alias("window"), *keys]
    return cells.groupBy(*keys).agg(*(fixed_mean(k).alias(k) for k in "xyz"), F.count("*").alias("n_points"))
