"""The driver tables seen as clouds and rasters.

points: events as (point_id, x, y, z) = (event_id, days since 2024-01-01, value / 10, user_id mod 50).
smooth and rough: a grid over floor(x), floor(y) with count(*) and sum(user_id) mod 256, zeros filled in. It is
30 x 50 from the origin at least, and wider or higher, to either side, where events lie beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions.geometry import RigidTransform, rotation_axis_angle
from voxelweave.operators.cloud import transform
from voxelweave.session import ship

SHIFT = RigidTransform(rotation_axis_angle((0.2, 0.9, -0.4), 0.004), (0.06, -0.05, 0.02))
WIDTH, HEIGHT = 30, 50
_SINCE = "(ts - timestamp_ntz'2024-01-01 00:00:00')"
_MICROS = f"(((extract(day from {_SINCE}) * 24L + extract(hour from {_SINCE})) * 60 + extract(minute from {_SINCE})) * 60000000 + cast(extract(second from {_SINCE}) * 1000000 as bigint))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("point_id"), F.expr(f"cast({_MICROS} as double) / 86400000000D").alias("x"), (F.col("value") / 10).alias("y"), (F.col("user_id") % 50).cast("double").alias("z"), "user_id")


def moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole cloud, and the whole cloud moved a little: two clouds to be matched."""
    p = points(spark, sf_dir).drop("user_id")
    return p, transform(p, SHIFT)


def queries_of(cloud: DataFrame) -> DataFrame:
    return cloud.withColumnRenamed("point_id", "query_id")


def raster(spark: SparkSession, sf_dir: str, rough: bool) -> DataFrame:
    p = points(spark, sf_dir)
    value = F.sum("user_id") % 256 if rough else F.count("*")
    cells = p.groupBy(F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).agg(value.cast("long").alias("v"))
    ends = cells.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    side = lambda c, n: F.explode(F.sequence(F.least(F.lit(0), f"low_{c}"), F.greatest(F.lit(n - 1), f"high_{c}"))).alias(c)
    grid = ends.select(side("x", WIDTH), "low_y", "high_y").select(F.lit(0).alias("image_id"), "x", side("y", HEIGHT))
    return grid.join(cells, ["x", "y"], "left").select("image_id", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels: smooth * 3 mod 256, rough, and (smooth + rough) mod 256."""
    s, r = raster(spark, sf_dir, False).withColumnRenamed("v", "s"), raster(spark, sf_dir, True).withColumnRenamed("v", "r")
    channels = F.array(F.col("s") * 3 % 256, F.col("r"), (F.col("s") + F.col("r")) % 256)
    return s.join(r, ["image_id", "x", "y"]).select("image_id", "x", "y", F.posexplode(channels).alias("c", "v"))


# --- the same in DuckDB SQL --------------------------------------------------------------------------------

POINTS_SQL = "p AS (SELECT event_id AS point_id, CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS x, value / 10 AS y, CAST(user_id % 50 AS DOUBLE) AS z, user_id FROM events)"
RASTER_SQL = f"""{POINTS_SQL},
cells AS (SELECT CAST(floor(x) AS INTEGER) AS x, CAST(floor(y) AS INTEGER) AS y, count(*) AS n, CAST(sum(user_id) % 256 AS BIGINT) AS m FROM p GROUP BY 1, 2),
ends AS (SELECT least(0, min(x)) AS x0, greatest({WIDTH - 1}, max(x)) AS x1, least(0, min(y)) AS y0, greatest({HEIGHT - 1}, max(y)) AS y1 FROM cells),
grid AS (SELECT a.x, b.y FROM (SELECT CAST(unnest(range(x0, x1 + 1)) AS INTEGER) AS x FROM ends) a, (SELECT CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS y FROM ends) b),
smooth AS (SELECT g.x, g.y, coalesce(n, 0) AS v FROM grid g LEFT JOIN cells c ON g.x = c.x AND g.y = c.y),
rough AS (SELECT g.x, g.y, coalesce(m, 0) AS v FROM grid g LEFT JOIN cells c ON g.x = c.x AND g.y = c.y)"""
