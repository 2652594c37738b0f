"""Connected components of binary images, hysteresis thresholds and label colours.

Images are cut into tiles of TILE x TILE pixels. Union-find labels each tile in one task; pixels on either side of a seam
link the components of their tiles, and a distributed closure over these links alone, far fewer than pixels, joins
them. So an image of any size is labelled, and no group is larger than a tile. Labels are dense from 1 in raster order of
each surviving component's first pixel, numbered by prefix sums; 0 is background.

A repeated pixel counts once, as foreground if any of its rows is; a null image_id is an image of its own; pixels
without x or y, or with a null value, are background and keep their row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.graph import closure
from voxelweave.operators.positions import with_positions
from voxelweave.operators.raster import RasterError
from voxelweave.session import Scratch

TILE = 1024


def _offsets(connectivity: int) -> list[tuple[int, int]]:
    if connectivity == 4:
        return [(1, 0), (0, 1)]
    if connectivity == 8:
        return [(1, 0), (0, 1), (1, 1), (-1, 1)]
    raise RasterError("connectivity is 4 or 8")


def _label_a_tile(offsets: list[tuple[int, int]]):
    def run(pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.drop_duplicates(["y", "x"]).sort_values(["y", "x"], kind="stable")
        x, y = pixels["x"].to_numpy(np.int64), pixels["y"].to_numpy(np.int64)
        span = int(x.max() - x.min()) + 3
        key = (y - y.min()) * span + (x - x.min()) + 1  # ascending: raster order; a column to spare on either side
        links = []
        for dx, dy in offsets:
            want = key + dy * span + dx
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            here = np.flatnonzero(key[at] == want)
            links.append((here, at[here]))
        a, b = (np.concatenate(c) for c in zip(*links, strict=True))
        root = np.arange(len(key))
        while True:  # smallest root of either end, then shortcuts, until nothing moves
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while True:
                short = new[new]
                if (short == new).all():
                    break
                new = short
            if (new == root).all():
                break
            root = new
        pixels["root_y"], pixels["root_x"] = y[root], x[root]
        return pixels[["image_id", "x", "y", "root_y", "root_x"]]

    return run


def _at(x: str = "x", y: str = "y"):
    """A pixel's or component's place: a key that is never null, in raster order within an image."""
    return F.struct("image_id", F.col(y).alias("y"), F.col(x).alias("x"))


def roots(mask: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """(image_id, x, y, root_y, root_x) of every foreground pixel (v <> 0), once; the root is the component's first pixel in raster order."""
    offsets, scratch = _offsets(connectivity), Scratch(mask.sparkSession, "roots")
    pixels = mask.where("v <> 0 and x is not null and y is not null").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    in_tile = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "xy"]
    schema = f"image_id {pixels.schema['image_id'].dataType.simpleString()}, x int, y int, root_y int, root_x int"
    local = scratch.keep(pixels.groupBy("image_id", *in_tile).applyInPandas(_label_a_tile(offsets), schema), "local")
    away = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))
    border = local.where(" or ".join(f"pmod({c}, {tile}) in (0, {tile - 1})" for c in "xy"))
    ends = border.withColumn("d", F.explode(away)).withColumn("nx", F.col("x") + F.col("d.dx")).withColumn("ny", F.col("y") + F.col("d.dy"))
    crossing = " or ".join(f"floor({c} / {tile}) <> floor(n{c} / {tile})" for c in "xy")
    links = ends.where(crossing).select(_at("nx", "ny").alias("at"), _at("root_x", "root_y").alias("a")).join(border.select(_at().alias("at"), _at("root_x", "root_y").alias("b")), "at")
    joined = closure(links.select("a", "b"))
    whole = local.withColumn("node", _at("root_x", "root_y")).join(joined, "node", "left")
    return whole.select("image_id", "x", "y", F.coalesce("component.y", "root_y").alias("root_y"), F.coalesce("component.x", "root_x").alias("root_x"))


def connected_components(mask: DataFrame, connectivity: int = 8, min_area: int = 1, tile: int = TILE) -> DataFrame:
    """(image_id, x, y, label) of all pixels of the mask; components smaller than min_area become background."""
    found = Scratch(mask.sparkSession, "components").keep(roots(mask, connectivity, tile).withColumn("root", _at("root_x", "root_y")), "roots")
    kept = found.groupBy("root").agg(F.count("*").alias("area")).where(F.col("area") >= min_area)
    first = kept.select("root.*").withColumn("root", _at())
    names = with_positions(first, ["y", "x"], "image_id").select("root", (F.col("position") + 1).alias("label"))
    labelled = found.join(names, "root").select(_at().alias("at"), "label")
    pixels = mask.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return pixels.withColumn("at", _at()).join(labelled, "at", "left").select("image_id", "x", "y", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def component_stats(labels: DataFrame) -> DataFrame:
    """Area, inclusive bounding box and centroid of each label."""
    out = labels.where("label > 0").groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        (F.sum("x").cast("double") / F.count("*")).alias("centroid_x"), (F.sum("y").cast("double") / F.count("*")).alias("centroid_y"),
    )
    return out.withColumn("width", F.col("max_x") - F.col("min_x") + 1).withColumn("height", F.col("max_y") - F.col("min_y") + 1)


def label_at(labels: DataFrame, image_id, x: int, y: int) -> DataFrame:
    return labels.where(F.col("image_id").eqNullSafe(image_id) & (F.col("x") == x) & (F.col("y") == y)).select("label")


def hysteresis_threshold(plane: DataFrame, low: float, high: float, tile: int = TILE) -> DataFrame:
    """255 for pixels >= low that hang together (8-connected) with one >= high, else 0; bounds in either order."""
    low, high = min(low, high), max(low, high)
    pixels = plane.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "v").withColumn("at", _at())
    found = roots(pixels.select("image_id", "x", "y", F.when(F.col("v") >= F.lit(low), 1).otherwise(0).alias("v")), 8, tile)
    found = Scratch(plane.sparkSession, "hysteresis").keep(found.select(_at().alias("at"), _at("root_x", "root_y").alias("root")), "roots")
    strong = found.join(pixels.where(F.col("v") >= F.lit(high)).select("at"), "at").select("root").distinct()
    on = found.join(strong, "root", "left_semi").select("at", F.lit(255).alias("on"))
    return pixels.join(on, "at", "left").select("image_id", "x", "y", F.coalesce("on", F.lit(0)).alias("v"))


#: Fixed values of the label colours: multiplier, shift, and range of each channel.
MULTIPLIER, SHIFT, DARKEST, RANGE = 2654435761, 15, 60, 195


def colorize_labels(labels: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) by a hash of the label; the background is black."""
    h = (F.col("label") * F.lit(MULTIPLIER)).bitwiseAND(F.lit(0xFFFFFFFF))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, SHIFT))
    part = lambda k: F.when(F.col("label") == 0, 0).otherwise(DARKEST + F.floor(F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255)) * RANGE / 255)).cast("int")
    return labels.select("image_id", "x", "y", *(part(k).alias(n) for k, n in enumerate("rgb")))
