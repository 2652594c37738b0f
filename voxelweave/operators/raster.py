"""Raster operators on the long form (image_id, x, y, v); colour images have c as well.

Stencils work on tiles of TILE x TILE pixels with a halo: a pixel goes to its own tile and, within the halo's width of a
seam, to the neighbour's. That is the only shuffle, whatever the kernel's length and however many steps follow each
other (`ridges`); within a tile numpy works on arrays, with the image's border replicated. An image may have any size.

Of a repeated pixel the smallest value counts, and it comes out once; pixels without x or y go; a null in an image of
doubles makes null what it reaches. Missing pixels, and nulls in an image of whole numbers, are errors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512


class RasterError(ValueError):
    """An argument outside an operator's domain."""


def image_check(image: DataFrame) -> DataFrame:
    """Size, channels and soundness of each 8-bit image: every pixel there once, 1 to 4 channels, samples of 0 to 255."""
    image = image if "c" in image.columns else image.withColumn("c", F.lit(0))
    pixels = image.groupBy("image_id", "x", "y", "c").agg(F.count("*").alias("n"), F.max(F.coalesce(~F.col("v").between(0, 255), F.lit(True))).alias("bad"))
    size = pixels.groupBy("image_id").agg(*((F.max(k) + 1).cast("long").alias(n) for k, n in zip("xyc", ("width", "height", "channels"), strict=True)), F.count("*").alias("m"), F.max("n").alias("n"), F.max("bad").alias("bad"), F.min(F.least("x", "y", "c")).alias("least"))
    sound = ~F.col("bad") & (F.col("n") == 1) & (F.col("least") >= 0) & (F.col("channels") <= 4) & (F.col("m") == F.col("width") * F.col("height") * F.col("channels"))
    return size.select("image_id", "width", "height", "channels", F.coalesce(sound, F.lit(False)).alias("sound"))


def require_image8(image: DataFrame) -> DataFrame:
    """The image as it is; images that aren't sound are an error."""
    wrong = image_check(image).where("not sound").first()
    if wrong is not None:
        raise RasterError(f"image {wrong['image_id']} has missing, repeated or wrong samples")
    return image


def to_float(image: DataFrame, channel: int = 0) -> DataFrame:
    """One channel of a colour image as (image_id, x, y, v)."""
    if channel < 0 or channel > 3:
        raise RasterError("no such channel")
    return image.where(F.col("c") == channel).select("image_id", "x", "y", F.col("v").cast("double").alias("v"))


def to_image8(plane: DataFrame) -> DataFrame:
    """Rounded half up and clamped to 0..255."""
    return plane.withColumn("v", F.floor(F.least(F.greatest(F.col("v").cast("double") + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int"))


def to_grayscale(image: DataFrame) -> DataFrame:
    """Luma of three channels, rounded half up; a single channel passes through."""
    wide = image.groupBy("image_id", "x", "y").agg(*(F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")))
    luma = F.floor(F.col("r") * F.lit(0.299) + F.col("g") * F.lit(0.587) + F.col("b") * F.lit(0.114) + F.lit(0.5))
    return wide.select("image_id", "x", "y", F.when(F.col("g").isNull(), F.col("r")).otherwise(F.least(F.greatest(luma, F.lit(0)), F.lit(255))).cast("int").alias("v"))


def normalize_to_image8(plane: DataFrame) -> DataFrame:
    """Smallest to 0, largest to 255; a constant image to 0. The extremes are one small row an image."""
    ends = plane.groupBy("image_id").agg(F.min(F.col("v").cast("double")).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))
    scaled = F.floor((F.col("v").cast("double") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")) + 0.5)
    return plane.join(ends, "image_id").select("image_id", "x", "y", F.when(F.col("hi") > F.col("lo"), scaled).otherwise(0).cast("int").alias("v"))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights out to ceil(3 sigma), at least 1, with sum 1."""
    if not sigma > 0:
        raise RasterError("sigma must be positive")
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


# --- tiles -------------------------------------------------------------------------------------------------


def _dense(pixels: pa.Table, columns: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Rows of the pixels in raster order, each once; their places; and a dense array a column."""
    x, y = (pixels[k].to_numpy() for k in "xy")
    values = {c: pixels[c].to_numpy() for c in columns}
    if whole and any(pixels[c].null_count for c in columns):
        raise RasterError("an image of whole numbers has null samples")
    order = np.lexsort((values[columns[0]], x, y))
    x, y = x[order], y[order]
    once = np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]
    rows, x, y = order[once], x[once], y[once]
    shape = int(y[-1] - y[0]) + 1, int(x.max() - x.min()) + 1
    if len(rows) != shape[0] * shape[1]:
        raise RasterError("an image has missing pixels")
    return rows, x, y, {c: v[rows].reshape(shape) for c, v in values.items()}


def _stencil(plane: DataFrame, columns: list[str], halo: tuple[int, int], run: Callable, out: dict[str, str], tile: int) -> DataFrame:
    """run(arrays by column) -> arrays by name of `out`, over each tile with its halo (along x, along y)."""
    whole = all(plane.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in columns)
    kinds = {c: "long" if whole else "double" for c in columns}
    at = {k: F.explode(F.sequence(F.floor((F.col(k) - h) / tile).cast("int"), F.floor((F.col(k) + h) / tile).cast("int"))) for k, h in zip("xy", halo, strict=True)}
    pixels = plane.select("image_id", *(F.col(k).cast("int").alias(k) for k in "xy"), *(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    types = {"long": pa.int64(), "double": pa.float64()}
    out = {n: ("long" if whole else "double") if t == "same" else t for n, t in out.items()}

    def in_tile(key: tuple, pixels: pa.Table) -> pa.Table:
        rows, x, y, arrays = _dense(pixels, columns, whole)
        own = (x // tile == key[1].as_py()) & (y // tile == key[2].as_py())
        made = run(arrays)
        results = {n: pa.array(made[n].ravel()[own], types[t], from_pandas=True) for n, t in out.items()}
        return pa.table({"image_id": pixels["image_id"].take(pa.array(rows[own])), "x": pa.array(x[own], pa.int32()), "y": pa.array(y[own], pa.int32())} | results)

    schema = f"image_id {plane.schema['image_id'].dataType.simpleString()}, x int, y int, {', '.join(f'{n} {t}' for n, t in out.items())}"
    tiles = pixels.withColumn("tile_x", at["x"]).withColumn("tile_y", at["y"])
    return tiles.groupBy("image_id", "tile_x", "tile_y").applyInArrow(in_tile, schema)


def _shifted(v: np.ndarray, reach: int, axis: int) -> list[np.ndarray]:
    """v at -reach .. reach along an axis, the border replicated."""
    wide = np.pad(v, [(reach, reach) if a == axis else (0, 0) for a in range(2)], mode="edge")
    n = v.shape[axis]
    return [wide[k : k + n] if axis == 0 else wide[:, k : k + n] for k in range(2 * reach + 1)]


def _correlated(v: np.ndarray, kernel: Sequence[float], axis: int) -> np.ndarray:
    total = None
    for w, tap in zip(kernel, _shifted(v, len(kernel) // 2, axis), strict=True):
        total = tap * w if total is None else total + tap * w
    return total


def _gradient(v: np.ndarray) -> dict[str, np.ndarray]:
    left, mid, right = _shifted(v, 1, 1)
    d, s = _shifted(right - left, 1, 0), _shifted(left + mid * 2 + right, 1, 0)
    gx, gy = d[0] + d[1] * 2 + d[2], s[2] - s[0]
    return {"gx": gx, "gy": gy, "magnitude": np.sqrt((gx * gx + gy * gy).astype(float))}


#: Fixed value: the tangent of 67.5 degrees, where one of four directions ends.
STEEP = 2.414214


def _ridge(gx: np.ndarray, gy: np.ndarray, m: np.ndarray) -> np.ndarray:
    """m where it is above the neighbour before and not below the one after, along the gradient's direction."""
    near = [_shifted(r, 1, 1) for r in _shifted(m, 1, 0)]  # rows above, own and below; left, own and right
    ax, ay = np.abs(gx).astype(float), np.abs(gy).astype(float)
    which = [ax >= STEEP * ay, ay >= STEEP * ax, (gx > 0) == (gy > 0)]
    before = np.select(which, [near[1][0], near[0][1], near[0][0]], near[2][0])
    after = np.select(which, [near[1][2], near[2][1], near[2][2]], near[0][2])
    return np.where((m > 0) & (m > before) & (m >= after), m, 0.0)


# --- stencils ----------------------------------------------------------------------------------------------


def convolve(plane: DataFrame, rows: Sequence[float] = (1,), columns: Sequence[float] = (1,), tile: int = TILE) -> DataFrame:
    """Correlation along x with `rows`, then along y with `columns`. Whole-number kernels on whole-number images stay whole numbers."""
    if len(rows) % 2 == 0 or len(columns) % 2 == 0:
        raise RasterError("a kernel has an odd length")
    rows, columns = list(rows), list(columns)
    if not all(isinstance(w, int) for w in [*rows, *columns]):
        plane = plane.withColumn("v", F.col("v").cast("double"))
    return _stencil(plane, ["v"], (len(rows) // 2, len(columns) // 2), lambda a: {"v": _correlated(_correlated(a["v"], rows, 1), columns, 0)}, {"v": "same"}, tile)


def convolve_rows(plane: DataFrame, kernel: Sequence[float], tile: int = TILE) -> DataFrame:
    return convolve(plane, kernel, tile=tile)


def convolve_columns(plane: DataFrame, kernel: Sequence[float], tile: int = TILE) -> DataFrame:
    return convolve(plane, columns=kernel, tile=tile)


def gaussian_blur(plane: DataFrame, sigma: float, tile: int = TILE) -> DataFrame:
    kernel = gaussian_kernel(sigma)
    return convolve(plane, kernel, kernel, tile)


def sobel(plane: DataFrame, tile: int = TILE) -> DataFrame:
    """gx, gy and magnitude from 3x3 neighbourhoods: a row pass for differences and sums, a column pass over both."""
    return _stencil(plane, ["v"], (1, 1), lambda a: _gradient(a["v"]), {"gx": "same", "gy": "same", "magnitude": "double"}, tile)


def non_maximum_suppression(gradient: DataFrame, tile: int = TILE) -> DataFrame:
    """The magnitude where it is a ridge: above the neighbour before and not below the one after, along the gradient's direction."""
    return _stencil(gradient, ["magnitude", "gx", "gy"], (1, 1), lambda a: {"v": _ridge(a["gx"], a["gy"], a["magnitude"])}, {"v": "double"}, tile)


def ridges(plane: DataFrame, kernel: Sequence[float], tile: int = TILE) -> DataFrame:
    """Correlation with a kernel along x and y, gradient and non-maximum suppression in one shuffle, with a halo as wide as all need: what these give one after another."""
    kernel = list(kernel)
    if len(kernel) % 2 == 0:
        raise RasterError("a kernel has an odd length")
    if not all(isinstance(w, int) for w in kernel):
        plane = plane.withColumn("v", F.col("v").cast("double"))

    def run(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g = _gradient(_correlated(_correlated(arrays["v"], kernel, 1), kernel, 0))
        return {"v": _ridge(g["gx"], g["gy"], g["magnitude"])}

    wide = len(kernel) // 2 + 2
    return _stencil(plane, ["v"], (wide, wide), run, {"v": "double"}, tile)


def threshold(plane: DataFrame, at: float, keep_above: bool = True) -> DataFrame:
    """255 where v >= at, else 0; the other way round without keep_above."""
    above = F.col("v") >= F.lit(at)
    return plane.select("image_id", "x", "y", F.when(above if keep_above else ~above, 255).otherwise(0).alias("v"))
