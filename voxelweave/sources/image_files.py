"""Grey and colour images in binary PGM and PPM files, packed one image a row."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.sources.stores import write_named_files

PACKED = "image_id string, width int, height int, channels int, data binary"


class ImageFileError(ValueError):
    """A file that is no such image, or an image that a format can't hold."""


def parse_pnm(raw: bytes) -> tuple[int, int, int, bytes]:
    """width, height, channels and samples scaled to 0..255 of a P5 or P6 file."""
    if raw[:2] not in (b"P5", b"P6"):
        raise ImageFileError("only binary PGM and PPM can be read")
    channels, at, numbers = (1 if raw[:2] == b"P5" else 3), 2, []
    while len(numbers) < 3:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 0x23):
            if raw[at] == 0x23:
                while at < len(raw) and raw[at] != 0x0A:
                    at += 1
            else:
                at += 1
        begin = at
        while at < len(raw) and 0x30 <= raw[at] <= 0x39:
            at += 1
        if begin == at:
            raise ImageFileError("the header needs three numbers")
        numbers.append(int(raw[begin:at]))
    width, height, most = numbers
    if width <= 0 or height <= 0 or not 0 < most <= 255:
        raise ImageFileError("a size or largest value out of range")
    if not raw[at : at + 1].isspace():
        raise ImageFileError("one white space ends the header")
    body = raw[at + 1 : at + 1 + width * height * channels]
    if len(body) < width * height * channels:
        raise ImageFileError("fewer samples than the header says")
    if most != 255:
        body = (np.frombuffer(body, np.uint8).astype(np.int64) * 255 // most).astype(np.uint8).tobytes()
    return width, height, channels, body


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """One packed row a file of the path; image_id is the file's name."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in source:
            rows = [(os.path.basename(n), *parse_pnm(bytes(c))) for n, c in zip(files["path"], files["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "channels", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PACKED)


def unpack(images: DataFrame) -> DataFrame:
    """Packed images in the long form (image_id, x, y, c, v)."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            for r in rows.itertuples():
                v = np.frombuffer(bytes(r.data), np.uint8)
                k = np.arange(len(v))
                yield pd.DataFrame({"image_id": r.image_id, "x": (k // r.channels % r.width).astype(np.int32), "y": (k // (r.channels * r.width)).astype(np.int32), "c": (k % r.channels).astype(np.int32), "v": v.astype(np.int16)})

    return images.mapInPandas(run, "image_id string, x int, y int, c int, v smallint")


def pack(pixels: DataFrame) -> DataFrame:
    """The long form (image_id, x, y, v, and c for colour) in packed rows; one image is one group, as a file is."""
    pixels = pixels if "c" in pixels.columns else pixels.withColumn("c", F.lit(0))

    def run(image: pd.DataFrame) -> pd.DataFrame:
        w, h, c = int(image["x"].max()) + 1, int(image["y"].max()) + 1, int(image["c"].max()) + 1
        data = np.zeros((h, w, c), np.uint8)
        data[image["y"], image["x"], image["c"]] = image["v"]
        return pd.DataFrame([(image["image_id"].iloc[0], w, h, c, data.tobytes())], columns=["image_id", "width", "height", "channels", "data"])

    return pixels.select(F.col("image_id").cast("string").alias("image_id"), "x", "y", "c", "v").groupBy("image_id").applyInPandas(run, PACKED)


def format_pgm(width: int, height: int, channels: int, data: bytes) -> bytes:
    if channels != 1:
        raise ImageFileError("PGM holds one channel")
    return f"P5\n{width} {height}\n255\n".encode() + data


def format_ppm(width: int, height: int, channels: int, data: bytes) -> bytes:
    if channels not in (1, 3):
        raise ImageFileError("PPM holds three channels, or one repeated")
    body = data if channels == 3 else np.repeat(np.frombuffer(data, np.uint8), 3).tobytes()
    return f"P6\n{width} {height}\n255\n".encode() + body


def _write(images: DataFrame, folder: str, extension: str, form) -> None:
    """One image is one file; tasks write them and the driver commits."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            files = [(f"{os.path.splitext(os.path.basename(r.image_id))[0]}{extension}", form(r.width, r.height, r.channels, bytes(r.data))) for r in rows.itertuples()]
            yield pd.DataFrame(files, columns=["name", "content"])

    write_named_files(images.mapInPandas(run, "name string, content binary"), folder)


def write_pgm(images: DataFrame, folder: str) -> None:
    """A file for each packed image, named by its image_id."""
    _write(images, folder, ".pgm", format_pgm)


def write_ppm(images: DataFrame, folder: str) -> None:
    _write(images, folder, ".ppm", format_ppm)
