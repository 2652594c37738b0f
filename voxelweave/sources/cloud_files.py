"""Point clouds in ASCII PLY and PCD files.

A file is read as lines in byte ranges, by as many tasks as it has ranges: each begins behind a line's end, numbers its
own rows, and prefix sums of the ranges' counts give every row its place in the file, which is its point_id. The
header, which has to end in the first HEADER bytes, is read from the lines at a file's beginning. Rows are parsed once,
into a table in the shared folder; columns other than x, y and z go.

A file is written by one task, in order of point_id, as it is one stream; several clouds are several tasks' work. Rows are
sorted and joined to chunks of up to CHUNK lines by many tasks before, so the one that writes sorts a row a chunk.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.session import Scratch
from voxelweave.sources.stores import write_text_files

HEADER = 1 << 16  # bytes of a file by which its header has ended
CHUNK = 20_000  # lines of a file in one row on its way


class CloudFileError(ValueError):
    """A file or name that is not a cloud."""


def _columns(names: list[str]) -> list[int]:
    try:
        return [names.index(k) for k in "xyz"]
    except ValueError:
        raise CloudFileError("a cloud needs x, y and z") from None


def _values(line: str) -> list[float] | None:
    """The numbers that a line begins with; None for a line that is no row: blank, without a number, or not a number."""
    values: list[float] = []
    for token in line.split():
        try:
            values.append(float(token))
        except ValueError:
            break
    return values if values and values[0] == values[0] else None


def _rows(lines: list[str], count: int, names: list[str]) -> np.ndarray:
    """The first `count` lines that begin with a number; each needs a value for every column."""
    at, out = _columns(names), []
    for line in lines:
        if len(out) == count:
            break
        values = _values(line)
        if values is None:
            continue
        if len(values) < len(names):
            raise CloudFileError(SHORT_ROW)
        out.append([values[k] for k in at])
    if len(out) < count:
        raise CloudFileError(FEW_ROWS)
    return np.array(out, np.float32).reshape(-1, 3)


SHORT_ROW, FEW_ROWS = "a row has fewer values than columns", "fewer rows than the header says"


def _count(token: str) -> int:
    if not token.isdigit():
        raise CloudFileError("a count is a whole number")
    return int(token)


def ply_header(lines: list[str]) -> tuple[int, list[str], int]:
    """Rows, names of columns, and lines up to the header's end."""
    if not lines or (lines[0].split() or [""])[0] != "ply":
        raise CloudFileError("not a PLY file")
    count, names, inside = 0, [], False
    for k, line in enumerate(lines[1:], 1):
        words = line.split()
        head = words[0].lower() if words else ""
        if head == "format" and (len(words) < 2 or words[1].lower() != "ascii"):
            raise CloudFileError("only ASCII PLY can be read")
        if head == "element" and len(words) >= 3:
            inside = words[1].lower() == "vertex"
            count = _count(words[2]) if inside else count
        elif head == "property" and inside:
            if len(words) >= 2 and words[1].lower() == "list":
                raise CloudFileError("vertices can't hold lists")
            names.append(words[-1].lower())
        elif head == "end_header":
            return count, names, k + 1
    raise CloudFileError("the header has no end")


def pcd_header(lines: list[str]) -> tuple[int, list[str], int]:
    """Rows, names of columns, and lines up to the header's end."""
    names, points, width, height = [], None, 0, 1
    for k, line in enumerate(lines):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        head, rest = words[0].lower(), words[1:]
        if head == "fields":
            names = [w.lower() for w in rest]
        elif head == "count" and any(w != "1" for w in rest):
            raise CloudFileError("fields have one value each")
        elif head in ("points", "width", "height"):
            n = _count(rest[0] if rest else "")
            points, width, height = (n if head == "points" else points), (n if head == "width" else width), (n if head == "height" else height)
        elif head == "data":
            if not rest or rest[0].lower() != "ascii":
                raise CloudFileError("only ASCII PCD can be read")
            return width * height if points is None else points, names, k + 1
    raise CloudFileError("the header has no DATA line")


def _parse(text: str, header) -> np.ndarray:
    lines = text.splitlines()
    count, names, end = header(lines)
    return _rows(lines[end:], count, names)


def parse_ply(text: str) -> np.ndarray:
    """A whole file at once."""
    return _parse(text, ply_header)


def parse_pcd(text: str) -> np.ndarray:
    return _parse(text, pcd_header)


_HEADERS = {".ply": ply_header, ".pcd": pcd_header}


def _extension(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def _parse_lines(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, range) of each range in order, to rows (file, range, line, nth, numbers, text).

    line: place in the range; nth: rows before it there; numbers: of a row; text: of lines where a header may be.
    """
    key, line, nth, seen = None, 0, 0, 0
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.string()]
    for batch in source:
        out = []
        for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (file, start):
                key, line, nth, seen = (file, start), 0, 0, start
            numbers, text = _values(value), value if seen < HEADER else None
            if numbers is not None or text is not None:
                out.append((file, start, line, nth, numbers, text))
            line, nth, seen = line + 1, nth + (numbers is not None), seen + len(value) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "range", "line", "nth", "numbers", "text"])


_HEAD = "file string, wrong string, n long, width int, ax int, ay int, az int, last_range long, last_line long"


def _header_of(header):
    def run(lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values(["range", "line"])  # at most HEADER bytes
        file = lines["file"].iloc[0]
        try:
            count, names, end = header(lines["text"].tolist())
            last = lines.iloc[end - 1]
            row = (file, None, count, len(names), *_columns(names), last["range"], last["line"])
        except CloudFileError as e:
            row = (file, f"{os.path.basename(file)}: {e}", 0, 0, 0, 0, 0, 0, 0)
        return pd.DataFrame([row], columns=[c.split()[0] for c in _HEAD.split(", ")])

    return run


def _wrong(rows: DataFrame) -> None:
    """Raise what a row of `wrong` says, if any does."""
    if found := rows.where("wrong is not null").select("wrong").take(1):
        raise CloudFileError(found[0]["wrong"])


def _read(spark: SparkSession, path: str, header) -> DataFrame:
    scratch = Scratch(spark, "cloud-lines")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))
    parsed = scratch.keep(lines.mapInArrow(_parse_lines, "file string, range long, line long, nth long, numbers array<float>, text string"), "lines")
    heads = scratch.keep(parsed.where("text is not null").select("file", "range", "line", "text").groupBy("file").applyInPandas(_header_of(header), _HEAD), "headers")
    _wrong(heads)
    if heads.count() < len(lines.inputFiles()):  # the names that Spark has listed
        raise CloudFileError("an empty file is no cloud")
    body = parsed.where("numbers is not null").drop("text").join(heads.drop("wrong"), "file").where("range > last_range or (range = last_range and line > last_line)")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = scratch.keep(body.groupBy("file", "range").agg(F.count("*").alias("c"), F.min("nth").alias("first")), "counts")
    bases = counts.select("file", "range", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    _wrong(heads.join(counts.groupBy("file").agg(F.sum("c").alias("c")), "file", "left").where(F.coalesce("c", F.lit(0)) < F.col("n")).select(F.concat("file", F.lit(f": {FEW_ROWS}")).alias("wrong")))
    rows = body.join(bases, ["file", "range"]).withColumn("point_id", F.col("base") + F.col("nth") - F.col("first")).where("point_id < n")
    _wrong(rows.where(F.size("numbers") < F.col("width")).select(F.concat("file", F.lit(f": {SHORT_ROW}")).alias("wrong")))
    name = F.udf(lambda f: unquote(os.path.basename(f)), "string")
    named = heads.select("file", name("file").alias("cloud_id"))  # one row a file
    return rows.join(named, "file").select("cloud_id", "point_id", *(F.element_at("numbers", F.col(f"a{k}") + 1).alias(k) for k in "xyz"))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(cloud_id, point_id, x, y, z) of one file or a folder of files; cloud_id is the file's name."""
    return _read(spark, path, ply_header)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, pcd_header)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """By the extension, in any case: .ply, .pcd, and .parquet."""
    extension = _extension(path)
    if extension == ".parquet":
        return spark.read.parquet(path)
    if extension not in _HEADERS:
        raise CloudFileError(f"no reader for {extension or 'a name without extension'}")
    return _read(spark, path, _HEADERS[extension])


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, point_id, x, y, z) to (name, point_id, chunk, value): lines of up to CHUNK rows of a name, and the first one's id."""
    part, key, lines, chunk = TaskContext.get().partitionId() << 32, None, [], 0

    def full() -> pa.RecordBatch:
        columns = zip((*key, part + chunk, "\n".join(lines)), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in columns], names=["name", "point_id", "chunk", "value"])

    for batch in source:
        for name, point, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lines and (name != key[0] or len(lines) >= CHUNK):
                yield full()
                lines, chunk = [], chunk + 1
            if not lines:
                key = (name, point)
            lines.append(" ".join(f"{v:.9g}" for v in place))
    if lines:
        yield full()


#: Headers as SQL strings with %d for the number of points.
_PLY = "ply\nformat ascii 1.0\ncomment one vertex a line\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nend_header"
_PCD = "# one point a line\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH %1$d\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS %1$d\nDATA ascii"


def _write(points: DataFrame, counts: DataFrame, folder: str, header: str) -> None:
    """points (name, point_id, x, y, z) and counts (name, n) to a file a name, in order of point_id."""
    rows = points.select("name", F.col("point_id").cast("long").alias("point_id"), *(F.col(c).cast("float").alias(c) for c in "xyz"))
    width = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(width, "name", "point_id").sortWithinPartitions("name", "point_id")
    body = ordered.mapInArrow(_chunks, "name string, point_id long, chunk long, value string").withColumn("body", F.lit(True))
    heads = counts.select("name", F.lit(None).cast("long").alias("point_id"), F.lit(None).cast("long").alias("chunk"), F.format_string(header, "n").alias("value"), F.lit(False).alias("body"))
    write_text_files(heads.unionByName(body), folder, ["body", "point_id", "chunk"])


def write_clouds(points: DataFrame, folder: str, extension: str = ".ply") -> None:
    """A file for each cloud_id of (cloud_id, point_id, x, y, z), named by it; its own extension goes."""
    if extension not in _HEADERS:
        raise CloudFileError(f"no writer for {extension}")
    named = points.withColumn("name", F.concat(F.regexp_replace(F.coalesce(F.col("cloud_id").cast("string"), F.lit("null")), r"\.[^.]*$", ""), F.lit(extension)))
    _write(named, named.groupBy("name").agg(F.count("*").alias("n")), folder, _PLY if extension == ".ply" else _PCD)


def _write_one(points: DataFrame, path: str, header: str) -> None:
    name = F.lit(os.path.basename(path))
    _write(points.withColumn("name", name), points.agg(F.count("*").alias("n")).select(name.alias("name"), "n"), os.path.dirname(path) or ".", header)


def write_ply(points: DataFrame, path: str) -> None:
    _write_one(points, path, _PLY)


def write_pcd(points: DataFrame, path: str) -> None:
    _write_one(points, path, _PCD)


def write_cloud(points: DataFrame, path: str) -> None:
    """By the extension: .ply, .pcd, and .parquet, which is written in parallel."""
    extension = _extension(path)
    if extension == ".parquet":
        points.write.parquet(path)
    elif extension == ".ply":
        write_ply(points, path)
    elif extension == ".pcd":
        write_pcd(points, path)
    else:
        raise CloudFileError(f"no writer for {extension or 'a name without extension'}")
