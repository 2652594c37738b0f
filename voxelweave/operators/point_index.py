"""A stored index of a point cloud: k-d boxes over all of space, and the points by box.

Top boxes are median splits of a bounded sample of the cloud (about SAMPLE points). A top box of more than BIG points
gets a tree of its own, fitted in one task from a bounded sample of its points, so boxes keep about BOX points however
large the cloud is; those trees are rows of a table and meet points and queries in a stream, tree first, with the rows
of a box split between tasks. A box's number is LOW times its top box's, plus its number within it.

`PointIndex.build(points, path)` writes an index once: trees, and points in files that follow the boxes, in folders of
about FOLDER points of neighbouring boxes. `PointIndex.load` opens it, and joins read only folders that their balls touch.

Rows with a null id or a null or not-a-number coordinate are not indexed; equal ids and repeated rows are points of their
own; an empty cloud has one empty box. With `same`, of points in one place only those of the smallest ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.operators.boxes import TREE, Boxes
from voxelweave.session import delete, new_path

SAMPLE = 65_536  # points that a tree is cut by, about
BOX = 1000  # points in a box, about
BIG = 200_000  # points of a top box beyond which it is cut further; rows of such a box in one stream
FOLDER, MOST_FOLDERS = 1_000_000, 1024  # points in a folder of a stored index, about; folders
LEAST = 33  # points that boxes of a stored index hold at least, by its samples: k nearest up to one less
MEMBERS = 512  # ids of a place in one list
LOW = 1 << 20
XYZ = ["x", "y", "z"]


def clean(df: DataFrame, name: str, *further: str) -> DataFrame:
    """(name, x, y, z, further columns) of rows that can take part: an id, and coordinates that are numbers."""
    out = df.select(F.col(name).cast("long").alias(name), *(F.col(c).cast("double").alias(c) for c in XYZ), *further)
    return out.where(" and ".join([f"{name} is not null", *(f"{c} is not null and not isnan({c})" for c in XYZ)]))


def places(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy() for c in XYZ]).reshape(-1, 3)


def _sample(points: DataFrame, n: int) -> DataFrame:
    """About SAMPLE of n points by a hash of their rows, or all."""
    return points if n <= SAMPLE else points.where(F.pmod(F.xxhash64("point_id", *XYZ), F.lit(1 << 40)) < F.lit(int(SAMPLE / n * (1 << 40))))


def first_of_place(points: DataFrame, most: int, *within: str) -> DataFrame:
    """Of points in one place those of the `most` smallest ids; every task leaves out the rest before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*within, *XYZ).orderBy("point_id"))
    return points.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _gather(source: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to their places, the ids of each in lists of at most `most`; `name` is the first of them."""
    for batch in source:
        keys = np.column_stack([batch[c].to_numpy() for c in batch.schema.names if c != name])
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        first = np.flatnonzero(new)
        new |= (np.arange(len(keys)) - first[np.cumsum(new) - 1]) % most == 0
        first = np.flatnonzero(new)
        ids = pa.ListArray.from_arrays(pa.array([*first, len(keys)], pa.int32()), batch[name])
        rows = batch.take(pa.array(first, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*batch.schema.names, "ids"])


def gathered(points: DataFrame, name: str, *within: str) -> DataFrame:
    """(name, x, y, z, within, ids): places and the ids there, in lists of at most MEMBERS, the first of which is `name`.

    Rows are sorted by ranges of place and id, so a place of very many rows is several tasks' work.
    """
    width, order = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*within, *XYZ, name]
    rows = points.select(name, *XYZ, *within)
    rows = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(partial(_gather, name=name, most=MEMBERS), f"{_schema(rows)}, ids array<long>")


def boxes_of(points: DataFrame, least: int = 1) -> tuple[Boxes, int]:
    """Boxes of about BOX points each, and of `least` or more of the sample; how many points there are."""
    points = clean(points, "point_id")
    n = points.count()
    x = places(_sample(points, n).select(*XYZ).toArrow())  # about SAMPLE rows
    return Boxes.fit(x, max(1, round(len(x) * BOX / max(n, 1))), least), n


def columns_of(kinds: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in kinds.items())


def _schema(df: DataFrame) -> str:
    return columns_of({f.name: f.dataType.simpleString() for f in df.schema})


# --- rows to boxes -----------------------------------------------------------------------------------------


def _with_box(tree: Boxes, batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """Rows with a reach once for each box that their ball touches; others with the box that they are in, and their room there."""
    x = places(batch)
    if "reach" in batch.schema.names:
        rows, box = tree.touched(x, batch["reach"].to_numpy())
        batch = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(box, pa.int64())], names=[*batch.schema.names, name])
    box = tree.of(x)
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"room": pa.array(tree.room(x, box), pa.float64()), name: pa.array(box, pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _top(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in source:
        yield _with_box(shared.value, batch, "top")


def _low(source: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (top, salt), the tree of each first, to boxes of that tree."""
    tree = None
    for batch in source:
        key = np.column_stack([batch["top"].to_numpy(), batch["salt"].to_numpy()])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a and batch["axis"][a].is_valid:
                tree, a = Boxes.read({k: batch[k][a].values.to_numpy() for k in TREE}), a + 1
            if b > a:
                yield _with_box(tree, batch.slice(a, b - a).select(columns), "low")


def _fit_low(sample: pa.Table, shared, box: int, least: int) -> pa.Table:
    """A tree for one top box, from a sample of its points."""
    top, n = sample["top"][0].as_py(), sample["n"][0].as_py()
    x, outer = places(sample), shared.value
    tree = Boxes.fit(x, max(1, round(len(x) * box / n)), least, (outer.low[top], outer.high[top]))
    return pa.table({"top": pa.array([top], pa.int64())} | {k: pa.array([v], pa.list_(pa.int64() if "long" in TREE[k] else pa.float64())) for k, v in tree.columns().items()})


_POINT = "point_id long, x double, y double, z double"
_FACTS = TREE | {"big": "array<long>", "n": "long", "least": "long", "same": "long", "folders": "long"}


class PointIndex:
    """Trees and boxed points under a path. `big` are the top boxes with a tree of their own, `n` the points."""

    def __init__(self, spark: SparkSession, path: str, top: Boxes, big: list[int], n: int, least: int, same: int | None, folders: int):
        self.spark, self.path, self.top, self.big, self.n, self.least, self.same, self.folders = spark, path, top, big, n, least, same, folders
        self.shared = spark.sparkContext.broadcast(top)  # one tree, bounded by SAMPLE
        self.width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- built and loaded

    @classmethod
    def build(cls, points: DataFrame, path: str | None = None, least: int = LEAST, same: int | None = None) -> PointIndex:
        """An index under `path`, for good; without one in the shared folder, in no order, for joins that follow.

        least: points of the sample that each box holds at least, so k nearest may be asked for with k < least.
        """
        spark, stored = points.sparkSession, path is not None
        path = path or new_path(spark, "index")
        p = clean(points, "point_id")
        if same:
            p = first_of_place(p, same)
        p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "point_id", *XYZ).write.parquet(f"{path}/plain")  # however few files it came in
        p = spark.read.schema(_POINT).parquet(f"{path}/plain")
        top, n = boxes_of(p, least)
        folders = max(1, min(MOST_FOLDERS, len(top.low), n // FOLDER)) if stored else 1
        self = cls(spark, path, top, [], n, least, same, folders)
        kinds = f"{_POINT}, room double, top long"
        boxed = p.mapInArrow(partial(_top, shared=self.shared), kinds)
        if n > BIG:
            boxed.write.parquet(f"{path}/boxed")  # what counts, samples and sorts them descends the tree no more
            boxed = spark.read.schema(kinds).parquet(f"{path}/boxed")
            self._cut_further(boxed)
        leaved = self._descend(boxed, "point_id").drop("room").withColumn("folder", self._folder())
        if stored:
            leaved = leaved.repartitionByRange(max(self.width, folders), "leaf", "point_id").sortWithinPartitions("leaf", "point_id")
        leaved.write.partitionBy(*["folder"] * (folders > 1)).parquet(f"{path}/points")
        facts = top.columns() | {"big": self.big, "n": n, "least": least, "same": same or 0, "folders": folders}
        spark.createDataFrame([tuple(facts[k] for k in _FACTS)], columns_of(_FACTS)).write.parquet(f"{path}/top")  # last: an index is there once it is whole
        for table in ("plain", "boxed"):
            delete(spark, f"{path}/{table}")
        return self

    def _cut_further(self, boxed: DataFrame) -> None:
        """Trees for top boxes of more than BIG points, each from about SAMPLE of its points."""
        big = boxed.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") > BIG)
        self.big = sorted(r["top"] for r in big.select("top").collect())  # top boxes: bounded by SAMPLE
        if self.big:
            draw = F.pmod(F.xxhash64("point_id", *XYZ, F.lit("low")), F.lit(1 << 40)) < F.lit(float(SAMPLE << 40)) / F.col("n")
            some = boxed.join(F.broadcast(big), "top").where(draw).select("top", "n", *XYZ)
            shared, box, least = self.shared, BOX, self.least

            def fit(sample: pa.Table) -> pa.Table:
                return _fit_low(sample, shared, box, least)

            some.groupBy("top").applyInArrow(fit, f"top long, {columns_of(TREE)}").write.parquet(f"{self.path}/lower")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PointIndex:
        """An index that build() has written under path."""
        row = spark.read.schema(columns_of(_FACTS)).parquet(f"{path}/top").first()
        return cls(spark, path, Boxes.read(row.asDict()), list(row["big"]), row["n"], row["least"], row["same"] or None, row["folders"])

    @property
    def points(self) -> DataFrame:
        """(point_id, x, y, z, leaf, folder)."""
        return self.spark.read.schema(f"{_POINT}, leaf long, folder int").parquet(f"{self.path}/points")

    # --- queries

    def _folder(self):
        return F.floor(F.floor(F.col("leaf") / LOW) * self.folders / len(self.top.low)).cast("int")

    def _descend(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows with a top box to rows with a leaf: those of big top boxes meet their trees."""
        columns = [c for c in rows.columns if c != "top"]
        plain = rows.select(*columns, (F.col("top") * LOW).alias("leaf"))
        if not self.big:
            return plain
        plain, deep = plain.where(~(F.col("leaf") / LOW).isin(self.big)), rows.where(F.col("top").isin(self.big))
        salts = F.broadcast(deep.groupBy("top").agg(F.ceil(F.count("*") / BIG).cast("int").alias("salts")))  # top boxes: bounded by SAMPLE
        trees = self.spark.read.schema(f"top long, {columns_of(TREE)}").parquet(f"{self.path}/lower")
        heads = trees.join(salts, "top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        salted = deep.join(salts, "top").withColumn("salt", F.pmod(F.xxhash64(name), F.col("salts")).cast("int")).drop("salts")
        keys = ["top", "salt", F.col("axis").isNull().alias("second")]
        both = heads.unionByName(salted, allowMissingColumns=True).select(*keys, *columns, *(k for k in TREE))
        met = both.repartition(self.width, "top", "salt").sortWithinPartitions("top", "salt", "second").mapInArrow(partial(_low, columns=[*columns, "top"]), self._low_schema(rows, columns))
        return plain.unionByName(met.select(*columns, (F.col("top") * LOW + F.col("low")).alias("leaf")))

    @staticmethod
    def _low_schema(rows: DataFrame, columns: list[str]) -> str:
        return f"{_schema(rows.select(*columns, 'top'))}, low long"

    def home(self, queries: DataFrame, name: str = "query_id", *further: str) -> DataFrame:
        """(query_id, x, y, z, further columns, room, leaf): each query's own box, and how far its nearest face is."""
        q = self._spread(clean(queries, name, *further), name)
        return self._descend(q.mapInArrow(partial(_top, shared=self.shared), f"{_schema(q)}, room double, top long"), name)

    def touched(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, x, y, z, reach, further columns) once for each box (leaf) that their ball touches."""
        return self._descend(self._spread(queries).mapInArrow(partial(_top, shared=self.shared), f"{_schema(queries)}, top long"), "query_id")

    def _spread(self, queries: DataFrame, name: str = "query_id") -> DataFrame:
        """Queries are little data and much work: a small file or a shuffle that Spark has merged would be one task."""
        return queries.repartition(self.width, name, *XYZ)

    def folders_of(self, leaves: DataFrame) -> set[int]:
        """The folders that hold some of a (written) table's leaves."""
        return {r[0] for r in leaves.select(self._folder()).distinct().collect()} if self.folders > 1 else {0}  # at most MOST_FOLDERS

    def read(self, leaves: DataFrame | None = None) -> DataFrame:
        """(point_id, x, y, z, leaf); with a (written) table of leaves only from folders that hold some of them."""
        return self.read_folders(self.folders_of(leaves)) if leaves is not None else self.points.drop("folder")

    def read_folders(self, wanted: set[int]) -> DataFrame:
        """(point_id, x, y, z, leaf) of some folders."""
        points = self.points if self.folders == 1 else self.points.where(F.col("folder").isin(sorted(wanted)))
        return points.drop("folder")

    def facts(self) -> DataFrame:
        """One row of what is there: n_points, n_boxes (with points), fullest, depth of the top tree, trees below it, index_bytes of its files."""
        boxes = self.points.groupBy("leaf").agg(F.count("*").alias("c"))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        size = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return boxes.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n_points"), F.count("*").alias("n_boxes"), F.coalesce(F.max("c"), F.lit(0)).alias("fullest"),
            F.lit(self.top.depth()).alias("depth"), F.lit(len(self.big)).alias("lower_trees"), F.lit(int(size)).cast("long").alias("index_bytes"),
        )

