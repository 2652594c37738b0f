"""Dense positions of rows in an order, by prefix sums of the counts of range partitions: no order meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.session import Scratch


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition, and their place in it among rows of the same group (the last column)."""
    part, group, at = TaskContext.get().partitionId(), None, -1
    for batch in source:
        places = []
        for g in batch.column(batch.num_columns - 1).to_pylist():
            group, at = (g, at + 1) if g == group and at >= 0 else (g, 0)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "__part", "__place"])


def with_positions(rows: DataFrame, order: list[str], group: str | None = None, out: str = "position") -> DataFrame:
    """rows with `out`: 0, 1, 2, ... by `order` within each value of `group` (null is one), or over all rows.

    Rows that the order leaves equal get any order among themselves. Only one count a (partition, group) is summed up.
    """
    scratch, width = Scratch(rows.sparkSession, "positions"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns
    if out in columns:
        raise ValueError(f"there is a column {out} already")
    own = rows.withColumn("__tie", F.monotonically_increasing_id()).withColumn("__group", F.struct(F.col(group) if group else F.lit(0)))  # a struct is never null
    keys = [*([group] if group else []), *order, "__tie"]
    ordered = own.repartitionByRange(width, *keys).sortWithinPartitions(*keys).drop("__tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    placed = scratch.keep(ordered.mapInArrow(_count, f"{schema}, __part int, __place long"), "placed")
    counts, window = placed.groupBy("__group", "__part").agg(F.count("*").alias("c")), Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__group", "__part", F.coalesce(F.sum("c").over(window), F.lit(0)).alias("__base"))
    return placed.join(bases, ["__group", "__part"]).select(*columns, (F.col("__base") + F.col("__place")).alias(out))
