"""Operator 8: contiguous, byte-balanced shards from global prefix sums of sizes.

The rows are put in one global order (document id, then content). Each range partition sums its own sizes; the
exclusive prefix sum over these totals, one row a partition, gives every partition its place, and a running sum
inside the partition gives every document its place. Cutting the byte axis at equal targets by the middle of
each document gives contiguous shards whose sizes differ from the target by at most one document at either end.
No row but (id, size, crc) is shuffled, and no key gathers rows: equal ids and copies only sort next to each other.

Defined results: a null text counts no bytes; an empty table gives no rows; null ids come first; repeated rows
are rows of their own; with a document longer than a target some shards may be empty; extra columns, whatever
their names, stay with their rows in `assign_shards`' caller, as only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import exclusive_cumsum, table, with_bases
from voxelweave.session import materialize

_LOCAL = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "size", "text_crc32", "part", "byte_in_part", "row_in_part")])


def _place_in_part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at_byte, at_row = TaskContext.get().partitionId(), 0, 0
    for batch in source:
        size = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = exclusive_cumsum(size, at_byte)
        row = np.arange(at_row, at_row + len(size))
        at_byte, at_row = at_byte + int(size.sum()), at_row + len(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int64)), pa.array(start), pa.array(row)], names=_LOCAL.names)


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, byte_start), one for each row of docs."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sizes = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")), "sizes")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "tie"]  # the tie is any order of equal rows, so that ranges split them
    ordered = sizes.repartitionByRange(width, *order).sortWithinPartitions(*order).drop("tie")
    placed = materialize(ordered.mapInArrow(_place_in_part, _LOCAL), "placed")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = with_bases(with_bases(totals, "part", "bytes", "byte_base"), "part", "rows", "row_base")
    everything = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all_bytes"))
    rows = (
        placed.join(bases.select("part", "byte_base", "row_base"), "part")
        .join(F.broadcast(everything))  # one row
        .withColumn("byte_start", F.col("byte_base") + F.col("byte_in_part"))
        .withColumn("row", F.col("row_base") + F.col("row_in_part"))
        .withColumn("middle", (2 * F.col("byte_start") + F.col("size")).cast("decimal(38,0)") * shards)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr("middle div (2 * all_bytes)")).cast("int"))
    )
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most one row a shard
    return rows.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "byte_start")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes (law `bytes`)."""
    rows = assign_shards(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "byte_start")
