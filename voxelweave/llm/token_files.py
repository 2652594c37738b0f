"""Operator 5: token ids in ORC files, read back by stripes.

Each document's ids are one row of an ORC file: `doc_id`, `part`, `start_in_part`, `n_tokens` and `ids`. The
writer encodes integers by run length (version 2), keeps row indexes with the smallest and largest doc_id of
every stripe and row group, and adds Bloom filters on doc_id, so that a filter on doc_id skips stripes and
files, and readers take stripes in parallel. Files follow ascending doc_id: the table is range-partitioned by
doc_id, so file after file the ids rise.

`start` is the number of ids in all documents before. A row holds its start within its part; the parts' totals
(one row a part) are summed in order on reading. Defined results: null and empty texts have the end id alone;
null doc_ids come first; rows with equal ids are ordered by the text's hash; an empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, crc32_of, exclusive_cumsum, table, texts_of, with_bases
from voxelweave.llm.tokens import encoder, read_tokenizer
from voxelweave.session import new_path

_FILE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
)
_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _encode(source: Iterator[pa.RecordBatch], tokenizer, words: bool, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(tokenizer.value, words), np.array([end_id], "<u4").tobytes()
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches(source):
        ids = [b + end for b in enc.ids(texts_of(batch.column(1)))]
        counts = np.array([len(b) // 4 for b in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<i4")
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        start = exclusive_cumsum(counts, at)
        at += int(counts.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=_FILE.names)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, words: bool = True, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the ids as ORC under path, in ascending doc_id order."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    width = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "tie"]  # the tie is any order of equal rows, so that ranges split them
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width, *order).sortWithinPartitions(*order).drop("tie")
    encoded = ordered.mapInArrow(partial(_encode, tokenizer=tokenizer, words=words, end_id=end_id), _FILE)
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(64 << 20)).option("compression", "zstd").orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id are pushed to the stripes' statistics and Bloom filters."""
    return spark.read.schema(_FILE).orc(path)


def _digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        ids = batch.column(4)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [crc32_of(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=_DIGEST.names)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files."""
    files = read_token_files(spark, path)
    bases = with_bases(files.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "base")
    return files.mapInArrow(_digest, _DIGEST).join(bases.select("part", "base"), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through ORC token files: word_bpe_49k.json, end id 1."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digest(spark, path)
