"""Session helpers shared by the whole library: shared-folder tables and local sessions."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests, the command line and the benchmark."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where it is unset and all run on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="voxelweave-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Whatever operators have written in the shared folder within this block is deleted at its end; results that read it must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/voxelweave/{tag}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of tables that an operator writes on its way and deletes once later tables hold what they said."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, new_path(spark, tag)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet under `name` and read back, as by materialize()."""
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables (all of them, where none is named). What is returned lazily must not read them any more."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application: they need not start where it lies.

    Arrow batches of the session are held to BATCH bytes, unless it has a bound of its own: whole texts in batches of
    10 000 rows would take tens of MB in the JVM and again in Python.
    """
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH_BYTES, BATCH)
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _SHIPPED or not os.path.isdir(package):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="voxelweave-")), "voxelweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
