"""Named files in a folder, written by tasks and committed by the driver, which moves finished files and nothing else."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxelweave.session import ship


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


# --- text --------------------------------------------------------------------------------------------------


def write_text_files(lines: DataFrame, folder: str, order: list[str]) -> None:
    """A text file for each `name` of (name, value, further columns), its lines by `order`; a file that is there is replaced.

    One task writes a file, sorted within bounded memory, by Spark's text sink and commit protocol: a task that fails
    leaves nothing. The driver then moves each finished file to its name.
    """
    spark, parts = lines.sparkSession, f"{folder}/.parts-{uuid.uuid4().hex}"
    lines.repartition("name").sortWithinPartitions("name", *order).select("name", "value").write.partitionBy("name").text(parts)
    fs, top = _file_system(spark, parts)
    jvm = spark._jvm.org.apache
    try:
        for kind in fs.listStatus(top):
            if not kind.isDirectory():
                continue
            name = jvm.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(kind.getPath().getName().removeprefix("name="))
            (part,) = [s.getPath() for s in fs.listStatus(kind.getPath())]
            target = jvm.hadoop.fs.Path(f"{folder}/{name}")
            fs.delete(target, False)
            if not fs.rename(part, target):
                raise OSError(f"{target} can't be written")
    finally:
        fs.delete(top, True)


# --- bytes -------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a finished file lies, and its name


class NamedFiles(DataSource):
    """A sink for rows (name, content): a file each under the option `path`, in any store that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:  # noqa: ARG002
        return NamedFilesWriter(self.options["path"])


class NamedFilesWriter(DataSourceWriter):
    """Tasks write below a folder of the job's own; files get their names when all tasks are done, or go when one fails for good."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), f"{path.rstrip('/')}/.job-{uuid.uuid4().hex}"

    def _store(self):
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        store, root = self._store()
        own, files = f"{root}/{os.path.basename(self.job)}/{uuid.uuid4().hex}", []  # of this attempt alone
        store.create_dir(own)
        for k, (name, content) in enumerate(iterator):
            with store.open_output_stream(f"{own}/{k}") as out:
                out.write(bytes(content))
            files.append((f"{own}/{k}", f"{root}/{name}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = self._store()
        for message in messages:
            for part, target in message.files if message else []:
                store.move(part, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs

        store, root = self._store()
        own = f"{root}/{os.path.basename(self.job)}"
        if store.get_file_info(own).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(own)


def write_named_files(files: DataFrame, folder: str) -> None:
    """A file for each row (name, content); of rows with equal names one stays."""
    spark = files.sparkSession
    ship(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)
    spark.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format("named_files").mode("append").option("path", folder).save()
