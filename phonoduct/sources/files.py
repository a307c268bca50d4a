"""Binary files as rows, and rows as files."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from phonoduct.operators.series import KEY, stem


class DuplicateStem(ValueError):
    """Two files have one name without folder and suffix."""


def read_binary(spark: SparkSession, glob: str) -> DataFrame:
    """(series_id, path, content) of files; many small files share a partition."""
    d = spark.read.format("binaryFile").load(glob)
    return d.select(stem(F.col("path")).alias(KEY), "path", "content")


def check_stems(files: DataFrame, key: str = KEY) -> DataFrame:
    """The files, if no two have the same stem; else raises."""
    odd = files.groupBy(key).agg(F.count_distinct("path").alias("n")).where("n > 1").limit(5).collect()
    if odd:
        raise DuplicateStem(f"several files are named {[r[0] for r in odd]}")
    return files


def write_text(spark: SparkSession | None, path: str, text: str) -> None:
    """Write one small file through the session's file systems; without a session, on this machine."""
    if spark is None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


class NamedFiles(DataSource):
    """Write rows (name string, content binary) as files in a folder that all executors share.

    The folder is opened by pyarrow's file systems: a local or mounted one, or hdfs, s3 or gs where their libraries are there.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder) if re.match(r"\w+:", self.folder) else (fs.LocalFileSystem(), os.path.abspath(self.folder))
        system.create_dir(folder, recursive=True)
        for r in rows:
            target = f"{folder}/{os.path.basename(r['name'])}"
            part = f"{target}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            system.move(part, target)  # a retried task leaves whole files only
        return WriterCommitMessage()


def write_files(df: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(folder)
