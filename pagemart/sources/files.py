"""Folders of intermediate tables, by the file system that the session itself uses."""

from __future__ import annotations

import re
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from pagemart.session import new_folder


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


def numbered_folders(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders prefix0, prefix1, ... that hold a finished table."""
    system, path = _path(spark, folder)
    if not system.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in system.listStatus(path)]
    found = []
    for place, name in names:
        match = re.fullmatch(re.escape(prefix) + r"(\d+)", name)
        if match and system.exists(_path(spark, f"{place}/_SUCCESS")[1]):
            found.append(int(match[1]))
    return sorted(found)


def file_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that are names of files of a folder."""
    system, path = _path(spark, folder)
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


class Scratch:
    """Tables that live as long as the `with` block, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark = spark
        self.folder = new_folder(spark, name)
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        """The frame written out: computed once, and read from there."""
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(
        self, kind: type | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        delete_folder(self.spark, self.folder)
