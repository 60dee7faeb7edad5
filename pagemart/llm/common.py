"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemart.session import new_folder
from pagemart.sources.files import Scratch

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query when the query ends.

    Otherwise they stay until the driver happens to collect its plan, and jobs of many tables
    pile them up.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here, on files all nodes see."""
    path = new_folder(df.sparkSession, name)
    with shuffle_files_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables(Scratch):
    """Scratch tables whose shuffle files go with the query that writes them."""

    def table(self, df: DataFrame) -> DataFrame:
        with shuffle_files_freed(self.spark):
            return super().table(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body mentions it.

    Array functions are evaluated where they stand, so a repeated mention is repeated work.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def tail(values: Column, start: int) -> Column:
    """The array from place `start` (1-based) on."""
    return F.slice(values, start, F.greatest(F.size(values) - (start - 1), F.lit(0)))


def in_corpus(key: Column, rows: int, per_part: int) -> Column:
    """An even part number for a key, so many rows to a part."""
    return F.pmod(key, F.lit(max(1, -(-rows // per_part))))
