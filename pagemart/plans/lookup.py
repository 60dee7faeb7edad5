"""Joins against a frame with one row per key, safe for small, large and skewed sides.

A side is broadcast only after its rows and bytes have been measured. Beyond that bound the
join shuffles, and keys that hold a large share of the left rows leave the shuffle: their
few lookup rows are measured and broadcast instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemart.session import shared_folder

SMALL_ROWS = 20_000
SMALL_BYTES = 32 * 1024 * 1024
HOT_SHARE = 0.01


def local_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """A few rows that the optimizer knows the size of."""
    return spark.createDataFrame(pa.table(columns))


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """The rows if they are within the bounds, else None.

    Rows and bytes are counted on the executors before any row comes to the driver.
    """
    return df.toArrow() if is_small(df, max_rows) else None


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts, and eight for every other column."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
    return size


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether the frame is within the bounds of a broadcast."""
    count, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    return count <= max_rows and (size or 0) <= SMALL_BYTES


def held_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """The frame as local rows if it is within the bound, else None."""
    rows = small_rows(df, max_rows)
    return None if rows is None else df.sparkSession.createDataFrame(rows, schema=df.schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_per_key(df: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """One row per key: the smallest by `order`, then by every column.

    Spark turns row_number = 1 into a group limit that already runs before the shuffle, so a
    key that holds a third of the rows sends one row per task.
    """
    ties = [F.col(c).asc_nulls_first() for c in df.columns if c != key]
    by = Window.partitionBy(key).orderBy(*(order or []), *ties)
    return df.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, fraction: float = 0.01) -> list:
    """Keys with at least `share` of the sampled rows: at most 1/share of them.

    The sample only steers the plan; every row takes part in the join either way.
    """
    counts = df.select(key).sample(fraction, seed=7).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    if total < 1 / share:
        return []
    rows = counts.where(F.col("n") >= F.lit(total * share)).select(key).collect()
    return [row[key] for row in rows]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    max_rows: int = SMALL_ROWS,
    sample: float = 0.01,
) -> DataFrame:
    """Join with `right`, which has at most one row per key.

    `how` is inner, left, left_semi or left_anti. `right` is written to the shared folder and
    measured there, so it is computed once whatever its size. With hot keys `left` is read
    once for them and once for the rest: write an expensive one out first. `max_rows` 0 skips
    the writing and measuring, for a side known to be large.
    """
    if max_rows:
        right = checkpointed(right)
        if is_small(right, max_rows):
            return left.join(F.broadcast(right), key, how)
    found = hot_keys(left, key, fraction=sample)
    if not found:
        return left.join(right, key, how)
    values = [v for v in found if v is not None]
    is_hot = F.coalesce(F.col(key).isin(values), F.lit(True))
    # One row per hot key, so 1/share rows at most.
    few = right.where(F.col(key).isin(values))
    hot = left.where(is_hot).join(F.broadcast(few), key, how)
    cold = left.where(~is_hot).join(right.where(~F.col(key).isin(values)), key, how)
    return cold.unionByName(hot)


def share_of_total(counts: DataFrame, column: str = "n") -> DataFrame:
    """Share of the rows shown. For frames that an aggregate or a limit made small."""
    whole = Window.partitionBy()
    return counts.withColumn("share", F.col(column) / F.sum(column).over(whole))
