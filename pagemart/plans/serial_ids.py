"""Consecutive ids without a single-task window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemart.plans.lookup import local_rows
from pagemart.sources.files import Scratch

_ROW_BITS = 33


def with_serial_ids(
    df: DataFrame, start: int, order: list[Column], scratch: Scratch, column: str = "id"
) -> tuple[DataFrame, int]:
    """Ids start+1, start+2, ... in the given order, and the number of rows.

    The rows are written to `scratch` with their place, partition and row in it, so they stay
    as they are; then each partition gets the number of rows before it, and only one count
    per partition reaches the driver. An order adds a range sort, which spreads the rows as
    long as few of them share a place. Without one there is no shuffle.
    """
    ordered = df.sort(*order) if order else df
    placed = scratch.table(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _ROW_BITS).cast("int")
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    parts, bases, total = [], [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        parts.append(row["_part"])
        bases.append(start + total)
        total += row["n"]
    lookup = local_rows(
        df.sparkSession, _part=pa.array(parts, pa.int32()), _base=pa.array(bases, pa.int64())
    )
    offset = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(lookup), "_part")
        .withColumn(column, F.col("_base") + offset + 1)
        .drop("_part", "_at", "_base")
    )
    return numbered, total
