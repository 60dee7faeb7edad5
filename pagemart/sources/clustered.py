"""A copy of the books laid out for skipping: clustered by several columns, with filters for keys.

Rows are sorted by a key that interleaves the bits of the places of their values, so rows that
are near in all the columns stand together, and the smallest and largest values that Parquet
keeps for each row group and page rule most of them out for a range in any of the columns. Bloom filters on
the key columns rule out row groups that do not hold a key asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.plans.lookup import row_bytes

#: Bits of the place of a value in its column; the columns together have one key of 64 bits.
BITS = 5
ROW_GROUP_BYTES = 16 << 20
#: Bytes of values that one file, and the task that writes it, should have at most.
FILE_BYTES = 128 << 20


def as_number(value: Column, kind: T.DataType) -> Column:
    """A number in the order of the values; of texts the first six bytes."""
    if isinstance(kind, T.StringType):
        start = F.substring(F.encode(value, "UTF-8"), 1, 6)
        return F.conv(F.rpad(F.hex(start), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def place_borders(
    df: DataFrame, columns: list[str], bits: int = BITS
) -> tuple[dict[str, list[float]], int]:
    """Numbers that part the rows into 2**bits about equal places, for each column, and about the
    bytes of all rows, in one scan."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(
        *[
            F.percentile_approx(as_number(F.col(c), df.schema[c].dataType), shares, 10_000).alias(c)
            for c in columns
        ],
        F.sum(row_bytes(df)),
    ).first()
    borders = {c: sorted({b for b in found[c] or [] if math.isfinite(b)}) for c in columns}
    return borders, found[-1] or 0


def _place(number: Column, borders: list[float]) -> Column:
    """How many borders are at or below the number, by halving; 0 for null."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number >= borders[middle], below(middle + 1, high)).otherwise(below(low, middle))

    return F.when(number.isNull(), 0).otherwise(below(0, len(borders))).cast("long")


def interleaved(places: list[Column], bits: int = BITS) -> Column:
    """The bits of all places, the highest of each first."""
    key = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for place in places:
            one = F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long"))
            key = F.shiftleft(key, 1).bitwiseOR(one)
    return key


def write_clustered(
    df: DataFrame,
    path: str,
    columns: list[str],
    keys: list[str],
    files: int,
    row_group_bytes: int = ROW_GROUP_BYTES,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write `df` clustered by `columns`, with Bloom filters on `keys`, in about so many files, or
    more where a file would have over `file_bytes` of values.

    Nulls stand with the smallest values. Rows with one place in all columns are spread over
    files by a hash, so a value that a third of the rows have makes no large file.
    """
    borders, size = place_borders(df, columns)
    files = max(files, math.ceil(size / file_bytes))
    key = interleaved([_place(as_number(F.col(c), df.schema[c].dataType), borders[c]) for c in columns])
    rows = df.select("*", key.alias("_key"), F.xxhash64(*keys).alias("_spread"))
    rows = rows.repartitionByRange(files, "_key", "_spread").sortWithinPartitions("_key", *columns)
    days = {_day(c): F.to_date(c) for c in columns if _is_time(df.schema[c].dataType)}
    writer = rows.withColumns(days).drop("_key", "_spread").write.mode("overwrite")
    writer = writer.option("parquet.block.size", row_group_bytes)
    for name in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        # Without a dictionary the filter is kept, whatever the number of values.
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def _day(column: str) -> str:
    return f"_day_of_{column}"


def read_clustered(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    within: dict[str, tuple] | None = None,
) -> DataFrame:
    """The rows whose values lie `within` the limits (low, high) of each column, both included; a
    limit None is none.

    The reader does not use the limits of times, so their days are stored as well and asked for.
    """
    days = [T.StructField(_day(f.name), T.DateType()) for f in schema if _is_time(f.dataType)]
    found = spark.read.schema(T.StructType([*schema, *days])).parquet(path)
    for column, (low, high) in (within or {}).items():
        kind = schema[column].dataType
        for limit, is_low in ((low, True), (high, False)):
            if limit is None:
                continue
            value = F.lit(limit).cast(kind)
            found = found.where(F.col(column) >= value if is_low else F.col(column) <= value)
            if _is_time(kind):
                day, border = F.col(_day(column)), F.to_date(value)
                found = found.where(day >= border if is_low else day <= border)
    return found.select(schema.fieldNames())
