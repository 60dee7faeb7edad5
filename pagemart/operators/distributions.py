"""Histograms, box plots, correlations and the trend line."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.numbers import bin_index
from pagemart.operators.ranking import sample_books
from pagemart.plans import moments
from pagemart.plans.lookup import held_if_small, local_rows
from pagemart.plans.order_statistics import exact_percentiles


def histogram(frame: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the lowest and the highest value, empty bins too.

    The two limits are read first, then the bins are counted in a second scan of the column.
    A column with a single value has one bin, an empty column none. A column with NaN or an
    infinite value has no finite range and is an error.
    """
    values = frame.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is not None and not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError(f"{column} has no finite range")
    if low is None:
        places = []
    else:
        places = list(range(1, (1 if low == high else bins) + 1))
    width = 0.0 if low is None else (high - low) / bins
    edges = local_rows(
        frame.sparkSession,
        bin=pa.array(places, pa.int32()),
        bin_low=pa.array([low + (i - 1) * width for i in places], pa.float64()),
        bin_high=pa.array(
            [high if i == places[-1] else low + i * width for i in places], pa.float64()
        ),
    )
    found = bin_index(F.col("v"), F.lit(low), F.lit(high), bins)
    counts = values.groupBy(found.alias("bin")).count()
    return (
        edges.join(F.broadcast(counts), "bin", "left")  # one row per bin
        .select("bin", "bin_low", "bin_high", F.coalesce("count", F.lit(0)).alias("n"))
        .orderBy("bin")
    )


def box_by(frame: DataFrame, value: str, key: str, **sizes) -> DataFrame:
    """Box plot numbers per group: quartiles, whiskers and outliers.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    """
    rows = frame.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    quartiles = exact_percentiles(
        rows, value, [0.25, 0.5, 0.75], by=[key], names=["q1", "median", "q3"], **sizes
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quartiles.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    small = held_if_small(fences)
    joined = rows.join(fences if small is None else F.broadcast(small), key)
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return (
        joined.groupBy(key, "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
            F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
            F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
        .orderBy(key)
    )


def correlation_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r per column pair over the rows where both are set, as (x, y, r).

    One scan for the means and one for the sums around them, a row for each combination of
    columns with values. A constant column has no r. Columns without values are left out, and
    with fewer than two columns left there is no row.
    """
    columns = [c for c in columns if c in frame.columns]
    if not columns:
        return frame.sparkSession.createDataFrame([], "x string, y string, r double")
    sums = moments.pattern_sums(frame, columns, moments.shifts_of(frame, columns))
    # One row per combination of columns with values, then one row in all.
    whole = sums.agg(F.collect_list(F.struct("*")).alias("patterns"))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = whole.select(*[moments.pair_columns(F.col("patterns"), i, j).alias(f"of_{i}_{j}") for i, j in pairs])
    has_values = [F.col(f"of_{i}_{i}.n") > 0 for i in range(len(columns))]
    usable = sum((v.cast("int") for v in has_values[1:]), has_values[0].cast("int"))
    cells = [
        F.when(
            has_values[i] & has_values[j] & (usable >= 2),
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"of_{i}_{j}.r").alias("r")),
        )
        for i, j in pairs
        for x, y in dict.fromkeys([(columns[i], columns[j]), (columns[j], columns[i])])
    ]
    return found.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def price_rating_ols(frame: DataFrame, on: str = "all", seed: int = 0) -> DataFrame:
    """Least-squares line price = intercept + slope * rating, over all rows or a sample."""
    if on not in ("all", "sample"):
        raise ValueError("on must be 'all' or 'sample'")
    if on == "sample":
        frame = sample_books(frame, seed=seed)
    rows = frame.where(F.col("price").isNotNull() & F.col("rating").isNotNull())
    price, rating = F.col("price").cast("double"), F.col("rating").cast("double")
    return rows.agg(
        F.regr_slope(price, rating).alias("slope"),
        F.regr_intercept(price, rating).alias("intercept"),
        F.regr_r2(price, rating).alias("r2"),
        F.count("*").alias("n"),
    )
