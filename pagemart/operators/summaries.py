"""Aggregates over the books table.

Every report is one scan with a partial aggregate per task, so a category that holds a third
of the rows sends one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.numbers import round_half_even
from pagemart.plans.lookup import local_rows, share_of_total
from pagemart.plans.order_statistics import exact_percentiles
from pagemart.schema import PRICE_BINS


def statistics(books: DataFrame) -> DataFrame:
    """Count, mean, lowest and highest price; 0.0 on an empty table."""
    zero = F.lit(0.0)
    return books.agg(
        F.count("id").alias("total_books"),
        F.coalesce(F.avg("price"), zero).alias("avg_price"),
        F.coalesce(F.min("price"), zero).alias("min_price"),
        F.coalesce(F.max("price"), zero).alias("max_price"),
    )


def overview_metrics(frame: DataFrame, approximate: bool = False) -> DataFrame:
    """The five headline numbers."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    totals = frame.agg(
        F.count("*").alias("total_books"),
        F.avg("price").alias("avg_price"),
        F.avg("rating").alias("avg_rating"),
        F.count_if("in_stock").alias("in_stock"),
        distinct("category").alias("categories"),
    )
    percent = F.try_divide(F.col("in_stock"), F.col("total_books")) * 100
    return totals.withColumn("in_stock_pct", percent)


def overview_text(frame: DataFrame) -> DataFrame:
    """The headline numbers as display texts."""
    return overview_metrics(frame).select(
        F.format_string("%,d", "total_books").alias("total_books"),
        F.format_string("£%.2f", "avg_price").alias("avg_price"),
        F.format_string("%.1f/5", "avg_rating").alias("avg_rating"),
        F.format_string("%,d (%.1f%%)", "in_stock", "in_stock_pct").alias("in_stock"),
        F.format_string("%d", "categories").alias("categories"),
    )


def category_counts(frame: DataFrame, n: int | None = None) -> DataFrame:
    """Books per category, most frequent first."""
    counts = frame.groupBy("category").agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), "category")
    return counts if n is None else counts.limit(n)


def category_share(frame: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent categories and their share among these n."""
    return share_of_total(category_counts(frame, n)).orderBy(F.desc("n"), "category")


def _per_rating(frame: DataFrame) -> DataFrame:
    rated = frame.where(F.col("rating").isNotNull())
    return rated.groupBy("rating").agg(F.count("*").alias("n"))


def rating_counts(frame: DataFrame) -> DataFrame:
    """Books per rating in rating order, unrated books left out."""
    return _per_rating(frame).orderBy("rating")


def rating_share(frame: DataFrame) -> DataFrame:
    """Share of each rating among the rated books."""
    return share_of_total(_per_rating(frame)).orderBy("rating")


def _per_stock_status(frame: DataFrame) -> DataFrame:
    label = F.when(F.col("in_stock"), "In Stock").otherwise("Out of Stock").alias("status")
    return frame.groupBy("in_stock").agg(F.count("*").alias("n")).select(label, "n")


def stock_status(frame: DataFrame) -> DataFrame:
    """Books in and out of stock, the larger group first."""
    return _per_stock_status(frame).orderBy(F.desc("n"), "status")


def stock_share(frame: DataFrame) -> DataFrame:
    """Share of the books in and out of stock."""
    return share_of_total(_per_stock_status(frame)).orderBy(F.desc("n"), "status")


def price_range_counts(frame: DataFrame) -> DataFrame:
    """Books per price bin in bin order; empty bins count 0, prices outside are left out."""
    labels = [name for _, _, name in PRICE_BINS]
    bins = local_rows(frame.sparkSession, place=list(range(len(labels))), price_range=labels)
    counts = frame.where(F.col("price_range").isNotNull()).groupBy("price_range").count()
    return (
        bins.join(F.broadcast(counts), "price_range", "left")  # one row per label
        .orderBy("place")
        .select("price_range", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    )


def price_by_top_category(frame: DataFrame, n: int = 10) -> DataFrame:
    """Mean, lowest and highest price of the n most frequent categories, by mean.

    Count and prices come from the same aggregate, so the table is read once.
    """
    groups = frame.groupBy("category").agg(
        F.count("*").alias("n"),
        F.avg("price").alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    top = groups.orderBy(F.desc("n"), "category").limit(n).drop("n")
    return top.orderBy(F.desc("mean_price"), "category")


def category_stats(frame: DataFrame, n: int = 20) -> DataFrame:
    """Price, rating and stock per category, for the n most frequent ones."""
    groups = frame.groupBy("category").agg(
        F.avg("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("rating").alias("avg_rating"),
        F.count_if("in_stock").alias("in_stock"),
        F.count("id").alias("total_books"),
    )
    top = groups.orderBy(F.desc("total_books"), "category").limit(n)
    rounded = ["avg_price", "min_price", "max_price", "avg_rating"]
    return top.withColumns({c: round_half_even(F.col(c), 2) for c in rounded})


def category_stock(frame: DataFrame, n: int = 15) -> DataFrame:
    """Books in stock, out of stock and in all, for the n most frequent categories."""
    groups = frame.groupBy("category").agg(
        F.count_if("in_stock").alias("in_stock"), F.count("id").alias("total")
    )
    top = groups.orderBy(F.desc("total"), "category").limit(n)
    return top.withColumn("out_of_stock", F.col("total") - F.col("in_stock"))


def avg_price_by_rating(frame: DataFrame) -> DataFrame:
    """Mean price per rating, unrated books left out."""
    rated = frame.where(F.col("rating").isNotNull())
    return rated.groupBy("rating").agg(F.avg("price").alias("avg_price")).orderBy("rating")


def price_center(frame: DataFrame, **sizes) -> DataFrame:
    """Mean and median price."""
    median = exact_percentiles(frame, "price", [0.5], names=["median_price"], **sizes)
    return frame.agg(F.avg("price").alias("mean_price")).withColumn(
        "median_price", median.select("median_price").scalar()
    )


def usable_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Which of the columns exist and hold at least one value."""
    present = [c for c in columns if c in frame.columns]
    counts = frame.agg(*[F.count(c).alias(c) for c in present])
    listed = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in present]
    )
    return counts.select(F.inline(listed)).where(F.col("non_null") > 0)
