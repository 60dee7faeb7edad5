"""Counts over scrape dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _per_day(frame: DataFrame) -> DataFrame:
    dated = frame.where(F.col("scraped_at").isNotNull())
    return dated.groupBy(F.to_date("scraped_at").alias("scrape_date")).agg(
        F.count("*").alias("n")
    )


def daily_counts(frame: DataFrame) -> DataFrame:
    """Books per scrape date, undated books left out."""
    return _per_day(frame).orderBy("scrape_date")


def cumulative_counts(frame: DataFrame) -> DataFrame:
    """Daily counts with their running total. The ordered window sees one row per day."""
    so_far = Window.orderBy("scrape_date").rowsBetween(Window.unboundedPreceding, 0)
    return _per_day(frame).withColumn("cumulative", F.sum("n").over(so_far))
