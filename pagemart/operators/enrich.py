"""Derived columns of the report frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.numbers import price_range
from pagemart.functions.text import first_integer, says_in_stock

UNKNOWN = "Unknown"


def enriched(books: DataFrame, include_lowest: bool = False) -> DataFrame:
    """books plus stock_quantity, in_stock, price_range; a null category becomes 'Unknown'."""
    return books.withColumns(
        {
            "category": F.coalesce("category", F.lit(UNKNOWN)),
            "stock_quantity": first_integer(F.col("availability")),
            "in_stock": says_in_stock(F.col("availability")),
            "price_range": price_range(F.col("price"), include_lowest),
        }
    )


def lenient_types(raw: DataFrame) -> DataFrame:
    """Text columns to types: a bad timestamp gives null, a bad price or rating gives 0."""
    return raw.withColumns(
        {
            "price": F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)),
            "rating": F.coalesce(F.col("rating").try_cast("double").cast("int"), F.lit(0)),
            "scraped_at": F.col("scraped_at").try_cast("timestamp_ntz"),
        }
    )
