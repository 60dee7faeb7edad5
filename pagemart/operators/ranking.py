"""Top-k lists and samples. Ties are broken by every column shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.numbers import value_score
from pagemart.functions.text import cut

TOP_COLUMNS = ["title", "price", "category", "rating"]


def latest_books(
    books: DataFrame, limit: int | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Newest first, rows without a date ahead; limit None or 0 keeps all."""
    columns = columns or books.columns
    ties = [F.col(c).asc_nulls_first() for c in columns if c != "created_at"]
    ordered = books.orderBy(F.col("created_at").desc_nulls_first(), *ties)
    if limit:
        ordered = ordered.limit(limit)
    return ordered.select(columns)


def _highest(frame: DataFrame, by: str, n: int, columns: list[str]) -> DataFrame:
    ties = [F.col(c).asc_nulls_first() for c in columns if c != by]
    return frame.orderBy(F.col(by).desc_nulls_last(), *ties).limit(n).select(columns)


def top_expensive(frame: DataFrame, n: int = 10, suffix: str = "...") -> DataFrame:
    """The n highest prices, titles cut at 50."""
    top = _highest(frame, "price", n, TOP_COLUMNS)
    return top.withColumn("title", cut(F.col("title"), 50, suffix))


def top_rated(frame: DataFrame, n: int = 10, suffix: str = "...") -> DataFrame:
    """The n highest prices among the 5-star books."""
    return top_expensive(frame.where(F.col("rating") == 5), n, suffix)


def best_value(frame: DataFrame, n: int = 15, suffix: str = "...") -> DataFrame:
    """The n best ratings per price; titles cut at 60, title_short at 30."""
    scored = frame.withColumn("value_score", value_score(F.col("rating"), F.col("price")))
    top = _highest(
        scored, "value_score", n, ["title", "price", "rating", "category", "value_score"]
    )
    return top.withColumns(
        {
            "title_short": cut(F.col("title"), 30, suffix),
            "title": cut(F.col("title"), 60, suffix),
        }
    )


def sample_books(frame: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """n rows picked by a seeded hash of the row and its number among equal rows; all rows when
    there are fewer.

    Equal rows are counted, which the partial aggregate does before the shuffle, and drawn one
    by one, so each row has the same chance however often it is repeated.
    """
    columns = frame.columns
    counted = frame.groupBy(*columns).agg(F.count("*").alias("_copies"))
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    texts = [F.col(c).cast("string") for c in [*columns, "_copy"]]
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    ties = [F.col(c).asc_nulls_first() for c in columns]
    return each.orderBy(draw, *ties, "_copy").limit(n).select(columns)
