"""Row filters, column choices and the options a user filters by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.text import cut
from pagemart.operators.ranking import latest_books
from pagemart.schema import API_COLUMNS, EXPLORER_COLUMNS, EXPLORER_DEFAULT


def books_by_price(books: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Both bounds included; a missing bound is open."""
    if low is not None:
        books = books.where(F.col("price") >= low)
    if high is not None:
        books = books.where(F.col("price") <= high)
    return books


def api_books(
    books: DataFrame,
    limit: int | None = 100,
    min_price: float | None = None,
    max_price: float | None = None,
    strict: bool = False,
) -> DataFrame:
    """The book list of the service, 7 columns.

    Two bounds select a price range without a limit; otherwise the newest `limit` rows come
    back and a single bound has no effect. With `strict`, every argument given applies.
    """
    if strict:
        books = books_by_price(books, min_price, max_price)
        return latest_books(books, limit, API_COLUMNS)
    if min_price is not None and max_price is not None:
        return books_by_price(books, min_price, max_price).select(API_COLUMNS)
    return latest_books(books, limit, API_COLUMNS)


def _explorer_filter(category, rating, min_price, max_price):
    keep = F.lit(True)
    if category != "All":
        keep = keep & (F.col("category") == category)
    if rating != "All":
        keep = keep & (F.col("rating") == rating)
    if min_price is not None:
        keep = keep & (F.col("price") >= min_price)
    if max_price is not None:
        keep = keep & (F.col("price") <= max_price)
    return keep


def explore(
    frame: DataFrame,
    category: str = "All",
    rating: int | str = "All",
    min_price: float | None = None,
    max_price: float | None = None,
    columns: list[str] | None = None,
    any_column: bool = False,
    limit: int | None = None,
    cut_at: int | None = None,
) -> DataFrame:
    """Filtered rows with the chosen columns; 'All' and None do not filter.

    `limit` keeps the newest rows (by created_at, if the frame has it, then in column order),
    `cut_at` shortens every text column.
    """
    columns = list(columns or EXPLORER_DEFAULT)
    allowed = frame.columns if any_column else [c for c in EXPLORER_COLUMNS if c in frame.columns]
    unknown = [c for c in columns if c not in allowed]
    if unknown:
        raise ValueError(f"columns not available: {', '.join(unknown)}")
    shown = frame.where(_explorer_filter(category, rating, min_price, max_price))
    if limit is not None:
        newest = [F.col("created_at").desc_nulls_first()] if "created_at" in frame.columns else []
        shown = shown.orderBy(*newest, *[F.col(c).asc_nulls_first() for c in columns]).limit(limit)
    shown = shown.select(columns)
    if cut_at is not None:
        texts = [name for name, kind in shown.dtypes if kind == "string"]
        shown = shown.withColumns({c: cut(F.col(c), cut_at, "") for c in texts})
    return shown


def explore_counts(
    frame: DataFrame,
    category: str = "All",
    rating: int | str = "All",
    min_price: float | None = None,
    max_price: float | None = None,
) -> DataFrame:
    """How many rows the filter shows and how many there are, in one pass."""
    keep = _explorer_filter(category, rating, min_price, max_price)
    return frame.agg(F.count_if(keep).alias("shown"), F.count("*").alias("total"))


def filter_options(frame: DataFrame) -> DataFrame:
    """Distinct categories and ratings, and the highest price, as (option, value) rows.

    The table is read once; the rest works on one row per category and rating.
    """
    pairs = frame.groupBy("category", "rating").agg(F.max("price").alias("price"))
    listed = pairs.select(
        F.explode(
            F.array(
                F.struct(F.lit("category").alias("option"), F.col("category").alias("value")),
                F.struct(
                    F.lit("rating").alias("option"),
                    F.col("rating").cast("string").alias("value"),
                ),
                F.struct(
                    F.lit("max_price").alias("option"), F.lit(None).cast("string").alias("value")
                ),
            )
        ).alias("o"),
        "price",
    ).select("o.option", "o.value", "price")
    top = F.max(F.when(F.col("option") == "max_price", F.col("price"))).alias("max_price")
    return (
        listed.where((F.col("option") == "max_price") | F.col("value").isNotNull())
        .groupBy("option", "value")
        .agg(top)
        .orderBy("option", "value")
    )


def rows_of_top_categories(frame: DataFrame, n: int = 10) -> DataFrame:
    """All rows of the n most frequent categories."""
    top = (
        frame.groupBy("category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(n)
        .select("category")
    )
    # n names at most.
    return frame.join(F.broadcast(top), "category", "left_semi")
