"""Reports from aggregates that are kept up to date, one partial state per load.

A state holds, for each group of books, sums that add up: a load aggregates only its own rows
and writes them under its name, so a load that is run again replaces its own. Reports merge the
states on read; they never look at the books. The grain is what the reports group by, so a
state is small next to its load. Sketches for medians and distinct counts are kept the same way,
per day and category, and merged for any span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemart.functions.numbers import round_half_even
from pagemart.sources.files import delete_folder

GROUPS = "category string, rating int, in_stock boolean, price_range string, scrape_date date"
_SUMS = (
    "n bigint, n_id bigint, n_price bigint, sum_price double, min_price double, max_price double,"
    " n_rating bigint, sum_rating bigint"
)
_KEYS = ["category", "rating", "in_stock", "price_range", "scrape_date"]
#: Rank error of a median from sketches is about 1.65 / k, here 0.8 %.
SKETCH_K = 200


def partial_state(frame: DataFrame) -> DataFrame:
    """The sums of some enriched books, a row per group."""
    rows = frame.select(
        "category",
        "rating",
        "in_stock",
        "price_range",
        F.to_date("scraped_at").alias("scrape_date"),
        "price",
        "id",
    )
    return rows.groupBy(*_KEYS).agg(
        F.count("*").alias("n"),
        F.count("id").alias("n_id"),
        F.count("price").alias("n_price"),
        F.sum("price").alias("sum_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("rating").alias("n_rating"),
        F.sum("rating").cast("bigint").alias("sum_rating"),
    )


def partial_sketches(frame: DataFrame) -> DataFrame:
    """(scrape_date, category, prices, upcs): a quantile sketch and a distinct-count sketch."""
    rows = frame.select(F.to_date("scraped_at").alias("scrape_date"), "category", "price", "upc")
    return rows.groupBy("scrape_date", "category").agg(
        F.call_function("kll_sketch_agg_double", F.col("price"), F.lit(SKETCH_K)).alias("prices"),
        F.hll_sketch_agg("upc").alias("upcs"),
    )


class KeptAggregates:
    """The partial states of all loads, below a folder in the shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, load: str, frame: DataFrame) -> None:
        """Keep the state of one load. A second time under the same name replaces it."""
        partial_state(frame).write.mode("overwrite").parquet(f"{self.folder}/sums/load={load}")
        partial_sketches(frame).write.mode("overwrite").parquet(f"{self.folder}/sketches/load={load}")

    def merged(self) -> DataFrame:
        """The sums of all loads, a row per group."""
        states = self.spark.read.schema(f"{GROUPS}, {_SUMS}").parquet(f"{self.folder}/sums")
        return states.groupBy(*_KEYS).agg(*_added())

    def compact(self) -> None:
        """Fold the states of all loads into one, so a report reads as much after any number of
        loads. Between the two steps a reader would count twice: there is one writer."""
        self.merged().coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/next")
        delete_folder(self.spark, f"{self.folder}/sums")
        again = self.spark.read.schema(f"{GROUPS}, {_SUMS}").parquet(f"{self.folder}/next")
        again.write.mode("overwrite").parquet(f"{self.folder}/sums/load=compacted")
        delete_folder(self.spark, f"{self.folder}/next")

    def statistics(self) -> DataFrame:
        """As `summaries.statistics`, from the states."""
        zero = F.lit(0.0)
        whole = self.merged().agg(*_added())
        return whole.select(
            F.coalesce("n_id", F.lit(0)).alias("total_books"),
            F.coalesce(_mean("price"), zero).alias("avg_price"),
            F.coalesce("min_price", zero).alias("min_price"),
            F.coalesce("max_price", zero).alias("max_price"),
        )

    def category_stats(self, n: int = 20) -> DataFrame:
        """As `summaries.category_stats`, from the states."""
        groups = self.merged().groupBy("category").agg(*_added(), _in_stock().alias("in_stock"))
        top = groups.orderBy(F.desc("n_id"), "category").limit(n)
        return top.select(
            "category",
            round_half_even(_mean("price"), 2).alias("avg_price"),
            round_half_even(F.col("min_price"), 2).alias("min_price"),
            round_half_even(F.col("max_price"), 2).alias("max_price"),
            round_half_even(_mean("rating"), 2).alias("avg_rating"),
            "in_stock",
            F.col("n_id").alias("total_books"),
        )

    def counts(self, key: str) -> DataFrame:
        """Books per value of a group column, null among them."""
        return self.merged().groupBy(key).agg(F.sum("n").alias("n"))

    def cumulative_counts(self) -> DataFrame:
        """As `timeline.cumulative_counts`, from the states."""
        days = self.counts("scrape_date").where(F.col("scrape_date").isNotNull())
        so_far = Window.orderBy("scrape_date").rowsBetween(Window.unboundedPreceding, 0)
        return days.withColumn("cumulative", F.sum("n").over(so_far))

    def sketched(self, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """(key, median_price, distinct_upcs) of the days from `start` to `end`, both included, from
        merged sketches."""
        schema = "scrape_date date, category string, prices binary, upcs binary"
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/sketches")
        if start is not None:
            rows = rows.where(F.col("scrape_date") >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.where(F.col("scrape_date") <= F.lit(end).cast("date"))
        return rows.groupBy(key).agg(
            F.call_function(
                "kll_sketch_get_quantile_double",
                F.call_function("kll_merge_agg_double", F.col("prices")),
                F.lit(0.5),
            ).alias("median_price"),
            F.hll_sketch_estimate(F.hll_union_agg("upcs")).alias("distinct_upcs"),
        )


def _added() -> list[Column]:
    """The sums of several states."""
    kinds = {"min_price": F.min, "max_price": F.max}
    names = [part.split()[0] for part in _SUMS.split(", ")]
    return [kinds.get(name, F.sum)(name).alias(name) for name in names]


def _mean(name: str) -> Column:
    return F.try_divide(F.col(f"sum_{name}"), F.col(f"n_{name}"))


def _in_stock() -> Column:
    return F.sum(F.when(F.col("in_stock"), F.col("n")).otherwise(0))
