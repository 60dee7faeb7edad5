"""Which pages a crawl covers, and which category a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemart.plans.lookup import first_per_key, lookup_join


def page_address(start: Column, number: Column, base_url: str | None = None) -> Column:
    """Address of page `number`: the start page itself for 1.

    Later pages of a catalogue (with `base_url`) have addresses of their own; those of a
    category replace index.html in its start address.
    """
    name = F.concat(F.lit("page-"), number.cast("string"), F.lit(".html"))
    if base_url is not None:
        later = F.concat(F.lit(base_url + "catalogue/"), name)
    else:
        later = F.replace(start, F.lit("index.html"), name)
    return F.when(number == 1, start).otherwise(later)


def catalogue_plan(spark, base_url: str, max_pages: int) -> DataFrame:
    """Pages 1 to max_pages of the whole catalogue."""
    pages = spark.range(1, max_pages + 1).select(F.col("id").cast("int").alias("page"))
    return pages.withColumn("url", page_address(F.lit(base_url), F.col("page"), base_url))


def category_plan(
    categories: DataFrame, max_pages: Column | int, first_page_only: bool = False
) -> DataFrame:
    """Pages of every category (name, url). `first_page_only` plans one page for each,
    which is what a page limit means in a crawl by category."""
    last = F.lit(1) if first_page_only else F.lit(max_pages).cast("int")
    pages = categories.where(last >= 1).select(
        "name", F.col("url").alias("start"), F.explode(F.sequence(F.lit(1), last)).alias("page")
    )
    return pages.select("name", "page", page_address(F.col("start"), F.col("page")).alias("url"))


def contiguous_pages(pages: DataFrame, **sizes) -> DataFrame:
    """Pages before the first empty or missing one of their category.

    `pages` has one row (category, page, n_books) per page. A page ends its run when the next
    one has no books or does not exist; the first end counts. Ends are found by a join on
    (category, page), so a category with a third of all pages is spread over all tasks.
    """
    filled = pages.where(F.col("n_books") > 0)
    numbers = filled.select("category", "page")
    zero = filled.groupBy("category").agg(F.lit(0).cast("int").alias("page"))
    before_next = numbers.select("category", (F.col("page") - 1).alias("page"))
    ends = (
        numbers.unionByName(zero)
        .join(before_next, ["category", "page"], "left_anti")
        .groupBy("category")
        .agg(F.min("page").alias("last_page"))
    )
    kept = lookup_join(filled, ends, "category", "inner", **sizes)
    return kept.where(F.col("page") <= F.col("last_page")).select(pages.columns)


def start_address(url: Column) -> Column:
    """Address of the category a page belongs to: page-7.html back to index.html."""
    return F.regexp_replace(url, r"page-[0-9]+\.html", "index.html")


def tag_category(rows: DataFrame, categories: DataFrame, **sizes) -> DataFrame:
    """Set the category of rows (with page_url) from the category their page belongs to.

    Rows of other pages keep their category. Two categories with one address: the first name.
    """
    names = first_per_key(
        categories.select(F.col("url").alias("_start"), F.col("name").alias("_name")), "_start"
    )
    tagged = lookup_join(
        rows.withColumn("_start", start_address(F.col("page_url"))), names, "_start", **sizes
    )
    return tagged.withColumn("category", F.coalesce("_name", "category")).select(rows.columns)
