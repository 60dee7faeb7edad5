"""Every query by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemart.functions import text as X
from pagemart.operators import (
    attributes,
    crawl,
    distributions,
    extract,
    filters,
    ranking,
    summaries,
    timeline,
)
from pagemart.operators.combine import enrich_listing
from pagemart.operators.enrich import enriched, lenient_types
from pagemart.operators.extract_function import register_extract
from pagemart.operators.kept import KeptAggregates
from pagemart.operators.load import plan_load
from pagemart.plans.order_statistics import exact_percentiles
from pagemart.schema import BOOKS, NUMERIC_COLUMNS
from pagemart.session import new_folder
from pagemart.sources import derived
from pagemart.sources.books import BooksTable, page_stream
from pagemart.sources.clustered import read_clustered, write_clustered
from pagemart.sources.files import Scratch
from pagemart.sources.sinks import export_csv, to_json_rows
from pagemart.streaming.daily import read_daily_counts, stream_daily_counts
from pagemart.streaming.ingest import PageIngest, crawl_records

Query = Callable[[SparkSession, str], DataFrame]
BASE = derived.BASE_URL


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Six decimals: sums of doubles depend on the order of addition beyond that."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def _on_books(report: Callable[[DataFrame], DataFrame], *round_columns: str) -> Query:
    def query(spark, sf_dir):
        return _rounded(report(derived.books(spark, sf_dir)), *round_columns)

    return query


def _on_frame(
    report: Callable[[DataFrame], DataFrame], *round_columns: str, digits: int = 6
) -> Query:
    def query(spark, sf_dir):
        frame = enriched(derived.books(spark, sf_dir))
        return _rounded(report(frame), *round_columns, digits=digits)

    return query


def _scan_pages(spark, sf_dir):
    return derived.table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _parse_price(spark, sf_dir):
    text = F.concat(F.lit("£"), F.col("id").cast("string"), F.lit(".50 each"))
    text = F.when(F.col("rating").isNull(), F.lit("free")).when(
        F.col("rating") == 0, F.concat(F.lit("1.2."), F.col("id").cast("string"))
    ).otherwise(text)
    frame = derived.books(spark, sf_dir).select("id", text.alias("price_text"))
    return frame.select(
        "id",
        X.parse_price(F.col("price_text")).alias("price"),
        X.price_is_malformed(F.col("price_text")).alias("malformed"),
    )


def _parse_rating(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("Zero", "One", "Two", "Three", "Four", "Five")])
    css = F.concat(F.lit("star-rating "), F.try_element_at(words, F.col("rating") + 1))
    frame = derived.books(spark, sf_dir).select("id", F.coalesce(css, F.lit("star-rating")).alias("css"))
    return frame.select("id", X.parse_rating(F.col("css")).alias("rating"))


def _hrefs(spark, sf_dir):
    code = F.col("id").cast("string")
    href = (
        F.when(F.col("rating") == 1, F.concat(F.lit("http://x/"), code))
        .when(F.col("rating") == 2, F.concat(F.lit("../../../catalogue/"), code, F.lit("/../../../i.html")))
        .when(F.col("rating") == 3, F.concat(F.lit("../"), code, F.lit("/../i.html")))
        .when(F.col("rating") == 4, F.concat(F.lit("catalogue/"), code))
        .when(F.col("rating") == 5, F.lit(""))
        .otherwise(code)
    )
    return derived.books(spark, sf_dir).select("id", href.alias("href"))


def _resolve_urls(spark, sf_dir):
    href = F.col("href")
    return _hrefs(spark, sf_dir).select(
        "id",
        X.resolve_url(href, BASE).alias("url"),
        X.resolve_url_in_category(href, BASE).alias("category_url"),
    )


def _normalize_keys(spark, sf_dir):
    lines = derived.product_lines(spark, sf_dir)
    return lines.select("page_id", "line", X.normalize_key(F.col("label")).alias("key"), "value")


def _pivot_product(spark, sf_dir):
    return extract.pivot_product(_normalize_keys(spark, sf_dir))


def _extract_listing(spark, sf_dir):
    return extract.good_rows(extract.extract_listing(derived.listing_pages(spark, sf_dir), BASE))


def _extract_category_listing(spark, sf_dir):
    pages = derived.listing_pages(spark, sf_dir)
    return extract.good_rows(extract.extract_listing(pages, BASE, F.lit("Tea"), thousands=True))


def _extract_rejects(spark, sf_dir):
    return extract.rejects(extract.extract_listing(derived.listing_pages(spark, sf_dir), BASE))


def _extract_detail(spark, sf_dir):
    return extract.extract_detail(
        derived.detail_pages(spark, sf_dir), BASE, with_availability=True
    )


def _product_kv(spark, sf_dir):
    return extract.product_table(derived.detail_pages(spark, sf_dir))


def _extract_categories(spark, sf_dir):
    return extract.extract_categories(derived.sidebar_pages(spark, sf_dir), BASE)


def _category_links(spark, sf_dir):
    return extract.nav_links(derived.table(spark, sf_dir, "pages"), BASE)


def _page_plan(spark, sf_dir):
    counts = derived.page_counts(spark, sf_dir).groupBy("category").agg(F.max("page").alias("pages"))
    index = derived.category_index(spark, sf_dir).join(counts, F.col("name") == F.col("category"))
    return crawl.category_plan(index, F.col("pages"))


def _page_plan_first(spark, sf_dir):
    return crawl.category_plan(derived.category_index(spark, sf_dir), 3, first_page_only=True)


def _contiguous_pages(spark, sf_dir):
    return crawl.contiguous_pages(derived.page_counts(spark, sf_dir))


def _tag_category(spark, sf_dir, **sizes):
    rows = derived.crawled_rows(spark, sf_dir)
    return crawl.tag_category(rows, derived.category_index(spark, sf_dir), **sizes)


def _enrich_listing(spark, sf_dir, **sizes):
    listing = enriched(derived.books(spark, sf_dir)).select(
        "id", "title", "price", "availability", "rating", "url", "category"
    )
    details = derived.details(spark, sf_dir)
    return enrich_listing(listing, details, [F.col("description")], **sizes)


def _union_listings(spark, sf_dir):
    frame = enriched(derived.books(spark, sf_dir))
    listing = frame.select("title", "price", "availability", "rating", "url", "category")
    by_category = listing.where(F.col("category") != "Unknown")
    return extract.union_listings(listing.withColumn("category", F.lit("Unknown")), by_category)


def _load(part):
    def query(spark, sf_dir):
        plan = plan_load(
            derived.load_batch(spark, sf_dir),
            derived.load_target(spark, sf_dir),
            ["price", "tax", "title", "availability"],
        )
        if part == "summary":
            return plan.summary
        if part == "rejected":
            return plan.rejected.select("upc", "title", "price", "category", "reason")
        return plan.accepted.select(
            "upc", "title", "price", "availability", "rating", "category", "tax", "scraped_at"
        )

    return query


def _books_json(spark, sf_dir):
    frame = derived.books(spark, sf_dir)
    empty = {c: F.lit(None).cast("string") for c in ("description", "product_type", "image_url")}
    stamped = frame.withColumns(empty).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return to_json_rows(stamped.select(BOOKS.fieldNames()))


def _lenient_types(spark, sf_dir):
    frame = derived.books(spark, sf_dir)
    raw = frame.select(
        "id",
        F.when(F.col("rating") == 2, F.lit("n/a")).otherwise(F.col("price").cast("string")).alias("price"),
        F.when(F.col("rating") == 3, F.lit("three")).otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(F.col("rating") == 4, F.lit("yesterday"))
        .otherwise(F.col("scraped_at").cast("string"))
        .alias("scraped_at"),
    )
    return lenient_types(raw)


def _price_quantiles(spark, sf_dir):
    """Percentiles per category by histogram narrowing, whatever the size.

    Prices have five decimals, so percentiles at quarters and tenths have up to seven: eight
    keep them off a rounding tie.
    """
    frame = enriched(derived.books(spark, sf_dir))
    found = exact_percentiles(
        frame, "price", [0.1, 0.5, 0.9], ["category"], ["p10", "p50", "p90"], small_group=0
    )
    return _rounded(found, "p10", "p50", "p90", digits=8)


def _stream_daily(spark, sf_dir):
    lines = derived.table(spark, sf_dir, "lineitem")
    folder = derived.in_files(lines, new_folder(spark, "daily-files"))
    reader = spark.readStream.schema(lines.schema)
    reader = reader.option("maxFilesPerTrigger", derived.files_per_batch(spark, folder))
    lines = reader.parquet(folder)
    out = new_folder(spark, "daily")
    books = derived.books(spark, sf_dir, lines)
    query = stream_daily_counts(books, out, new_folder(spark, "daily-state"))
    query.awaitTermination()
    return read_daily_counts(spark, out)


def _stream_ingest(spark, sf_dir):
    pages = _scan_pages(spark, sf_dir)
    folder = derived.in_files(pages, new_folder(spark, "page-files"))
    stream = page_stream(spark, folder, max_files=derived.files_per_batch(spark, folder))
    name = f"books_{uuid.uuid4().hex}"
    table = BooksTable(spark, name, new_folder(spark, "books"))
    table.create()
    ingest = PageIngest(table, BASE, new_folder(spark, "ingest-state"))
    ingest.run(derived.arriving_pages(spark, sf_dir, stream)).awaitTermination()
    ingest.load_waiting()
    return table.read().select("title", "price", "availability", "rating", "url", "category", "upc")


def _load_round_trip(spark, sf_dir):
    table = BooksTable(spark, f"books_{uuid.uuid4().hex}", new_folder(spark, "books"))
    table.create()
    table.load(derived.load_batch(spark, sf_dir), order=["price", "tax", "title", "availability"])
    return table.read().select("id", "upc", "title", "price", "rating", "category", "tax", "scraped_at")


def _crawl_by_category(spark, sf_dir):
    pages = derived.category_crawl(spark, sf_dir)
    scratch = Scratch(spark, "crawl")
    records = crawl_records(pages, BASE, scratch, by_category=True).records
    return records.select(
        "title", "price", "availability", "rating", "url", "category", "upc", "description"
    )


def _catalogue_plan(spark, sf_dir):
    pages = derived.table(spark, sf_dir, "pages").count()
    return crawl.catalogue_plan(spark, BASE, pages)


def _enrich_listing_shuffled(spark, sf_dir):
    return _enrich_listing(spark, sf_dir, max_rows=0)


def _tag_category_shuffled(spark, sf_dir):
    return _tag_category(spark, sf_dir, max_rows=0)


def _load_books_bucketed(spark, sf_dir):
    """As load_books, into a table that is bucketed by UPC."""
    table = BooksTable(spark, f"books_{uuid.uuid4().hex}", new_folder(spark, "books"), buckets=8)
    table.create()
    there = derived.load_target(spark, sf_dir)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in BOOKS if f.name not in ("upc", "id", "title", "price")]
    rows = there.select("upc", F.lit(0).cast("long").alias("id"), F.lit("").alias("title"), F.lit(0.0).alias("price"), *missing)
    table.append(rows)
    order = ["price", "tax", "title", "availability"]
    plan = plan_load(derived.load_batch(spark, sf_dir), table.read(), order)
    return plan.accepted.select(
        "upc", "title", "price", "availability", "rating", "category", "tax", "scraped_at"
    )


def _clustered_books(spark, sf_dir, **within):
    books = derived.books(spark, sf_dir)
    path = new_folder(spark, "clustered-books")
    write_clustered(books, path, ["price", "category", "created_at"], ["upc"], files=8)
    return read_clustered(spark, path, books.schema, within)


def _books_by_price_clustered(spark, sf_dir):
    found = _clustered_books(spark, sf_dir, price=(20.0, 40.0))
    return found.select("id", "title", "price", "category")


def _books_of_a_year_clustered(spark, sf_dir):
    year = ("1995-01-01 00:00:00", "1995-12-31 23:59:59")
    found = _clustered_books(spark, sf_dir, created_at=year, category=("Brand#13", "Brand#13"))
    return found.select("id", "title", "category", "created_at")


def _upc_lookup(spark, sf_dir):
    found = _clustered_books(spark, sf_dir).where(F.col("upc").isin("11", "21", "323", "6401", "59991", "x"))
    return found.select("id", "upc", "title", "price")


def _product_attributes(spark, sf_dir):
    pages = attributes.product_attributes(_product_kv(spark, sf_dir))
    return pages.select(
        "page_id",
        attributes.attribute("upc").alias("upc"),
        attributes.attribute("availability").alias("availability"),
        attributes.attribute("number_of_reviews", "int").alias("number_of_reviews"),
    )


def _attribute_counts(spark, sf_dir):
    return attributes.attribute_keys(attributes.product_attributes(_product_kv(spark, sf_dir)))


def _extract_listing_sql(spark, sf_dir):
    register_extract(spark)
    pages = derived.listing_pages(spark, sf_dir)
    raw = spark.sql("SELECT * FROM extract_records(TABLE({pages}), 'listing')", pages=pages)
    return extract.good_rows(extract.extract_listing(pages, BASE, raw=raw))


def _kept(report):
    """A report from the aggregates of three loads, of which one is run again."""

    def query(spark, sf_dir):
        frame = enriched(derived.books(spark, sf_dir))
        kept = KeptAggregates(spark, new_folder(spark, "kept"))
        year = F.coalesce(F.year("scraped_at"), F.lit(0))
        loads = {"old": year < 1994, "middle": year.between(1994, 1996), "new": year > 1996}
        for name in ("old", "middle", "new", "middle"):
            kept.add(name, frame.where(loads[name]))
        return report(kept, frame)

    return query


def _sketch_check(kept, frame):
    """Per category whether the sketches are within their errors of the exact answers."""
    exact = frame.groupBy("category").agg(
        F.percentile("price", [0.48, 0.52]).alias("around"), F.count_distinct("upc").alias("upcs")
    )
    found = kept.sketched("category").withColumnRenamed("category", "_category")
    both = exact.join(found, F.col("category").eqNullSafe(F.col("_category")))
    near = F.col("median_price").between(F.col("around")[0], F.col("around")[1])
    close = F.abs(F.col("distinct_upcs") - F.col("upcs")) <= F.greatest(F.col("upcs") * 0.06, F.lit(1))
    return both.select("category", near.alias("median_is_near"), close.alias("distinct_is_near"))


def _table_reset(spark, sf_dir):
    """Records in a table before and after it is reset: all books without a UPC are loaded."""
    table = BooksTable(spark, f"books_{uuid.uuid4().hex}", new_folder(spark, "books"))
    table.create()
    books = derived.books(spark, sf_dir).drop("id", "created_at")
    loaded = table.load(books.where(F.col("upc").isNull())).inserted
    before = table.read().agg(F.count("*").alias("n")).first()["n"]
    table.reset(confirm=True)
    after = table.read().agg(F.count("*").alias("after_reset"))
    return after.select(F.lit(loaded).alias("loaded"), F.lit(before).alias("before_reset"), "after_reset")


def _csv_round_trip(spark, sf_dir):
    columns = ["id", "title", "price", "rating"]
    books = derived.books(spark, sf_dir).select(columns)
    path = export_csv(books, new_folder(spark, "csv"), columns)
    return spark.read.schema(books.schema).option("header", True).option("escape", '"').csv(path)


def _unknown_fields(spark, sf_dir):
    batch = derived.books(spark, sf_dir).drop("id", "created_at")
    batch = batch.withColumn("weight", F.when(F.col("rating") == 5, F.col("price")))
    plan = plan_load(batch, derived.load_target(spark, sf_dir))
    return plan.rejected.select("upc", "title", "price", "reason")


_EXPLORE = {"category": "Brand#13", "rating": 4, "min_price": 20.0, "max_price": 60.0}

QUERIES: dict[str, Query] = {
    # Sources and sinks
    "scan_pages": _scan_pages,
    "scan_books": _on_books(lambda b: b),
    "books_json": _books_json,
    "lenient_types": _lenient_types,
    # Extraction and crawl
    "extract_listing": _extract_listing,
    "extract_category_listing": _extract_category_listing,
    "extract_rejects": _extract_rejects,
    "extract_detail": _extract_detail,
    "product_kv": _product_kv,
    "extract_categories": _extract_categories,
    "parse_price": _parse_price,
    "parse_rating": _parse_rating,
    "resolve_urls": _resolve_urls,
    "normalize_keys": _normalize_keys,
    "pivot_product": _pivot_product,
    "category_links": _category_links,
    "page_plan": _page_plan,
    "page_plan_first": _page_plan_first,
    "contiguous_pages": _contiguous_pages,
    "tag_category": _tag_category,
    "tag_category_shuffled": _tag_category_shuffled,
    "enrich_listing": _enrich_listing,
    "enrich_listing_shuffled": _enrich_listing_shuffled,
    "catalogue_plan": _catalogue_plan,
    "crawl_by_category": _crawl_by_category,
    "union_listings": _union_listings,
    "product_attributes": _product_attributes,
    "attribute_counts": _attribute_counts,
    "extract_listing_sql": _extract_listing_sql,
    # Load
    "load_books": _load("accepted"),
    "load_rejects": _load("rejected"),
    "load_summary": _load("summary"),
    "load_round_trip": _load_round_trip,
    "load_books_bucketed": _load_books_bucketed,
    "load_unknown_fields": _unknown_fields,
    "table_reset": _table_reset,
    "csv_round_trip": _csv_round_trip,
    # Filters
    "enriched_books": _on_frame(
        lambda f: f.select("id", "category", "stock_quantity", "in_stock", "price_range", "price")
    ),
    "books_by_price": _on_books(
        lambda b: filters.books_by_price(b, 20.0, 40.0).select("id", "title", "price", "category")
    ),
    "books_by_price_clustered": _books_by_price_clustered,
    "books_of_a_year_clustered": _books_of_a_year_clustered,
    "upc_lookup": _upc_lookup,
    "api_books": _on_books(filters.api_books),
    "api_books_range": _on_books(lambda b: filters.api_books(b, 100, 20.0, 40.0)),
    "api_books_strict": _on_books(lambda b: filters.api_books(b, 50, 90.0, strict=True)),
    "explore": _on_frame(lambda f: filters.explore(f, **_EXPLORE)),
    "explore_capped": _on_frame(
        lambda f: filters.explore(
            f, columns=["title", "id", "stock_quantity"], any_column=True, limit=1000, cut_at=8
        )
    ),
    "explore_counts": _on_frame(lambda f: filters.explore_counts(f, **_EXPLORE)),
    "filter_options": _on_frame(filters.filter_options),
    "usable_columns": _on_frame(
        lambda f: summaries.usable_columns(
            f.withColumn("image_url", F.lit(None).cast("string")),
            [*NUMERIC_COLUMNS, "image_url", "weight"],
        )
    ),
    "top_category_books": _on_frame(
        lambda f: filters.rows_of_top_categories(f).select("id", "title", "price", "category")
    ),
    # Summaries
    "statistics": _on_books(summaries.statistics, "avg_price"),
    "overview_metrics": _on_frame(
        summaries.overview_metrics, "avg_price", "avg_rating", "in_stock_pct"
    ),
    "overview_text": _on_frame(summaries.overview_text),
    "category_counts": _on_frame(summaries.category_counts),
    "category_counts_top": _on_frame(lambda f: summaries.category_counts(f, 15)),
    "category_share": _on_frame(summaries.category_share),
    "rating_counts": _on_frame(summaries.rating_counts),
    "rating_share": _on_frame(summaries.rating_share),
    "stock_status": _on_frame(summaries.stock_status),
    "stock_share": _on_frame(summaries.stock_share),
    "price_range_counts": _on_frame(summaries.price_range_counts),
    "price_range_counts_lowest": lambda spark, sf_dir: summaries.price_range_counts(
        enriched(
            derived.books(spark, sf_dir).withColumn(
                "price", F.when(F.col("rating") == 5, F.lit(0.0)).otherwise(F.col("price"))
            ),
            include_lowest=True,
        )
    ),
    "price_by_top_category": _on_frame(summaries.price_by_top_category, "mean_price"),
    "category_stats": _on_frame(summaries.category_stats),
    "category_stock": _on_frame(summaries.category_stock),
    "avg_price_by_rating": _on_frame(summaries.avg_price_by_rating, "avg_price"),
    "price_center": _on_frame(summaries.price_center, "mean_price", "median_price", digits=8),
    # From aggregates kept per load
    "kept_statistics": _kept(lambda kept, _: _rounded(kept.statistics(), "avg_price")),
    "kept_category_stats": _kept(lambda kept, _: kept.category_stats()),
    "kept_cumulative_counts": _kept(lambda kept, _: kept.cumulative_counts()),
    "kept_sketches": _kept(_sketch_check),
    # Distributions
    "price_histogram": _on_frame(lambda f: distributions.histogram(f, "price", 50)),
    "price_histogram_30": _on_frame(lambda f: distributions.histogram(f, "price", 30)),
    "stock_histogram": _on_frame(lambda f: distributions.histogram(f, "stock_quantity", 20)),
    "price_box_by_rating": _on_frame(
        lambda f: distributions.box_by(f, "price", "rating"),
        *["q1", "median", "q3", "lowest", "highest", "lower_whisker", "upper_whisker"],
        digits=8,
    ),
    "price_quantiles": _price_quantiles,
    "correlation_matrix": _on_frame(
        lambda f: distributions.correlation_matrix(f, [*NUMERIC_COLUMNS, "number_of_reviews"]), "r"
    ),
    "price_rating_ols": _on_frame(
        distributions.price_rating_ols, "slope", "intercept", "r2"
    ),
    "price_rating_ols_sample": _on_frame(
        lambda f: distributions.price_rating_ols(f.select("id", "title", "price", "rating"), on="sample"),
        "slope",
        "intercept",
        "r2",
    ),
    # Rankings and time
    "latest_books": _on_books(
        lambda b: ranking.latest_books(b, 100, ["id", "title", "price", "created_at"])
    ),
    "latest_ten": _on_books(
        lambda b: ranking.latest_books(b, 10, ["title", "price", "rating", "created_at"])
    ),
    "top_expensive": _on_frame(ranking.top_expensive),
    "top_rated": _on_frame(ranking.top_rated),
    "top_expensive_plain": _on_frame(lambda f: ranking.top_expensive(f, suffix="")),
    "best_value": _on_frame(ranking.best_value, "value_score"),
    "sample_books": _on_frame(
        lambda f: ranking.sample_books(f.select("id", "title", "price", "rating"))
    ),
    "daily_counts": _on_frame(timeline.daily_counts),
    "cumulative_counts": _on_frame(timeline.cumulative_counts),
    # Streaming
    "stream_daily_counts": _stream_daily,
    "stream_ingest": _stream_ingest,
}
