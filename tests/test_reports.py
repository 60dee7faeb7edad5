from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemart.operators import distributions as D
from pagemart.operators import filters, ranking, summaries, timeline
from pagemart.operators.enrich import enriched, lenient_types
from pagemart.operators.reports import ReportFrame

DAY = datetime(2024, 5, 1)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.fixture()
def small(books):
    return books(
        [
            (1, "A", 10.0, "In stock (3 available)", 5, "Art", "u1", DAY),
            (2, "B", 30.0, "In stock", 4, None, "u2", DAY),
            (3, "C", 90.0, "Out of stock", None, "Art", None, datetime(2024, 5, 4)),
            (4, "D", 101.0, None, 5, "Bio", None, None),
        ]
    )


def test_enriched(small):
    got = rows_of(
        enriched(small).orderBy("id").select("category", "stock_quantity", "in_stock", "price_range")
    )
    assert got == [
        ("Art", 3.0, True, "£0-20"),
        ("Unknown", None, True, "£20-40"),
        ("Art", None, False, "£80+"),
        ("Bio", None, False, None),
    ]


def test_statistics_of_nothing(small):
    assert rows_of(summaries.statistics(small.where("false"))) == [(0, 0.0, 0.0, 0.0)]
    assert rows_of(summaries.statistics(small)) == [(4, 57.75, 10.0, 101.0)]


def test_overview(small):
    frame = enriched(small)
    got = summaries.overview_metrics(frame).first().asDict()
    assert got["in_stock"] == 2 and got["in_stock_pct"] == 50.0 and got["categories"] == 3
    assert summaries.overview_metrics(frame.where("false")).first()["in_stock_pct"] is None
    assert summaries.overview_metrics(frame, approximate=True).first()["categories"] == 3
    assert summaries.overview_text(frame).first().asDict() == {
        "total_books": "4",
        "avg_price": "£57.75",
        "avg_rating": "4.7/5",
        "in_stock": "2 (50.0%)",
        "categories": "3",
    }


def test_counts_keep_empty_bins_and_drop_unrated(small):
    frame = enriched(small)
    assert rows_of(summaries.price_range_counts(frame)) == [
        ("£0-20", 1),
        ("£20-40", 1),
        ("£40-60", 0),
        ("£60-80", 0),
        ("£80+", 1),
    ]
    assert rows_of(summaries.rating_counts(frame)) == [(4, 1), (5, 2)]
    assert rows_of(summaries.category_counts(frame)) == [("Art", 2), ("Bio", 1), ("Unknown", 1)]


def test_invariants(small):
    frame = enriched(small)
    shares = summaries.category_share(frame).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)
    bins = summaries.price_range_counts(frame).agg(F.sum("n")).first()[0]
    assert bins + frame.where("price_range IS NULL").count() == frame.count()
    stock = summaries.category_stock(frame)
    assert stock.where("in_stock + out_of_stock <> total").count() == 0


def test_categories_of_equal_size_go_by_name(books):
    frame = enriched(books([(i, "T", 1.0, None, 1, c, None, DAY) for i, c in enumerate("cbab")]))
    assert rows_of(summaries.category_counts(frame, 2)) == [("b", 2), ("a", 1)]
    top = filters.rows_of_top_categories(frame, 1)
    assert {r["category"] for r in top.collect()} == {"b"}
    joined = top.groupBy("category").agg(F.avg("price")).count()
    assert joined == summaries.price_by_top_category(frame, 1).count() == 1


def test_usable_columns(small):
    frame = small.withColumn("empty", F.lit(None).cast("double"))
    got = summaries.usable_columns(frame, ["price", "rating", "empty", "absent"])
    assert rows_of(got) == [("price", 4), ("rating", 3)]


def test_histogram(books):
    frame = books([(i, "T", p, None, 1, "c", None, DAY) for i, p in enumerate([0.0, 1.0, 9.0, 10.0])])
    got = [(r["bin"], r["n"]) for r in D.histogram(frame, "price", 5).collect()]
    assert got == [(1, 2), (2, 0), (3, 0), (4, 0), (5, 2)]
    one = D.histogram(frame.where("price = 1"), "price", 5)
    assert [(r["bin"], r["bin_low"], r["bin_high"], r["n"]) for r in one.collect()] == [(1, 1.0, 1.0, 1)]
    assert D.histogram(frame.where("false"), "price", 5).count() == 0


def test_box(books):
    prices = [1.0, 2.0, 3.0, 4.0, 100.0]
    frame = books([(i, "T", p, None, 3, "c", None, DAY) for i, p in enumerate(prices)])
    for size in (0, 10):
        got = D.box_by(frame, "price", "rating", small_group=size).first().asDict()
        assert (got["q1"], got["median"], got["q3"]) == (2.0, 3.0, 4.0)
        assert (got["lower_whisker"], got["upper_whisker"], got["outliers"]) == (1.0, 4.0, 1)


def test_correlation_of_awkward_columns(spark):
    frame = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None, 1.0), (2.0, 4.0, 5.0, None, None), (3.0, 6.0, 5.0, None, None)],
        "a double, b double, constant double, empty double, single double",
    )
    cells = {
        (r["x"], r["y"]): r["r"]
        for r in D.correlation_matrix(frame, ["a", "b", "constant", "empty", "single", "absent"]).collect()
    }
    assert {x for x, _ in cells} == {"a", "b", "constant", "single"}
    assert len(cells) == 16
    assert cells["a", "b"] == pytest.approx(1.0) and cells["b", "a"] == pytest.approx(1.0)
    assert cells["a", "a"] == pytest.approx(1.0)
    assert cells["a", "constant"] is None and cells["constant", "constant"] is None
    assert cells["a", "single"] is None
    assert D.correlation_matrix(frame, ["a", "empty"]).count() == 0


def test_trend_line(books):
    frame = books([(i, "T", 2.0 * r + 1, None, r, "c", None, DAY) for i, r in enumerate([1, 2, 3, 5])])
    line = D.price_rating_ols(frame).first()
    assert (line["slope"], line["intercept"], line["r2"]) == pytest.approx((2.0, 1.0, 1.0))
    assert D.price_rating_ols(frame, on="sample").first()["n"] == 4
    flat = D.price_rating_ols(frame.withColumn("rating", F.lit(3))).first()
    assert flat["slope"] is None


def test_latest_puts_undated_first(small):
    assert [r["id"] for r in ranking.latest_books(small).collect()] == [4, 3, 1, 2]
    assert ranking.latest_books(small, 0).count() == 4
    assert [r["id"] for r in ranking.latest_books(small, 2).collect()] == [4, 3]


def test_top_lists(small):
    frame = enriched(small)
    assert [r["title"] for r in ranking.top_expensive(frame, 2).collect()] == ["D...", "C..."]
    assert [r["title"] for r in ranking.top_rated(frame, suffix="").collect()] == ["D", "A"]
    best = ranking.best_value(frame, 4).collect()
    assert best[0]["title_short"] == "A..." and best[-1]["value_score"] is None


def test_sample_is_repeatable(spark):
    frame = spark.range(2000)
    one, two = ranking.sample_books(frame, 500, 1), ranking.sample_books(frame.repartition(5), 500, 1)
    assert sorted(rows_of(one)) == sorted(rows_of(two)) and one.distinct().count() == 500
    assert sorted(rows_of(one)) != sorted(rows_of(ranking.sample_books(frame, 500, 2)))
    assert ranking.sample_books(frame.limit(7), 500).count() == 7


def test_days(small):
    assert [(str(r[0]), r[1], r[2]) for r in timeline.cumulative_counts(small).collect()] == [
        ("2024-05-01", 2, 2),
        ("2024-05-04", 1, 3),
    ]


def test_api_list(small):
    both = filters.api_books(small.withColumn("url", F.lit("u")), 1, 10.0, 90.0)
    assert sorted(r["id"] for r in both.collect()) == [1, 2, 3]
    single = filters.api_books(small.withColumn("url", F.lit("u")), 2, 100.0)
    assert [r["id"] for r in single.collect()] == [4, 3]
    strict = filters.api_books(small.withColumn("url", F.lit("u")), 2, 20.0, strict=True)
    assert [r["id"] for r in strict.collect()] == [4, 3]


def test_explorer(small):
    frame = enriched(small)
    assert filters.explore(frame).count() == 4
    assert filters.explore(frame, "Art", 5, 0, 50, ["title", "upc"]).collect()[0].asDict() == {
        "title": "A",
        "upc": "u1",
    }
    with pytest.raises(ValueError):
        filters.explore(frame, columns=["id"])
    assert filters.explore(frame, columns=["id"], any_column=True, limit=2).count() == 2
    assert rows_of(filters.explore_counts(frame, "Art")) == [(2, 4)]


def test_filter_options(small):
    got = {(r["option"], r["value"]) for r in filters.filter_options(enriched(small)).collect()}
    assert got == {
        ("category", "Art"),
        ("category", "Bio"),
        ("category", "Unknown"),
        ("rating", "4"),
        ("rating", "5"),
        ("max_price", None),
    }


def test_lenient_types(spark):
    raw = spark.createDataFrame(
        [("1.5", "4", "2024-05-01 10:00:00"), ("x", None, "never")],
        "price string, rating string, scraped_at string",
    )
    assert rows_of(lenient_types(raw)) == [
        (1.5, 4, datetime(2024, 5, 1, 10)),
        (0.0, 0, None),
    ]


def test_report_frame_is_cached_until_cleared(small):
    reports = ReportFrame(small)
    assert not reports.is_empty and reports.frame.storageLevel.useMemory
    first = reports.frame
    reports.clear()
    assert not first.storageLevel.useMemory and reports.frame.storageLevel.useDisk
    reports.clear()


@pytest.mark.parametrize("value", [float("inf"), float("-inf"), float("nan")])
def test_a_histogram_needs_a_finite_range(spark, value):
    frame = spark.createDataFrame([(1.0,), (value,), (3.0,)], "price double")
    with pytest.raises(ValueError, match="finite"):
        D.histogram(frame, "price", 5)


def test_a_sample_is_fair_to_repeated_rows(spark):
    equal = spark.range(1000).select(F.lit(-1).cast("long").alias("id"), F.lit("same").alias("title"))
    other = spark.range(1000).select("id", F.lit("other").alias("title"))
    frame = equal.unionByName(other)
    for seed in range(4):
        drawn = ranking.sample_books(frame, n=500, seed=seed)
        assert drawn.count() == 500
        assert 190 < drawn.where("id = -1").count() < 310
    assert ranking.sample_books(frame, n=5000).count() == 2000


def test_a_capped_table_shows_the_newest_rows(spark):
    frame = spark.range(20).select(
        F.concat(F.lit("t"), F.col("id")).alias("title"),
        F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.col("id").cast("int") + 1, F.lit(0), F.lit(0), F.lit(0)).alias(
            "created_at"
        ),
        F.lit("c").alias("category"),
        F.lit(3).alias("rating"),
        F.lit(1.0).alias("price"),
    )
    shown = filters.explore(frame, columns=["title"], limit=3).collect()
    assert [r["title"] for r in shown] == ["t19", "t18", "t17"]


def test_correlation_reads_rows_as_they_are(spark):
    frame = spark.range(9).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    found = D.correlation_matrix(frame, ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The only expansion is above the aggregate, of its one row.
    assert plan.count("Generate") <= 2 and plan.rindex("Generate") < plan.index("Aggregate")
    assert {(r["x"], r["y"]): round(r["r"], 9) for r in found.collect()} == {
        (x, y): 1.0 for x in "ab" for y in "ab"
    }
