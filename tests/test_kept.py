import pytest
from pyspark.sql import functions as F

from pagemart.operators import summaries, timeline
from pagemart.operators.enrich import enriched
from pagemart.operators.kept import KeptAggregates


@pytest.fixture()
def frame(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101).cast("double")).alias("price"),
        F.when(F.col("id") % 3 == 0, "In stock (3 available)").otherwise("Out of stock").alias("availability"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 6).cast("int")).alias("rating"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 23)).alias("category"),
        F.concat(F.lit("u"), F.col("id") % 1700).alias("upc"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).cast("timestamp_ntz").alias("scraped_at"),
    )
    return enriched(rows)


@pytest.fixture()
def kept(spark, frame, tmp_path):
    found = KeptAggregates(spark, str(tmp_path / "kept"))
    for name, part in (("a", "id < 500"), ("b", "id >= 500 AND id < 510"), ("c", "id >= 510"), ("b", "id >= 500 AND id < 510")):
        found.add(name, frame.where(part))
    return found


def rows(frame, digits=9):
    return sorted(repr([round(v, digits) if isinstance(v, float) else v for v in r]) for r in frame.collect())


def test_reports_equal_a_scan_of_all_books(frame, kept):
    def check():
        assert rows(kept.statistics()) == rows(summaries.statistics(frame))
        assert rows(kept.category_stats(10)) == rows(summaries.category_stats(frame, 10))
        assert rows(kept.cumulative_counts()) == rows(timeline.cumulative_counts(frame))
        for key in ("rating", "price_range", "in_stock"):
            assert rows(kept.counts(key)) == rows(frame.groupBy(key).agg(F.count("*").alias("n")))

    check()
    kept.compact()
    check()


def test_reports_read_the_states_only(frame, kept):
    plan = kept.category_stats()._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan
    files = kept.category_stats().inputFiles()
    assert files and all("/sums/load=" in f for f in files)
    assert kept.merged().count() < frame.count()


def test_merged_sketches_are_near_the_exact_answers(frame, kept):
    for start, end in ((None, None), ("2024-01-10", "2024-01-20")):
        span = frame
        if start:
            span = frame.where(F.to_date("scraped_at").between(start, end))
        found = {r["category"]: r for r in kept.sketched("category", start, end).collect()}
        exact = span.groupBy("category").agg(
            F.percentile("price", [0.46, 0.54]).alias("around"), F.count_distinct("upc").alias("upcs")
        )
        for row in exact.collect():
            got = found.pop(row["category"])
            assert row["around"][0] <= got["median_price"] <= row["around"][1]
            assert abs(got["distinct_upcs"] - row["upcs"]) <= max(1, 0.06 * row["upcs"])
        assert not found


def test_sketches_merge_like_one(spark, frame, kept, tmp_path):
    once = KeptAggregates(spark, str(tmp_path / "once"))
    once.add("all", frame)
    split = {r["category"]: r["distinct_upcs"] for r in kept.sketched("category").collect()}
    assert split == {r["category"]: r["distinct_upcs"] for r in once.sketched("category").collect()}
