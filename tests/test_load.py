import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pagemart.operators.load import plan_load
from pagemart.schema import BOOKS, RECORD
from pagemart.sources.books import BooksTable, read_books
from pagemart.sources.sinks import export_csv, export_json, to_json_rows


@pytest.fixture()
def table(spark, tmp_path):
    books = BooksTable(spark, f"books_{tmp_path.name.replace('-', '_')}")
    books.create()
    yield books
    books.drop(confirm=True)


def batch_of(spark, *records):
    """Records as (upc, title, price) in the order given."""
    rows = [(place, *record) for place, record in enumerate(records)]
    return spark.createDataFrame(rows, "place int, upc string, title string, price double")


def loaded(table):
    return [(r["id"], r["upc"], r["title"]) for r in table.read().orderBy("id").collect()]


def test_rules_of_a_load(spark, table):
    first = batch_of(spark, ("u1", "one", 1.0), ("u2", "two", 2.0))
    assert table.load(first, ["place"]).inserted == 2
    second = batch_of(
        spark,
        ("u1", "already there", 1.0),
        ("u3", None, 1.0),
        ("u3", "x" * 501, 1.0),
        ("u3", "first valid", 1.0),
        ("u3", "second valid", 1.0),
        (None, "no key", 1.0),
        (None, "no key", 1.0),
        ("", "blank", 1.0),
        ("", "blank again", 1.0),
        ("u4", "no price", None),
        ("u" * 101, "long key", 1.0),
        ("u5", "x" * 500, 1.0),
    )
    result = table.load(second, ["place"])
    assert (result.inserted, result.skipped, result.rejected) == (5, 3, 4)
    assert len(result.first_rejected) == 4
    assert [r[1:] for r in loaded(table)[2:]] == [
        ("u3", "first valid"),
        (None, "no key"),
        (None, "no key"),
        ("", "blank"),
        ("u5", "x" * 500),
    ]
    assert [r[0] for r in loaded(table)] == [1, 2, 3, 4, 5, 6, 7]


def test_second_load_adds_only_records_without_key(spark, table):
    batch = batch_of(spark, ("u1", "one", 1.0), ("", "blank", 1.0), (None, "free", 1.0))
    assert table.load(batch, ["place"]).inserted == 3
    again = table.load(batch, ["place"])
    assert (again.inserted, again.skipped, again.rejected) == (1, 2, 0)


def test_defaults_of_the_table(spark, table):
    table.load(batch_of(spark, ("u1", "one", 1.0)).drop("place"))
    row = table.read().first()
    assert row["number_of_reviews"] == 0 and row["scraped_at"] and row["created_at"] == row["updated_at"]
    assert table.read().columns == BOOKS.fieldNames()


def test_reject_reasons(spark):
    batch = batch_of(spark, (None, None, 1.0), (None, "t", None), (None, "x" * 501, 1.0), (None, "ok", 1.0))
    batch = batch.withColumn("weight", F.when(F.col("title") == "ok", 3))
    target = spark.createDataFrame([], "upc string")
    plan = plan_load(batch.drop("place"), target)
    assert sorted(r["reason"] for r in plan.rejected.collect()) == [
        "price is missing",
        "title is longer than 500",
        "title is missing",
        "unknown field weight",
    ]
    assert plan.summary.first().asDict() == {"inserted": 0, "skipped": 0, "rejected": 4}


def test_hot_key_of_a_batch(spark):
    """A third of the batch is one UPC, a third has none."""
    batch = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("upc"),
        F.concat(F.lit("t"), F.lpad(F.col("id"), 4, "0")).alias("title"),
        F.lit(1.0).alias("price"),
    )
    target = spark.createDataFrame([("1",), ("4",), (None,)], "upc string")
    plan = plan_load(batch, target, ["title"])
    assert plan.summary.first().asDict() == {"inserted": 1999, "skipped": 1001, "rejected": 0}
    assert [r["title"] for r in plan.accepted.where("upc = 'hot'").collect()] == ["t0000"]


def test_insert_one(table):
    assert table.insert({"title": "one", "price": 1.0, "upc": "u1"}) == 1
    assert table.insert({"title": "again", "price": 1.0, "upc": "u1"}) is None
    assert table.insert({"title": None, "price": 1.0}) is None
    assert table.insert({"title": "two", "price": 2.0}) == 2
    with pytest.raises(TypeError):
        table.insert({"title": "three", "price": 1.0, "weight": 2})


def test_drop_needs_confirmation(spark, tmp_path):
    books = BooksTable(spark, "books_at_place", str(tmp_path / "place"))
    books.create()
    books.create()
    books.insert({"title": "one", "price": 1.0})
    assert read_books(spark, str(tmp_path / "place")).count() == 1
    with pytest.raises(ValueError):
        books.drop()
    books.reset(confirm=True)
    assert books.read().count() == 0
    books.drop(confirm=True)
    assert not spark.catalog.tableExists("books_at_place")


def test_exports(spark, table, tmp_path):
    table.insert({"title": 'a "quoted", title', "price": 1.5, "upc": "u1"})
    path = export_csv(table.read(), str(tmp_path / "csv"), ["title", "price", "upc"])
    assert path.rsplit("/", 1)[1].startswith("books_data_")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert [tuple(r) for r in back.collect()] == [('a "quoted", title', "1.5", "u1")]
    (row,) = to_json_rows(table.read()).collect()
    record = json.loads(row["json"])
    assert list(record) == BOOKS.fieldNames()
    assert record["description"] is None and "T" in record["scraped_at"]
    export_json(table.read(), str(tmp_path / "json"))
    (line,) = spark.read.text(str(tmp_path / "json")).collect()
    assert json.loads(line["value"]) == record
    assert set(RECORD.fieldNames()) < set(record)


def test_times_are_utc_in_any_session_zone(spark, table):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        before = datetime.now(timezone.utc).replace(tzinfo=None)
        table.load(batch_of(spark, ("u1", "one", 1.0)), ["place"])
        after = datetime.now(timezone.utc).replace(tzinfo=None)
        (row,) = table.read().collect()
        for name in ("scraped_at", "created_at", "updated_at"):
            assert before - timedelta(seconds=1) <= row[name] <= after + timedelta(seconds=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_small_batch_does_not_shuffle_the_target(spark):
    target = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("upc"))
    batch = batch_of(spark, ("t7", "there", 1.0), ("n1", "new", 2.0))
    plan = plan_load(batch, target, ["place"], cut_target=True)
    assert [r["upc"] for r in plan.accepted.collect()] == ["n1"]
    text = plan.accepted._jdf.queryExecution().optimizedPlan().toString()
    cut = text.index("LeftSemi")
    assert "rightHint=(strategy=broadcast)" in text[cut:]
    whole = plan_load(batch, target, ["place"])
    assert sorted(map(repr, whole.accepted.collect())) == sorted(map(repr, plan.accepted.collect()))
