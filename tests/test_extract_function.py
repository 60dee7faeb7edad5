import json

import pytest

from pagemart.operators import attributes, extract
from pagemart.operators.extract_function import register_extract
from pagemart.schema import PAGES
from tests.test_extract import BASE, DETAIL, LISTING


@pytest.fixture()
def pages(spark):
    register_extract(spark)
    rows = [(1, BASE, LISTING), (2, BASE + "x", DETAIL), (3, BASE, None), (4, None, "<p>nothing</p>")]
    return spark.createDataFrame(rows, PAGES)


def test_listing_rows_as_by_the_operator(spark, pages):
    raw = spark.sql("SELECT * FROM extract_records(TABLE({pages}), 'listing')", pages=pages)
    assert raw.columns[:4] == ["page_id", "url", "pos", "page_error"]
    found = extract.extract_listing(pages, BASE, raw=raw)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, extract.extract_listing(pages, BASE).collect()))
    assert found.count()


def test_columns_follow_from_a_spec_as_json(spark, pages):
    spec = json.dumps(
        {
            "records": [{"tag": "h3"}],
            "fields": {"name": {"steps": [{"tag": "a"}], "take": "title"}, "links": {"steps": [{"tag": "a"}], "take": "count"}},
        }
    )
    pages.createOrReplaceTempView("pages_of_a_spec")
    found = spark.sql("SELECT * FROM extract_records(TABLE(pages_of_a_spec), :spec)", args={"spec": spec})
    assert found.columns == ["page_id", "url", "pos", "page_error", "name", "links"]
    assert [r["name"] for r in found.where("page_id = 1").orderBy("pos").collect()][0] is not None


def test_pages_are_not_shuffled(spark, pages):
    found = spark.sql("SELECT * FROM extract_records(TABLE({pages}), 'listing')", pages=pages)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("call", ["TABLE({pages}), 'unheard of'", "TABLE(SELECT 1 AS page_id), 'listing'"])
def test_faulty_calls_are_refused(spark, pages, call):
    with pytest.raises(Exception):
        spark.sql(f"SELECT * FROM extract_records({call})", pages=pages)


LINES = [
    (1, 0, "upc", "u1"),
    (1, 1, "binding", "soft"),
    (1, 2, "binding", "hard"),
    (1, 3, 'odd "key"', "é\n"),
    (2, 0, "pages", "120"),
    (2, 1, "binding", None),
    (3, 0, None, "no key"),
]


def test_no_key_of_a_product_table_is_lost(spark):
    lines = spark.createDataFrame(LINES, "page_id long, line int, key string, value string")
    found = attributes.product_attributes(lines)
    rows = found.select(
        "page_id",
        attributes.attribute("binding").alias("binding"),
        attributes.attribute("pages", "int").alias("pages"),
        attributes.attribute("binding", "int").alias("no_number"),
        attributes.attribute('odd "key"').alias("odd"),
    )
    assert sorted(map(tuple, rows.collect())) == [
        (1, "hard", None, None, "é\n"),
        (2, None, 120, None, None),
        (3, None, None, None, None),
    ]
    counts = {r["key"]: r["n"] for r in attributes.attribute_keys(found).collect()}
    assert counts == {"upc": 1, "binding": 2, 'odd "key"': 1, "pages": 1}
    (row,) = attributes.attributes_schema(found).collect()
    assert "binding: STRING" in row["schema"] and "pages: STRING" in row["schema"]
