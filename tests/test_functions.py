from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemart.functions import numbers as N
from pagemart.functions import text as X

BASE = "https://shop.example/"


def values(spark, kind, inputs, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    rows = frame.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.collect()]


V = None


@pytest.fixture(autouse=True)
def input_column(spark):
    """Columns need a session, so V is set when a test starts."""
    global V
    V = F.col("v")


def test_price(spark):
    texts = ["£51.77", "n/a", "£1,234.56", "1.2.3", ".", None, "5."]
    got = values(spark, "string", texts, X.parse_price(V), X.price_is_malformed(V))
    assert got == [
        (51.77, False),
        (0.0, False),
        (1.0, False),
        (None, True),
        (None, True),
        (0.0, False),
        (5.0, False),
    ]
    assert values(spark, "string", ["£1,234.56"], X.parse_price(V, True)) == [1234.56]


def test_rating(spark):
    css = ["star-rating Three", "Five star-rating", "star-rating Threes", "", "One Two"]
    assert values(spark, "string", css, X.parse_rating(V)) == [3, 5, 0, 0, 1]


def test_listing_links(spark):
    hrefs = {
        "http://x/1": "http://x/1",
        "../../../catalogue/a": BASE + "catalogue/a",
        "../../../a/../../../b": BASE + "a/b",
        "../a_1/index.html": BASE + "catalogue/a_1/index.html",
        "catalogue/a": BASE + "catalogue/a",
        "a": BASE + "catalogue/a",
        "": "",
    }
    assert values(spark, "string", list(hrefs), X.resolve_url(V, BASE)) == list(hrefs.values())


def test_category_page_links(spark):
    hrefs = {
        "../../../a/index.html": BASE + "catalogue/a/index.html",
        "../a": BASE + "catalogue/a",
        "catalogue/a": "catalogue/a",
        "http://x": "http://x",
    }
    got = values(spark, "string", list(hrefs), X.resolve_url_in_category(V, BASE))
    assert got == list(hrefs.values())


def test_category_and_image_links(spark):
    hrefs = ["../books/x.html", "catalogue/c.html", "/c.html", "https://y/z"]
    assert values(spark, "string", hrefs, X.resolve_category_link(V, BASE)) == [
        BASE + "books/x.html",
        BASE + "catalogue/c.html",
        BASE + "c.html",
        "https://y/z",
    ]
    assert values(spark, "string", ["../../m/x.jpg", "/m.jpg"], X.resolve_image(V, BASE)) == [
        BASE + "m/x.jpg",
        "/m.jpg",
    ]


def test_strip_and_keys(spark):
    assert values(spark, "string", [" \t\n a b  \x1c", "   ", "x"], X.strip(V)) == ["a b", "", "x"]
    keys = {
        "UPC": "upc",
        "Price (excl. tax)": "price_excl_tax",
        " Number of reviews\n": "number_of_reviews",
    }
    assert values(spark, "string", list(keys), X.normalize_key(V)) == list(keys.values())


def test_int_or_zero(spark):
    assert values(spark, "string", ["12", "many", "", "-3", "1.5"], X.int_or_zero(V)) == [12, 0, 0, 0, 0]


def test_stock(spark):
    texts = ["In stock", "IN STOCK (22 available)", "x 22 y 3", None]
    assert values(spark, "string", texts, X.first_integer(V), X.says_in_stock(V)) == [
        (None, True),
        (22.0, True),
        (22.0, False),
        (None, False),
    ]


def test_cut_and_iso(spark):
    assert values(spark, "string", ["abcdef", "ab", None], X.cut(V, 3)) == ["abc...", "ab...", None]
    assert values(spark, "string", ["abcdef"], X.cut(V, 3, "")) == ["abc"]
    times = [datetime(2024, 5, 1, 10), datetime(2024, 5, 1, 10, 0, 0, 1200), None]
    assert values(spark, "timestamp_ntz", times, X.iso_timestamp(V)) == [
        "2024-05-01T10:00:00",
        "2024-05-01T10:00:00.001200",
        None,
    ]


def test_price_range(spark):
    prices = [0.0, 20.0, 20.01, 100.0, 100.01, None, -1.0]
    got = values(spark, "double", prices, N.price_range(V), N.price_range(V, True))
    assert got == [
        (None, "£0-20"),
        ("£0-20", "£0-20"),
        ("£20-40", "£20-40"),
        ("£80+", "£80+"),
        (None, None),
        (None, None),
        (None, None),
    ]


def test_rounding_agrees_with_the_array_library(spark):
    inputs = [0.125, 0.375, 2.5, 2.675, 1.005, -0.125, 1234.565]
    got = values(spark, "double", inputs, N.round_half_even(V, 2))
    assert got == list(np.round(inputs, 2)) and got[0] == 0.12


@pytest.mark.parametrize("low, high, expected", [(0.0, 10.0, [1, 3, 4]), (5.0, 5.0, [1, 1, 1])])
def test_bin_index(spark, low, high, expected):
    inputs = [0.0, 5.0, 10.0] if high > low else [5.0, 5.0, 5.0]
    assert values(spark, "double", inputs, N.bin_index(V, F.lit(low), F.lit(high), 4)) == expected


def test_value_score_without_denominator(spark):
    assert values(spark, "double", [-1.0, 1.0], N.value_score(F.lit(4), V)) == [None, 2.0]
