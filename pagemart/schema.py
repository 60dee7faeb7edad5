"""Schemas and column lists of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _D, _I, _L, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampNTZType(),
)

PAGES = _struct(("page_id", _L, True), ("url", _S, True), ("html", _S, True))

LISTING = _struct(
    ("title", _S, True),
    ("price", _D, True),
    ("availability", _S, True),
    ("rating", _I, True),
    ("url", _S, True),
    ("category", _S, True),
)

DETAIL = _struct(
    ("url", _S, True),
    ("category", _S, True),
    ("description", _S, True),
    ("image_url", _S, True),
    ("upc", _S, True),
    ("product_type", _S, True),
    ("price_excl_tax", _D, True),
    ("price_incl_tax", _D, True),
    ("tax", _D, True),
    ("number_of_reviews", _I, True),
)

BOOKS = _struct(
    ("id", _L, False),
    ("title", _S, False),
    ("price", _D, False),
    ("availability", _S, True),
    ("rating", _I, True),
    ("category", _S, True),
    ("url", _S, True),
    ("description", _S, True),
    ("upc", _S, True),
    ("product_type", _S, True),
    ("price_excl_tax", _D, True),
    ("price_incl_tax", _D, True),
    ("tax", _D, True),
    ("number_of_reviews", _I, True),
    ("image_url", _S, True),
    ("scraped_at", _TS, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

# What a record may carry into a load: every column but the ones the table fills in.
RECORD = T.StructType(
    [
        T.StructField(f.name, f.dataType)
        for f in BOOKS
        if f.name not in ("id", "created_at", "updated_at")
    ]
)

API_COLUMNS = ["id", "title", "price", "availability", "rating", "category", "url"]
EXPLORER_COLUMNS = ["title", "price", "rating", "category", "availability", "upc", "url"]
EXPLORER_DEFAULT = ["title", "price", "rating", "category", "availability"]
NUMERIC_COLUMNS = ["price", "rating", "price_excl_tax", "price_incl_tax", "tax"]

# Price bins (low excluded, high included), their labels, rating words,
# and the longest text each column accepts.
PRICE_BINS = [
    (0, 20, "£0-20"),
    (20, 40, "£20-40"),
    (40, 60, "£40-60"),
    (60, 80, "£60-80"),
    (80, 100, "£80+"),
]
RATING_WORDS = ["One", "Two", "Three", "Four", "Five"]
MAX_LENGTH = {
    "title": 500,
    "availability": 100,
    "category": 100,
    "upc": 100,
    "product_type": 100,
}
