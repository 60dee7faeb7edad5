"""Listing rows completed with the detail of their book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemart.plans.lookup import first_per_key, lookup_join
from pagemart.schema import DETAIL

_DETAIL_COLUMNS = [f.name for f in DETAIL if f.name != "url"]


def enrich_listing(
    listing: DataFrame, detail: DataFrame, order: list[Column] | None = None, **sizes
) -> DataFrame:
    """Every listing row with the detail of its url; a detail value overrides the listing's.

    A book without detail keeps its row. Several details of one url: the first by `order`.
    """
    columns = [c for c in _DETAIL_COLUMNS + ["availability"] if c in detail.columns]
    places = [c.alias(f"_place_{i}") for i, c in enumerate(order or [])]
    by = [F.col(f"_place_{i}") for i in range(len(places))]
    one = first_per_key(detail.select("url", *columns, *places), "url", by)
    one = one.select("url", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = lookup_join(listing, one, "url", **sizes)
    values = {
        c: F.coalesce(f"_{c}", c) if c in listing.columns else F.col(f"_{c}") for c in columns
    }
    return joined.withColumns(values).drop(*[f"_{c}" for c in columns])
