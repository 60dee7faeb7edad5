"""Number rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemart.schema import PRICE_BINS


def price_range(price: Column, include_lowest: bool = False) -> Column:
    """Label of the price bin, NULL outside (0, 100]."""
    label = F.lit(None).cast("string")
    for index in range(len(PRICE_BINS) - 1, -1, -1):
        low, high, name = PRICE_BINS[index]
        above = price >= low if include_lowest and index == 0 else price > low
        label = F.when(above & (price <= high), F.lit(name)).otherwise(label)
    return label


def value_score(rating: Column, price: Column) -> Column:
    return F.try_divide(rating.cast("double"), price + 1)


def round_half_even(value: Column, digits: int) -> Column:
    """Scale, round to the even neighbour, scale back, as array libraries do."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins between low and high; the last bin is closed."""
    raw = F.floor((value - low) * float(bins) / F.nullif(high - low, F.lit(0.0))) + 1
    return F.when(low == high, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")
