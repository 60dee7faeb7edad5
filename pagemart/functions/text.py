"""Text rules of page extraction and of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemart.schema import RATING_WORDS

# The characters that count as white space in page texts.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop white space at both ends, tabs, newlines and no-break spaces included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def number_token(text: Column, thousands: bool = False) -> Column:
    """First run of digits and dots; NULL when there is none."""
    if thousands:
        text = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3})", "")
    return F.regexp_substr(text, F.lit(r"[0-9.]+"))


def parse_price(text: Column, thousands: bool = False) -> Column:
    """Number in a price text: 0.0 without a number, NULL for a malformed one."""
    token = number_token(text, thousands)
    return F.when(token.isNull(), F.lit(0.0)).otherwise(token.try_cast("double"))


def price_is_malformed(text: Column, thousands: bool = False) -> Column:
    """A run of digits and dots is there but is no number, such as '1.2.3' or '.'."""
    token = number_token(text, thousands)
    return token.isNotNull() & token.try_cast("double").isNull()


def parse_rating(css_class: Column) -> Column:
    """Rating word among the class tokens, as 1 to 5, the lowest of several; 0 without one."""
    words = F.array(*[F.lit(word) for word in RATING_WORDS])
    token = rf"(?<!\S)({'|'.join(RATING_WORDS)})(?!\S)"
    found = F.regexp_extract_all(css_class, F.lit(token), F.lit(0))
    lowest = F.array_min(F.transform(found, lambda word: F.array_position(words, word)))
    return F.coalesce(lowest, F.lit(0)).cast("int")


def _without(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def resolve_url(href: Column, base: str) -> Column:
    """Absolute address of a book link on a listing page; an empty link stays empty."""
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(""))
        .when(href.startswith("http"), href)
        .when(href.startswith("../../../"), F.concat(F.lit(base), _without(href, "../../../")))
        .when(href.startswith("../"), F.concat(F.lit(base + "catalogue/"), _without(href, "../")))
        .when(href.startswith("catalogue/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "catalogue/"), href))
    )


def resolve_url_in_category(href: Column, base: str) -> Column:
    """The same on a category page, where only links that climb are rewritten."""
    climbed = _without(_without(href, "../../../"), "../")
    return (
        F.when(href.isNull(), F.lit(""))
        .when(href.startswith("../"), F.concat(F.lit(base + "catalogue/"), climbed))
        .otherwise(href)
    )


def resolve_category_link(href: Column, base: str) -> Column:
    """Absolute address of a sidebar category; relative links are joined to the base."""
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("../"), F.concat(F.lit(base), _without(href, "../")))
        .otherwise(F.concat(F.lit(base), F.regexp_replace(href, "^/+", "")))
    )


def resolve_image(src: Column, base: str) -> Column:
    return F.when(
        src.startswith("../../"), F.concat(F.lit(base), _without(src, "../../"))
    ).otherwise(src)


def normalize_key(label: Column) -> Column:
    """Product table label as a column name: 'Price (excl. tax)' gives price_excl_tax."""
    return F.translate(F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_")), "().", "")


def int_or_zero(text: Column) -> Column:
    """All digits give the integer, anything else 0."""
    return F.when(
        text.rlike(r"^[0-9]+$"), F.coalesce(text.try_cast("int"), F.lit(0))
    ).otherwise(F.lit(0))


def first_integer(text: Column) -> Column:
    """First run of digits as a double, NULL when there is none."""
    return F.regexp_substr(text, F.lit(r"[0-9]+")).try_cast("double")


def says_in_stock(availability: Column) -> Column:
    return F.coalesce(F.lower(availability).contains("in stock"), F.lit(False))


def cut(text: Column, length: int, suffix: str = "...") -> Column:
    """First `length` characters; the suffix is added to short texts as well."""
    return F.concat(F.substring(text, 1, length), F.lit(suffix))


def iso_timestamp(ts: Column) -> Column:
    """2024-05-01T10:00:00, with six decimals only when there is a fraction."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
