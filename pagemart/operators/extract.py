"""Pages to listing rows, detail rows, product tables and categories.

Tasks read raw texts out of the HTML (html_fields); everything after that, from numbers to
addresses, is column expressions. Pages without a marker of the wanted elements never leave
the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.functions import text as X
from pagemart.operators import html_fields
from pagemart.operators.enrich import UNKNOWN
from pagemart.operators.html_fields import PageSpec, Rule, Step, page_records
from pagemart.schema import LISTING

# The tasks need this one module; it travels with the job instead of being installed.
cloudpickle.register_pickle_by_value(html_fields)

_LINK = (Step("h3"), Step("a"))

LISTING_SPEC = PageSpec(
    records=(Step("article", css="product_pod"),),
    fields={
        "links": Rule((Step("h3"), Step("a")), "count"),
        "title": Rule(_LINK, "title"),
        "href": Rule(_LINK, "href"),
        "price_text": Rule((Step("p", css="price_color"),)),
        "availability": Rule((Step("p", css="instock availability"),)),
        "rating_class": Rule((Step("p", css="star-rating"),), "class"),
    },
    markers=("product_pod",),
)

_CRUMBS = Step("ul", css="breadcrumb")
_PRODUCT_TABLE = Step("table", css="table table-striped")

DETAIL_SPEC = PageSpec(
    fields={
        "crumbs": Rule((_CRUMBS, Step("a")), "count"),
        "category": Rule((_CRUMBS, Step("a", nth=2))),
        "description": Rule(
            (Step("div", id="product_description"), Step("p", sibling=True))
        ),
        "image_src": Rule((Step("div", css="item active"), Step("img")), "src"),
    },
    pairs=(_PRODUCT_TABLE, Step("tr"), Step("th"), Step("td")),
    markers=("breadcrumb", "product_description", "active", "table-striped"),
)

CATEGORY_SPEC = PageSpec(
    records=(Step("div", css="side_categories"), Step("a")),
    fields={"name": Rule((), "text"), "href": Rule((), "href")},
    markers=("side_categories",),
)

_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
# A class written with character references may hide a marker.
CODED_ATTRIBUTE = r"(?i)(class|id)\s*=[^>]*&"
#: Pages whose records are handed on together.
_CHUNK = 64


def parse_pages(pages: DataFrame, specs: dict[str, PageSpec]) -> DataFrame:
    """(kind, page_id, url, pos, page_error, texts ...) of every record of every page, for all
    specs in one pass over the HTML; `kind` is the name of the spec.

    A page without a marker of any spec never leaves the JVM. A spec without markers reads
    every page.
    """
    names = list(dict.fromkeys(n for spec in specs.values() for n in spec.fields))
    with_pairs = any(spec.pairs for spec in specs.values())
    layout = pa.schema(
        [
            ("kind", pa.string()),
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("pos", pa.int32()),
            ("page_error", pa.string()),
            *[(name, pa.string()) for name in names],
            *([("pairs", _PAIRS)] if with_pairs else []),
        ]
    )
    coded = re.compile(CODED_ATTRIBUTE)

    def wanted(html: str, spec: PageSpec) -> bool:
        return not spec.markers or any(m in html for m in spec.markers) or bool(coded.search(html))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNK):
                rows = []
                for page in batch.slice(start, _CHUNK).to_pylist():
                    for kind, spec in specs.items():
                        if wanted(page["html"] or "", spec):
                            place = {"kind": kind, "page_id": page["page_id"], "url": page["url"]}
                            rows += [place | record for record in page_records(page["html"], spec)]
                yield pa.RecordBatch.from_pylist(rows, schema=layout)

    if all(spec.markers for spec in specs.values()):
        has_marker = F.col("html").rlike(CODED_ATTRIBUTE)
        for marker in dict.fromkeys(m for spec in specs.values() for m in spec.markers):
            has_marker = F.col("html").contains(marker) | has_marker
        pages = pages.where(has_marker)
    return pages.select("page_id", "url", "html").mapInArrow(read, _spark_schema(layout))


def raw_records(pages: DataFrame, spec: PageSpec) -> DataFrame:
    """(page_id, url, pos, page_error, texts ...) for every record of every page."""
    return parse_pages(pages, {"page": spec}).drop("kind")


def _with_texts(raw: DataFrame, spec: PageSpec) -> DataFrame:
    """The raw records with a null for every text of `spec` that another spec left out."""
    missing = {n: F.lit(None).cast("string") for n in spec.fields if n not in raw.columns}
    if spec.pairs and "pairs" not in raw.columns:
        kind = "array<struct<key:string,value:string>>"
        missing["pairs"] = F.lit(None).cast(kind)
    return raw.withColumns(missing) if missing else raw


def _spark_schema(layout: pa.Schema) -> T.StructType:
    kinds = {
        pa.int64(): T.LongType(),
        pa.int32(): T.IntegerType(),
        pa.string(): T.StringType(),
        _PAIRS: T.ArrayType(
            T.StructType([T.StructField(n, T.StringType()) for n in ("key", "value")])
        ),
    }
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in layout])


# The product table keys that become columns.
PRODUCT_KEYS = [
    "upc",
    "product_type",
    "price_excl_tax",
    "price_incl_tax",
    "tax",
    "number_of_reviews",
]


def extract_listing(
    pages: DataFrame,
    base_url: str,
    category: Column | None = None,
    thousands: bool = False,
    spec: PageSpec = LISTING_SPEC,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Listing rows plus page_id, page_url, pos and error (null for a good row).

    With `category` the pages are category pages: rows carry that category and links follow
    the category rule. `raw` are records that were read already. A spec may leave out any
    text; without the count of links a record needs a link.
    """
    raw = raw_records(pages, spec) if raw is None else raw
    columns = listing_columns(base_url, category, thousands, spec)
    return _with_texts(raw, LISTING_SPEC).select(*[c.alias(n) for n, c in columns.items()])


def listing_columns(
    base_url: str,
    category: Column | None = None,
    thousands: bool = False,
    spec: PageSpec = LISTING_SPEC,
) -> dict[str, Column]:
    """The columns of `extract_listing` over raw records."""
    in_category = category is not None
    link = (X.resolve_url_in_category if in_category else X.resolve_url)(F.col("href"), base_url)
    # No link inside the heading, or no heading at all: the item cannot be read.
    no_link = F.coalesce(F.col("links").cast("int"), F.lit(0)) == 0
    if "links" not in spec.fields:
        no_link = F.col("href").isNull()
    error = (
        F.when(F.col("page_error").isNotNull(), F.concat(F.lit("page: "), "page_error"))
        .when(no_link, F.lit("no title link"))
        .when(X.price_is_malformed(F.col("price_text"), thousands), F.lit("malformed price"))
    )
    return {
        "page_id": F.col("page_id"),
        "page_url": F.col("url"),
        "pos": F.col("pos"),
        "title": F.coalesce("title", F.lit("")),
        "price": X.parse_price(F.col("price_text"), thousands),
        "availability": F.coalesce(X.strip(F.col("availability")), F.lit("Unknown")),
        "rating": F.coalesce(X.parse_rating(F.col("rating_class")), F.lit(0)),
        "url": link,
        "category": category if in_category else F.lit(UNKNOWN),
        "error": error,
    }


def good_rows(extracted: DataFrame) -> DataFrame:
    """Rows without an error, reduced to the listing columns and their place."""
    good = extracted.where(F.col("error").isNull())
    return good.select("page_id", "pos", *LISTING.fieldNames())


def rejects(extracted: DataFrame) -> DataFrame:
    """What could not be read, with its place and the reason."""
    return extracted.where(F.col("error").isNotNull()).select("page_id", "pos", "error")


def _last_value(key: str) -> Column:
    """Value of a product table key; a repeated key keeps the last one."""
    same = F.filter("pairs", lambda p: p["key"] == key)
    return X.strip(F.try_element_at(same, F.lit(-1))["value"])


def extract_detail(
    pages: DataFrame,
    base_url: str,
    thousands: bool = False,
    with_availability: bool = False,
    spec: PageSpec = DETAIL_SPEC,
    raw: DataFrame | None = None,
) -> DataFrame:
    """One row per page that holds any detail, with page_id and error (null when good).

    `raw` are records that were read already. A spec may leave out any text and the pairs.
    """
    raw = raw_records(pages, spec) if raw is None else raw
    texts = with_detail_texts(raw)
    found = holds_detail(with_availability)
    columns = detail_columns(base_url, thousands, with_availability)
    return texts.where(found).select("page_id", "url", *[c.alias(n) for n, c in columns.items()])


def with_detail_texts(raw: DataFrame) -> DataFrame:
    """Raw records with normalized keys and the last value of each key, in `_key`."""
    raw = _with_texts(raw, DETAIL_SPEC).withColumn(
        "pairs",
        F.transform(
            "pairs",
            lambda p: F.struct(X.normalize_key(p["key"]).alias("key"), p["value"].alias("value")),
        ),
    )
    return raw.withColumns({f"_{k}": _last_value(k) for k in PRODUCT_KEYS})


def holds_detail(with_availability: bool = False) -> Column:
    """Whether a page holds any detail, asked of its raw texts."""
    known = PRODUCT_KEYS + (["availability"] if with_availability else [])
    has_src = F.coalesce(F.col("image_src"), F.lit("")) != ""
    return (
        F.coalesce("page_error", "crumbs", "description").isNotNull()
        | has_src
        | F.coalesce(F.exists("pairs", lambda p: p["key"].isin(known)), F.lit(False))
    )


def detail_columns(
    base_url: str, thousands: bool = False, with_availability: bool = False
) -> dict[str, Column]:
    """The columns of `extract_detail` after page_id and url, over `with_detail_texts`."""
    has_src = F.coalesce(F.col("image_src"), F.lit("")) != ""
    prices = ["price_excl_tax", "price_incl_tax", "tax"]
    columns = {
        "category": F.when(F.col("crumbs").cast("int") >= 3, X.strip(F.col("category"))).when(
            F.col("crumbs").isNotNull(), F.lit(UNKNOWN)
        ),
        "description": X.strip(F.col("description")),
        "image_url": F.when(has_src, X.resolve_image(F.col("image_src"), base_url)),
        "upc": F.col("_upc"),
        "product_type": F.col("_product_type"),
        **{
            p: F.when(F.col(f"_{p}").isNotNull(), X.parse_price(F.col(f"_{p}"), thousands))
            for p in prices
        },
        "number_of_reviews": F.when(
            F.col("_number_of_reviews").isNotNull(), X.int_or_zero(F.col("_number_of_reviews"))
        ),
    }
    if with_availability:
        columns["availability"] = _last_value("availability")
    malformed = F.lit(False)
    for p in prices:
        malformed = malformed | X.price_is_malformed(F.col(f"_{p}"), thousands)
    columns["error"] = F.when(
        F.col("page_error").isNotNull(), F.concat(F.lit("page: "), "page_error")
    ).when(malformed, F.lit("malformed price"))
    return columns


def product_table(pages: DataFrame, spec: PageSpec = DETAIL_SPEC) -> DataFrame:
    """The product table in long form: one row per page and table line."""
    raw = _with_texts(raw_records(pages, spec), DETAIL_SPEC)
    return raw.select("page_id", F.posexplode("pairs").alias("line", "pair")).select(
        "page_id",
        "line",
        X.normalize_key(F.col("pair.key")).alias("key"),
        X.strip(F.col("pair.value")).alias("value"),
    )


def pivot_product(lines: DataFrame) -> DataFrame:
    """(page_id, line, key, value) rows to one typed row per page; the last of a key wins."""
    wide = (
        lines.where(F.col("key").isin(PRODUCT_KEYS))
        .groupBy("page_id")
        .pivot("key", PRODUCT_KEYS)
        .agg(F.max(F.struct("line", "value"))["value"])
    )
    typed = {p: X.parse_price(F.col(p)) for p in ["price_excl_tax", "price_incl_tax", "tax"]}
    typed = {p: F.when(F.col(p).isNotNull(), c) for p, c in typed.items()}
    reviews = F.when(F.col("number_of_reviews").isNotNull(), X.int_or_zero(F.col("number_of_reviews")))
    return wide.withColumns({**typed, "number_of_reviews": reviews})


def extract_categories(
    pages: DataFrame, base_url: str, raw: DataFrame | None = None
) -> DataFrame:
    """Sidebar categories (page_id, pos, name, url); the first link of a page is left out."""
    links = raw_records(pages, CATEGORY_SPEC) if raw is None else raw
    return (
        links.where((F.col("pos") >= 1) & (F.coalesce("href", F.lit("")) != ""))
        .select(
            "page_id",
            "pos",
            X.strip(F.col("name")).alias("name"),
            X.resolve_category_link(F.col("href"), base_url).alias("url"),
        )
    )


def nav_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Categories from plain `<a href="...">name</a>` links, without leaving the JVM.

    Same rule as the sidebar: the first link of a page is left out.
    """
    link = r'<a href="([^"]*)">([^<]*)</a>'
    hrefs = F.regexp_extract_all("html", F.lit(link), F.lit(1))
    names = F.regexp_extract_all("html", F.lit(link), F.lit(2))
    found = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("name"))))
    return found.where((F.col("pos") >= 1) & (F.col("col.href") != "")).select(
        "page_id",
        "pos",
        X.strip(F.col("col.name")).alias("name"),
        X.resolve_category_link(F.col("col.href"), base_url).alias("url"),
    )


def union_listings(*listings: DataFrame) -> DataFrame:
    """All rows of all listings, duplicates kept."""
    whole, *rest = listings
    for listing in rest:
        whole = whole.unionByName(listing)
    return whole
