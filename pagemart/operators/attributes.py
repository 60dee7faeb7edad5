"""Every key of a product table, known or not, as one VARIANT per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_attributes(lines: DataFrame) -> DataFrame:
    """(page_id, attributes) from (page_id, line, key, value): all keys of a page as an object.

    Of a repeated key the last line counts, as for the typed columns. Values are texts as they
    stand on the page. A page with product lines has a row, even if all its keys are null.
    """
    named = lines.where(F.col("key").isNotNull())
    last = named.groupBy("page_id", "key").agg(F.max(F.struct("line", "value"))["value"].alias("value"))
    pages = last.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs")
    )
    others = lines.select("page_id").distinct().join(pages.select("page_id"), "page_id", "left_anti")
    none = F.array().cast("array<struct<key:string,value:string>>")
    every = pages.unionByName(others.select("page_id", none.alias("pairs")))
    text = F.to_json(F.map_from_entries("pairs"), {"ignoreNullFields": "false"})
    return every.select("page_id", F.parse_json(text).alias("attributes"))


def attribute(name: str, kind: str = "string") -> Column:
    """A key of `attributes` in a type; null if it is absent or does not read as that."""
    quote = "'" if '"' in name else '"'
    if quote in name:
        raise ValueError(f"a path can't have both kinds of quotes: {name}")
    text = F.variant_get("attributes", f"$[{quote}{name}{quote}]", "string")
    return text if kind == "string" else text.try_cast(kind)


def attribute_keys(attributes: DataFrame) -> DataFrame:
    """(key, n): on how many pages each key stands."""
    return attributes.sparkSession.sql(
        "SELECT key, count(*) AS n FROM {pages}, LATERAL variant_explode(attributes) GROUP BY key",
        pages=attributes,
    )


def attributes_schema(attributes: DataFrame) -> DataFrame:
    """(schema): one type that holds the attributes of all pages."""
    return attributes.agg(F.schema_of_variant_agg("attributes").alias("schema"))
