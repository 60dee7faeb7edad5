"""Extraction as a table function: `SELECT * FROM extract_records(TABLE(pages), 'listing')`.

The columns follow from the spec, which is the name of a known one or a spec as JSON. Texts are
read with the functions of extraction; types and rules are those of the queries that use it. The
table needs no PARTITION BY: without one its rows are read where they are, without a shuffle.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagemart.operators import html_fields
from pagemart.operators.extract import CATEGORY_SPEC, CODED_ATTRIBUTE, DETAIL_SPEC, LISTING_SPEC
from pagemart.operators.html_fields import PageSpec, Rule, Step

# The tasks need this one module; it travels with the job instead of being installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CODED = re.compile(CODED_ATTRIBUTE)
KNOWN = {"listing": LISTING_SPEC, "detail": DETAIL_SPEC, "category": CATEGORY_SPEC}


def spec_of(text: str) -> PageSpec:
    """The spec of a known name, or of JSON such as
    {"records": [{"tag": "li"}], "fields": {"name": {"steps": [{"tag": "a"}], "take": "text"}}}.
    """
    if text in KNOWN:
        return KNOWN[text]
    parts = json.loads(text)
    fields = {
        name: Rule(tuple(Step(**s) for s in rule.get("steps", [])), rule.get("take", "text"), rule.get("default"))
        for name, rule in parts["fields"].items()
    }
    return PageSpec(
        records=tuple(Step(**s) for s in parts.get("records", [])),
        fields=fields,
        markers=tuple(parts.get("markers", [])),
    )


def columns_of(spec: PageSpec) -> T.StructType:
    """page_id, url, pos, page_error and a text for every field."""
    texts = [T.StructField(name, T.StringType()) for name in spec.fields]
    return T.StructType(
        [
            T.StructField("page_id", T.LongType()),
            T.StructField("url", T.StringType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("page_error", T.StringType()),
            *texts,
        ]
    )


class ExtractRecords:
    @staticmethod
    def analyze(pages: AnalyzeArgument, spec: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or spec.value is None:
            raise ValueError("extract_records takes a table of pages and a constant spec")
        missing = {"page_id", "url", "html"} - set(pages.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
        return AnalyzeResult(columns_of(spec_of(spec.value)))

    def __init__(self) -> None:
        self.known: dict[str, PageSpec] = {}

    def eval(self, pages, spec: str) -> Iterator[tuple]:
        if spec not in self.known:
            self.known[spec] = spec_of(spec)
        found, html = self.known[spec], pages["html"] or ""
        if found.markers and not any(m in html for m in found.markers) and not _CODED.search(html):
            return
        for record in html_fields.page_records(pages["html"], found):
            texts = [record.get(name) for name in found.fields]
            yield (pages["page_id"], pages["url"], record["pos"], record["page_error"], *texts)


def register_extract(spark: SparkSession, name: str = "extract_records") -> None:
    """Make the function known to SQL under this name."""
    spark.udtf.register(name, udtf(ExtractRecords))
