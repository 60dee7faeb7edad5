from pyspark.sql import functions as F

from pagemart.operators import crawl
from pagemart.schema import PAGES
from pagemart.sources.files import Scratch
from pagemart.streaming.ingest import crawl_records

BASE = "https://shop.example/"


def test_catalogue_plan(spark):
    rows = crawl.catalogue_plan(spark, BASE, 3).orderBy("page").collect()
    assert [r["url"] for r in rows] == [
        BASE,
        BASE + "catalogue/page-2.html",
        BASE + "catalogue/page-3.html",
    ]


def test_category_plan(spark):
    categories = spark.createDataFrame([("Art", BASE + "art/index.html", 2), ("None", BASE + "n/index.html", 0)], "name string, url string, n int")
    rows = crawl.category_plan(categories, F.col("n")).orderBy("page").collect()
    assert [tuple(r) for r in rows] == [
        ("Art", 1, BASE + "art/index.html"),
        ("Art", 2, BASE + "art/page-2.html"),
    ]
    assert crawl.category_plan(categories, 9, first_page_only=True).count() == 2


def test_crawl_stops_at_the_first_empty_or_missing_page(spark):
    pages = spark.createDataFrame(
        [
            *[("full", k, 20) for k in range(1, 6)],
            *[("gap", k, 0 if k == 3 else 20) for k in range(1, 6)],
            *[("missing", k, 20) for k in (1, 2, 4, 5)],
            *[("late", k, 20) for k in (2, 3)],
            ("empty", 1, 0),
        ],
        "category string, page int, n_books int",
    )
    for max_rows in (0, 100):
        kept = crawl.contiguous_pages(pages, max_rows=max_rows, sample=1.0)
        counts = {r["category"]: r["count"] for r in kept.groupBy("category").count().collect()}
        assert counts == {"full": 5, "gap": 2, "missing": 2}


def test_rows_get_the_category_of_their_page(spark):
    categories = spark.createDataFrame([("Art", BASE + "art/index.html")], "name string, url string")
    rows = spark.createDataFrame(
        [("a", BASE + "art/index.html", "?"), ("b", BASE + "art/page-12.html", "?"), ("c", BASE, "Unknown")],
        "title string, page_url string, category string",
    )
    got = {r["title"]: r["category"] for r in crawl.tag_category(rows, categories).collect()}
    assert got == {"a": "Art", "b": "Art", "c": "Unknown"}


def pod(number, **pieces):
    return (
        f'<article class="product_pod"><h3><a href="../../../b_{number}/index.html" title="B {number}">..'
        f'</a></h3><p class="price_color">£{number}.5</p></article>'
    )


def test_crawl_by_category(spark):
    """Categories of the sidebar, the stop at an empty page, details on top, and rejects."""
    sidebar = (
        '<div class="side_categories"><a href="all.html">All</a><a href="catalogue/category/art/index.html">Art</a>'
        '<a href="catalogue/category/sea/index.html">Sea</a></div>'
    )
    start = BASE + "catalogue/category/"
    broken = '<article class="product_pod"><p class="price_color">£9.99</p></article>'
    detail = (
        '<ul class="breadcrumb"><li><a href="/">H</a></li><li><a href="/b">B</a></li><li><a href="/p">Maps</a></li></ul>'
        '<table class="table table-striped"><tr><th>UPC</th><td>u{}</td></tr></table>'
    )
    pages = [
        (1, BASE, sidebar),
        (2, start + "art/index.html", pod(1) + broken),
        (3, start + "art/page-2.html", pod(2)),
        (4, start + "art/page-3.html", "<p>nothing</p>"),
        (5, start + "art/page-4.html", pod(4)),
        (6, start + "sea/index.html", pod(6)),
        (7, start + "old/index.html", pod(7)),
        (8, BASE + "catalogue/b_2/index.html", detail.format(2)),
        (9, BASE + "catalogue/b_6/index.html", detail.format(6).replace("Maps", "Sea")),
    ]
    frame = spark.createDataFrame(pages, PAGES)

    def crawled(**options):
        with Scratch(spark) as scratch:
            crawl = crawl_records(frame, BASE, scratch, **options)
            columns = [c for c in ("title", "category", "upc") if c in crawl.records.columns]
            rows = crawl.records.select(columns).collect()
            return sorted(map(tuple, rows)), sorted(map(tuple, crawl.rejects.collect()))

    rows, rejects = crawled(by_category=True)
    assert rows == [("B 1", "Art", None), ("B 2", "Maps", "u2"), ("B 6", "Sea", "u6")]
    assert rejects == [(2, 1, "no title link")]
    assert crawled(by_category=True, include_details=False)[0] == [("B 1", "Art"), ("B 2", "Art"), ("B 6", "Sea")]
    assert [r[0] for r in crawled(by_category=True, max_pages=1)[0]] == ["B 1", "B 6"]
    assert [r[0] for r in crawled()[0]] == ["B 1", "B 2", "B 4", "B 6", "B 7"]
    assert crawled(max_pages=2)[0] == []
