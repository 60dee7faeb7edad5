import pytest
from pyspark.sql import functions as F

from pagemart.operators import extract as E
from pagemart.operators.combine import enrich_listing
from pagemart.operators.html_fields import PageSpec, Rule, Step
from pagemart.schema import PAGES

BASE = "https://shop.example/"
LISTING = """
<div class="side_categories"><a href="../books_1/index.html">All</a>
 <a href="catalogue/category/travel_2/index.html"> Travel </a></div>
<article class="product_pod"><p class="star-rating Three"></p>
 <h3><a href="catalogue/a_1/index.html" title="A long title">A long...</a></h3>
 <p class="price_color">£51.77</p><p class="instock availability"> In stock </p></article>
<article class="product_pod"><p class="price_color">£9.99</p></article>
"""
DETAIL = """
<ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/b">Books</a></li><li><a href="/p">Poetry</a></li></ul>
<div class="item active"><img src="../../media/x.jpg"></div>
<div id="product_description"></div><p> Some text. </p>
<table class="table table-striped"><tr><th>UPC</th><td>u1</td></tr><tr><th>Product Type</th><td>Books</td></tr>
<tr><th>Price (excl. tax)</th><td>£51.77</td></tr><tr><th>Price (incl. tax)</th><td>£51.77</td></tr>
<tr><th>Tax</th><td>£0.00</td></tr><tr><th>Availability</th><td>In stock (22 available)</td></tr>
<tr><th>Number of reviews</th><td>0</td></tr></table>
"""


@pytest.fixture()
def pages(spark):
    def make(*htmls):
        rows = [(i, f"{BASE}p{i}", html) for i, html in enumerate(htmls)]
        return spark.createDataFrame(rows, PAGES)

    return make


def detail(pages, html, **options):
    found = E.extract_detail(pages(html), BASE, **options).collect()
    return found[0].asDict() if found else None


def test_listing_page(pages):
    got = E.extract_listing(pages(LISTING, "<p>no books</p>", None), BASE)
    (row,) = E.good_rows(got).drop("page_id").collect()
    assert row.asDict() == {
        "pos": 0,
        "title": "A long title",
        "price": 51.77,
        "availability": "In stock",
        "rating": 3,
        "url": BASE + "catalogue/a_1/index.html",
        "category": "Unknown",
    }
    assert [tuple(r) for r in E.rejects(got).collect()] == [(0, 1, "no title link")]


def test_bad_item_does_not_stop_the_page(pages):
    def pod(price):
        return f'<article class="product_pod"><h3><a href="x">t</a></h3><p class="price_color">{price}</p></article>'

    got = E.extract_listing(pages(pod("£1.2.3") + pod("£2") + pod(".") + pod("free")), BASE)
    assert [(r["pos"], r["price"], r["title"]) for r in E.good_rows(got).collect()] == [(1, 2.0, ""), (3, 0.0, "")]
    assert [r["error"] for r in E.rejects(got).collect()] == ["malformed price"] * 2


def test_class_rules(pages):
    html = """<article class="big product_pod x"><h3><a href="a" title="T &amp; &eacute;">t</a></h3>
      <p class="availability instock">no</p><p class="instock  availability">yes<script>var a="</p>";</script></p>
      <p class="Four star-rating">r</p></article><article class="product_pods"><h3><a>x</a></h3></article>"""
    (row,) = E.good_rows(E.extract_listing(pages(html), BASE)).collect()
    assert (row["title"], row["availability"], row["rating"], row["price"]) == ("T & é", "yes", 4, 0.0)


def test_coded_class_is_not_missed(pages):
    html = '<article class="product&#95;pod"><h3><a href="a" title="T">t</a></h3></article>'
    assert E.good_rows(E.extract_listing(pages(html), BASE)).count() == 1


def test_nested_and_unclosed_elements(pages):
    html = """<p><b>x<br><p><article class="product_pod"><div><h3>q<a href="1" title="outer">
      <article class="product_pod"><h3><a href="2" title="inner"></a></h3></article>"""
    rows = E.good_rows(E.extract_listing(pages(html), BASE)).orderBy("pos").collect()
    assert [r["title"] for r in rows] == ["outer", "inner"]
    deep = "<div>" * 20000 + LISTING
    assert E.good_rows(E.extract_listing(pages(deep), BASE)).count() == 1


def test_category_pages_name_their_rows(pages):
    html = LISTING.replace("catalogue/a_1", "../../../a_1")
    (row,) = E.good_rows(E.extract_listing(pages(html), BASE, F.lit("Travel"))).collect()
    assert (row["category"], row["url"]) == ("Travel", BASE + "catalogue/a_1/index.html")


def test_detail_page(pages):
    got = detail(pages, DETAIL)
    assert got == {
        "page_id": 0,
        "url": BASE + "p0",
        "category": "Poetry",
        "description": "Some text.",
        "image_url": BASE + "media/x.jpg",
        "upc": "u1",
        "product_type": "Books",
        "price_excl_tax": 51.77,
        "price_incl_tax": 51.77,
        "tax": 0.0,
        "number_of_reviews": 0,
        "error": None,
    }
    assert detail(pages, DETAIL, with_availability=True)["availability"] == "In stock (22 available)"


def test_detail_variants(pages):
    short = DETAIL.replace('<li><a href="/p">Poetry</a></li>', "")
    assert detail(pages, short)["category"] == "Unknown"
    assert detail(pages, DETAIL.replace("breadcrumb", "crumbs"))["category"] is None
    assert detail(pages, DETAIL.replace(">0<", ">many<"))["number_of_reviews"] == 0
    assert detail(pages, DETAIL.replace("table table-striped", "table-striped table"))["upc"] is None
    assert detail(pages, DETAIL.replace("../../media", "/media"))["image_url"] == "/media/x.jpg"
    assert detail(pages, DETAIL.replace("£0.00", "£0.0.0"))["error"] == "malformed price"
    assert detail(pages, DETAIL.replace("<p> Some", "<h2>About</h2><p> Some"))["description"] == "Some text."
    repeated = DETAIL.replace("</table>", "<tr><th>UPC</th><td>u2</td></tr><tr><th>x</th></tr></table>")
    assert detail(pages, repeated)["upc"] == "u2"
    assert detail(pages, LISTING) is None


def test_product_table_and_pivot(pages):
    lines = E.product_table(pages(DETAIL, LISTING))
    assert lines.count() == 7 and lines.where("key = 'availability'").count() == 1
    (row,) = E.pivot_product(lines).collect()
    assert row.asDict() == {
        "page_id": 0,
        "upc": "u1",
        "product_type": "Books",
        "price_excl_tax": 51.77,
        "price_incl_tax": 51.77,
        "tax": 0.0,
        "number_of_reviews": 0,
    }


def test_categories_leave_out_the_first_link(pages):
    got = E.extract_categories(pages(LISTING, "<div class='side'><a href='x'>x</a></div>"), BASE)
    assert [tuple(r) for r in got.select("name", "url").collect()] == [
        ("Travel", BASE + "catalogue/category/travel_2/index.html")
    ]


def test_native_links(pages):
    html = '<a href="/all">All</a><a href="../t.html"> T </a><a href="">none</a>'
    assert [tuple(r) for r in E.nav_links(pages(html), BASE).select("pos", "name", "url").collect()] == [
        (1, "T", BASE + "t.html")
    ]


def test_listing_takes_over_detail(pages, spark):
    listing = E.good_rows(E.extract_listing(pages(LISTING), BASE))
    two = listing.unionByName(listing.withColumn("url", F.lit("elsewhere")))
    found = E.extract_detail(pages(DETAIL, DETAIL.replace("Poetry", "Art")), BASE)
    found = found.withColumn("url", F.lit(BASE + "catalogue/a_1/index.html")).drop("error")
    for max_rows in (0, 100):
        rows = enrich_listing(two, found, [F.col("page_id")], max_rows=max_rows, sample=1.0).collect()
        got = {r["url"]: (r["category"], r["upc"], r["title"]) for r in rows}
        assert len(rows) == 2
        assert got[BASE + "catalogue/a_1/index.html"] == ("Poetry", "u1", "A long title")
        assert got["elsewhere"] == ("Unknown", None, "A long title")
    assert E.union_listings(listing, listing, listing).count() == 3


FOREIGN = """<ul class="goods"><li data-n="1"><b>Tea pot</b><a href="/x/1">see</a><i>12.50 EUR</i></li>
<li><b>Cup</b><i>3 EUR</i></li></ul>"""


def test_a_spec_without_markers_reads_every_page(spark):
    """Another site: other elements, no markers, no pairs, and only some of the texts."""
    spec = PageSpec(
        records=(Step("ul", css="goods"), Step("li")),
        fields={
            "title": Rule((Step("b"),)),
            "href": Rule((Step("a"),), "href"),
            "price_text": Rule((Step("i"),)),
        },
    )
    pages = spark.createDataFrame([(1, BASE, FOREIGN), (2, BASE, FOREIGN), (3, BASE, "<p>none</p>")], PAGES)
    raw = E.raw_records(pages, spec)
    assert raw.count() == 4
    rows = E.extract_listing(pages, BASE, spec=spec).orderBy("page_id", "pos").collect()
    assert [(r["title"], r["price"], r["error"]) for r in rows] == [
        ("Tea pot", 12.5, None),
        ("Cup", 3.0, "no title link"),
    ] * 2
    assert {r["availability"] for r in rows} == {"Unknown"} and {r["rating"] for r in rows} == {0}


def test_a_detail_spec_may_have_no_pairs(spark):
    spec = PageSpec(fields={"description": Rule((Step("p"),))})
    pages = spark.createDataFrame([(1, BASE, "<p> Some text. </p>"), (2, BASE, "<div></div>")], PAGES)
    (row,) = E.extract_detail(pages, BASE, spec=spec).collect()
    assert (row["page_id"], row["description"], row["upc"], row["error"]) == (1, "Some text.", None, None)


def test_all_specs_are_read_in_one_pass(spark):
    specs = {"listing": E.LISTING_SPEC, "detail": E.DETAIL_SPEC, "category": E.CATEGORY_SPEC}
    pages = spark.createDataFrame([(1, BASE, LISTING), (2, BASE + "d", DETAIL)], PAGES)
    parsed = E.parse_pages(pages, specs)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for kind, spec in specs.items():
        alone = E.raw_records(pages, spec)
        together = parsed.where(parsed["kind"] == kind).select(alone.columns)
        assert sorted(map(repr, together.collect())) == sorted(map(repr, alone.collect()))
