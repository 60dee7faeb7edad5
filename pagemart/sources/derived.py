"""Catalogue inputs derived from the shared test tables by Spark.

Every frame grows with the table it comes from and covers all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemart.plans.parallel import spread
from pagemart.schema import PAGES

BASE_URL = "https://shop.example/"

_BOOKS = """
SELECT l_orderkey * 10 + l_linenumber AS id,
       {title} AS title,
       {price} AS price,
       CASE WHEN l_linestatus = 'O'
              THEN concat('In stock (', CAST(CAST(l_quantity AS INT) AS STRING), ' available)')
            WHEN l_returnflag = 'N' THEN NULL
            WHEN l_returnflag = 'A' THEN 'In stock'
            ELSE 'Out of stock' END AS availability,
       CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0
            ELSE l_linenumber END AS rating,
       {category} AS category,
       concat('https://shop.example/catalogue/', CAST(p_partkey AS STRING), '/index.html') AS url,
       CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''
            ELSE CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS upc,
       l_extendedprice / 1000 AS price_excl_tax,
       l_extendedprice / 1000 * (1 + l_tax) AS price_incl_tax,
       l_extendedprice / 1000 * l_tax AS tax,
       0 AS number_of_reviews,
       l_shipdate AS scraped_at,
       l_shipdate AS created_at
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

_PLAIN = {
    "title": "concat(p_name, ' ', p_type)",
    "price": "l_extendedprice / 1000",
    "category": "NULLIF(p_brand, 'Brand#1')",
}
_FAULTY = {
    "title": """CASE WHEN l_returnflag = 'R' AND l_linenumber = 5
              THEN repeat(concat(p_name, ' ', p_type), 60)
            WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN NULL
            ELSE concat(p_name, ' ', p_type) END""",
    "price": "CASE WHEN l_extendedprice <= 100000 THEN l_extendedprice / 1000 END",
    "category": """CASE WHEN l_returnflag = 'A' AND l_linenumber = 3
              THEN repeat(NULLIF(p_brand, 'Brand#1'), 20)
            ELSE NULLIF(p_brand, 'Brand#1') END""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One book per order line; ids repeat, categories, ratings and UPCs have gaps."""
    lines = table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    return spark.sql(_BOOKS.format(**_PLAIN), lineitem=lines, part=table(spark, sf_dir, "part"))


def load_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books as a load batch, some of them without price or title or with long texts."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    rows = spark.sql(_BOOKS.format(**_FAULTY), lineitem=lines, part=table(spark, sf_dir, "part"))
    return rows.drop("id", "created_at")


def load_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPCs of an earlier load: the books scraped before 1999."""
    early = books(spark, sf_dir).where(F.col("scraped_at") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return early.where(F.col("upc").isNotNull()).select("upc").distinct()


def _texts(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listing_pages(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """The crawled pages with one product pod per navigation link put in after the navigation,
    followed by one pod without a heading."""
    if pages is None:
        pages = spread(spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet"))
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))

    def pod(_link: Column, place: Column) -> Column:
        name = _texts(F.col("page_id"), "-", place)
        word = F.element_at(
            F.array(*[F.lit(w) for w in ("Zero", "One", "Two", "Three", "Four", "Five")]),
            (place % 6 + 1).cast("int"),
        )
        href = (
            F.when(place == 0, _texts("http://x/", name))
            .when(place == 1, _texts("../../../catalogue/", name, "/index.html"))
            .when(place == 2, _texts("../", name, "/index.html"))
            .otherwise(_texts(name, "/index.html"))
        )
        price = (
            F.when(place == 3, F.lit("free"))
            .when(place == 4, F.lit("£1,234.56"))
            .otherwise(_texts("£", F.col("page_id"), ".5 each"))
        )
        stock = F.when(
            place != 5, F.lit('<p class="instock availability">\n  <i></i> In stock\n</p>')
        ).otherwise(F.lit(""))
        return _texts(
            '<article class="product_pod"><p class="star-rating ', word, '"></p><h3><a href="',
            href, '" title="Tea &amp; Co ', name, '">Tea</a></h3><p class="price_color">',
            price, "</p>", stock, "</article>",
        )

    broken = F.lit('<article class="product_pod"><p class="price_color">£9.99</p></article>')
    pods = F.concat(F.array_join(F.transform(links, pod), ""), broken)
    return pages.withColumn("html", F.replace("html", F.lit("</nav>"), F.concat(F.lit("</nav>"), pods)))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product page per part, in the variants a product page comes in."""
    part = spread(table(spark, sf_dir, "part"))
    size = F.col("p_size")
    crumb = F.when(size > 10, _texts('<li><a href="/c"> ', F.col("p_brand"), "</a></li>")).otherwise("")
    crumbs = F.when(
        size > 5,
        _texts(
            '<ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/b">Books</a></li>',
            crumb, "</ul>",
        ),
    ).otherwise("")
    src = F.when(size > 40, F.lit("../../media/")).otherwise(F.lit("https://img.example/"))
    price = _texts("£", F.col("p_retailprice"))
    reviews = F.when(size > 30, size.cast("string")).otherwise("many")
    css = F.when(size == 20, "table-striped table").otherwise("table table-striped")
    html = _texts(
        crumbs,
        '<div class="item active"><img src="', src, F.col("p_partkey"), '.jpg"></div>',
        '<div id="product_description"></div><h2>About</h2><p> A ', F.col("p_name"), " &amp; more. </p>",
        '<table class="', css, '"><tr><th>UPC</th><td>u', F.col("p_partkey"), "</td></tr>",
        "<tr><th>Product Type</th><td> ", F.col("p_type"), "</td></tr>",
        "<tr><th>Price (excl. tax)</th><td>", price, "</td></tr>",
        "<tr><th>Price (incl. tax)</th><td>", F.when(size == 50, "£1.2.3").otherwise(price),
        "</td></tr><tr><th>Tax</th><td>£0.00</td></tr><tr><th>Note</th></tr>",
        "<tr><th>Availability</th><td>In stock (", size, " available)</td></tr>",
        "<tr><th>Number of reviews</th><td>", reviews, "</td></tr></table>",
    )
    url = _texts(BASE_URL + "catalogue/", F.col("p_partkey"), "/index.html")
    return part.select(F.col("p_partkey").alias("page_id"), url.alias("url"), html.alias("html"))


def arriving_pages(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """The listing pages, and after each the product page of its fourth item."""
    url = _texts(BASE_URL + "catalogue/", F.col("page_id"), "-3/index.html")
    html = _texts(
        '<ul class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/b">Books</a></li>',
        '<li><a href="/t">Tea</a></li></ul><table class="table table-striped"><tr><th>UPC</th><td>u',
        F.col("page_id"), "</td></tr></table>",
    )
    products = pages.select((-F.col("page_id") - 1).alias("page_id"), url.alias("url"), html.alias("html"))
    return listing_pages(spark, sf_dir, pages).unionByName(products)


def in_files(df: DataFrame, folder: str, files: int = 4) -> str:
    """The frame in so many files or more, for streams that take some at a time.

    A scan with as many tasks is written as it is read. Rows of a smaller one are dealt by their
    place: no task sorts its rows for that, as a plain repartition would.
    """
    if df.rdd.getNumPartitions() < files:
        df = df.repartition(files, F.monotonically_increasing_id())
    df.write.parquet(folder)
    return folder


def files_per_batch(spark: SparkSession, folder: str, batches: int = 4) -> int:
    """How many files a stream takes at a time to read a folder in about so many batches."""
    return max(1, -(-len(spark.read.parquet(folder).inputFiles()) // batches))


def category_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category pages with a pod per part, a page with the sidebar, and the product pages.

    A category's pages end where one is missing.
    """
    part = table(spark, sf_dir, "part")
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    start = _texts(BASE_URL + "catalogue/category/", slug, "/")
    page = (F.col("p_size") % 6 + 1).cast("int")
    pod = _texts(
        '<article class="product_pod"><p class="star-rating Three"></p><h3><a href="../../../',
        F.col("p_partkey"), '/index.html" title="', F.col("p_name"), '">..</a></h3><p class="price_color">£',
        F.col("p_retailprice"), '</p><p class="instock availability">In stock</p></article>',
    )
    pods = part.select("p_partkey", "p_brand", start.alias("start"), page.alias("page"), pod.alias("pod"))
    pods = pods.where(F.col("page") != F.length("p_brand") % 5 + 4)
    name = F.when(F.col("page") == 1, "index.html").otherwise(_texts("page-", F.col("page"), ".html"))
    pages = pods.groupBy("start", "page").agg(
        F.min("p_partkey").alias("page_id"),
        F.array_sort(F.collect_list(F.struct("p_partkey", "pod"))).alias("pods"),
    )
    pages = pages.select(
        (F.col("page_id") + 10**9).alias("page_id"),
        F.concat("start", name).alias("url"),
        F.array_join(F.transform("pods", lambda p: p["pod"]), "").alias("html"),
    )
    link = _texts('<a href="', F.col("url"), '">', F.col("name"), "</a>")
    links = category_index(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("links"))
    sidebar = links.select(
        F.lit(0).cast("long").alias("page_id"),
        F.lit(BASE_URL).alias("url"),
        _texts('<div class="side_categories"><a href="/all">All</a>', F.col("links"), "</div>").alias("html"),
    )
    return pages.unionByName(sidebar).unionByName(detail_pages(spark, sf_dir))


def sidebar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages with their navigation inside a category sidebar."""
    pages = spread(spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet"))
    opened = F.replace("html", F.lit("<nav>"), F.lit('<div class="side_categories"><nav>'))
    return pages.withColumn("html", F.replace(opened, F.lit("</nav>"), F.lit("</nav></div>")))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the books by url, several per url where a part has more than one size line."""
    part = table(spark, sf_dir, "part")
    copies = F.when(F.col("p_size") > 25, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return part.where(F.col("p_size") != 7).select(
        _texts(BASE_URL + "catalogue/", F.col("p_partkey"), "/index.html").alias("url"),
        F.when(F.col("p_size") > 10, F.col("p_type")).alias("category"),
        F.explode(copies).alias("copy"),
        F.col("p_size").alias("number_of_reviews"),
    ).select(
        "url",
        "category",
        _texts("copy ", F.col("copy")).alias("description"),
        "number_of_reviews",
        "copy",
    )


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories (name, url) of the parts."""
    brand = F.col("p_brand")
    address = _texts(BASE_URL + "catalogue/category/", F.lower(F.replace(brand, F.lit("#"), F.lit("_"))), "/index.html")
    return table(spark, sf_dir, "part").select(brand.alias("name"), address.alias("url")).distinct()


def crawled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as found on the pages of their category; a book without category is on page 1 of
    the catalogue."""
    slug = F.lower(F.replace("category", F.lit("#"), F.lit("_")))
    page = F.col("rating") + 1
    name = F.when(page == 1, "index.html").otherwise(_texts("page-", page, ".html"))
    address = F.coalesce(_texts(BASE_URL + "catalogue/category/", slug, "/", name), F.lit(BASE_URL))
    return books(spark, sf_dir).select("id", "title", "price", address.alias("page_url"), F.lit("Unknown").alias("category"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books per category and page, with an empty page inside each run."""
    page = (F.col("id") % 12 + 1).cast("int")
    counted = books(spark, sf_dir).select(
        F.coalesce("category", F.lit("Unknown")).alias("category"), page.alias("page")
    )
    gap = F.length("category") % 5 + 4
    return counted.groupBy("category", "page").agg(
        F.count_if(F.col("page") != gap).alias("n_books")
    )


def product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product table lines of every part: labels as printed, values as text."""
    labels = [
        ("UPC", _texts("u", F.col("p_partkey"))),
        (" Product Type ", F.col("p_type")),
        ("Price (excl. tax)", _texts("£", F.col("p_retailprice"))),
        ("Price (incl. tax)", _texts("£", F.col("p_retailprice"), " only")),
        ("Tax", F.lit("none")),
        ("Availability", F.lit("In stock")),
        ("Number of reviews", F.when(F.col("p_size") > 30, F.col("p_size").cast("string")).otherwise("many")),
        ("UPC", F.when(F.col("p_size") > 40, _texts("v", F.col("p_partkey")))),
    ]
    lines = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in labels])
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("page_id"), F.posexplode(lines).alias("line", "l")).select(
        "page_id", "line", "l.label", "l.value"
    ).where(F.col("value").isNotNull())
