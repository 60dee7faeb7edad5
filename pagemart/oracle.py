"""The same queries as plain SQL over the shared tables, for comparison."""

from __future__ import annotations

_BOOKS = """
books AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
         concat(p_name, ' ', p_type) AS title,
         l_extendedprice / 1000 AS price,
         CASE WHEN l_linestatus = 'O'
                THEN concat('In stock (', CAST(CAST(l_quantity AS INT) AS VARCHAR), ' available)')
              WHEN l_returnflag = 'N' THEN NULL
              WHEN l_returnflag = 'A' THEN 'In stock'
              ELSE 'Out of stock' END AS availability,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0
              ELSE l_linenumber END AS rating,
         NULLIF(p_brand, 'Brand#1') AS category,
         concat('https://shop.example/catalogue/', CAST(p_partkey AS VARCHAR), '/index.html') AS url,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''
              ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS upc,
         l_extendedprice / 1000 AS price_excl_tax,
         l_extendedprice / 1000 * (1 + l_tax) AS price_incl_tax,
         l_extendedprice / 1000 * l_tax AS tax,
         0 AS number_of_reviews,
         l_shipdate AS scraped_at,
         l_shipdate AS created_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def _bins(price: str, first: str = ">") -> str:
    return f"""CASE WHEN {price} {first} 0 AND {price} <= 20 THEN '£0-20'
              WHEN {price} > 20 AND {price} <= 40 THEN '£20-40'
              WHEN {price} > 40 AND {price} <= 60 THEN '£40-60'
              WHEN {price} > 60 AND {price} <= 80 THEN '£60-80'
              WHEN {price} > 80 AND {price} <= 100 THEN '£80+' END"""


_FRAME = (
    _BOOKS
    + f""",
frame AS (
  SELECT * REPLACE (coalesce(category, 'Unknown') AS category),
         CAST(nullif(regexp_extract(availability, '[0-9]+'), '') AS DOUBLE) AS stock_quantity,
         coalesce(availability ILIKE '%in stock%', false) AS in_stock,
         {_bins('price')} AS price_range
  FROM books
)"""
)


def _b(sql: str) -> str:
    return f"WITH {_BOOKS}\n{sql}"


def _f(sql: str) -> str:
    return f"WITH {_FRAME}\n{sql}"


def _histogram(column: str, bins: int) -> str:
    return _f(f"""
, v AS (SELECT CAST({column} AS DOUBLE) AS v FROM frame WHERE {column} IS NOT NULL),
lim AS (SELECT min(v) AS low, max(v) AS high FROM v),
counts AS (
  SELECT CAST(least(floor((v - low) * {bins}.0::DOUBLE / (high - low)) + 1, {bins}) AS INT) AS bin,
         count(*) AS n
  FROM v, lim GROUP BY 1
),
edges AS (SELECT CAST(i AS INT) AS bin, low, high, (high - low) / {bins}.0::DOUBLE AS w
          FROM lim, range(1, {bins + 1}) r(i))
SELECT e.bin, low + (e.bin - 1) * w AS bin_low,
       CASE WHEN e.bin = {bins} THEN high ELSE low + e.bin * w END AS bin_high,
       coalesce(n, 0) AS n
FROM edges e LEFT JOIN counts c ON c.bin = e.bin""")


def _share(counts: str) -> str:
    return f"SELECT *, n / sum(n) OVER () AS share FROM ({counts})"


def _price_number(text: str) -> str:
    return f"""CASE WHEN regexp_extract({text}, '[0-9.]+') = '' THEN 0.0::DOUBLE
              ELSE TRY_CAST(regexp_extract({text}, '[0-9.]+') AS DOUBLE) END"""


def _reviews(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '[0-9]+') THEN CAST({text} AS INT) ELSE 0 END"


_LATEST = "ORDER BY created_at DESC NULLS FIRST"

_TOP = """ORDER BY price DESC NULLS LAST, title NULLS FIRST, category NULLS FIRST,
         rating NULLS FIRST LIMIT 10"""

_CATEGORY_COUNTS = "SELECT category, count(*) AS n FROM frame GROUP BY category"
_RATING_COUNTS = "SELECT rating, count(*) AS n FROM frame WHERE rating IS NOT NULL GROUP BY rating"
_STOCK_STATUS = """SELECT CASE WHEN in_stock THEN 'In Stock' ELSE 'Out of Stock' END AS status,
       count(*) AS n FROM frame GROUP BY in_stock"""

_EXPLORE = "category = 'Brand#13' AND rating = 4 AND price >= 20 AND price <= 60"

_NUMERIC = ["price", "rating", "price_excl_tax", "price_incl_tax", "tax", "number_of_reviews"]


def _correlation() -> str:
    cells = []
    for x in _NUMERIC:
        for y in _NUMERIC:
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            spread = f"stddev_samp({x}) FILTER ({both}) * stddev_samp({y}) FILTER ({both})"
            cells.append(
                f"SELECT '{x}' AS x, '{y}' AS y, round(covar_samp({x}, {y}) FILTER ({both})"
                f" / nullif({spread}, 0), 6) AS r FROM frame"
            )
    return _f("\nUNION ALL\n".join(cells))


def _pods(url: str, category: str, thousand: str) -> str:
    return f"""WITH links AS (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages
),
pods AS (
  SELECT page_id, CAST(place AS INT) AS pos, concat(page_id, '-', place) AS name
  FROM (SELECT page_id, unnest(range(0, CAST(len(hrefs) AS BIGINT))) AS place FROM links)
)
SELECT page_id, pos, concat('Tea & Co ', name) AS title,
       CASE WHEN pos = 3 THEN 0.0::DOUBLE WHEN pos = 4 THEN {thousand}::DOUBLE
            ELSE page_id + 0.5::DOUBLE END AS price,
       CASE WHEN pos = 5 THEN 'Unknown' ELSE 'In stock' END AS availability,
       CAST(pos % 6 AS INT) AS rating,
       {url} AS url, '{category}' AS category
FROM pods"""


_LISTING_URL = """CASE WHEN pos = 0 THEN concat('http://x/', name)
            ELSE concat('https://shop.example/catalogue/', name, '/index.html') END"""
_CATEGORY_URL = """CASE WHEN pos = 0 THEN concat('http://x/', name)
            WHEN pos = 1 THEN concat('https://shop.example/catalogue/catalogue/', name, '/index.html')
            WHEN pos = 2 THEN concat('https://shop.example/catalogue/', name, '/index.html')
            ELSE concat(name, '/index.html') END"""

_LINK_ROWS = """
SELECT page_id, CAST(place - 1 AS INT) AS pos,
       {name} AS name,
       CASE WHEN href LIKE 'http%' THEN href
            WHEN href LIKE '../%' THEN concat('https://shop.example/', replace(href, '../', ''))
            ELSE concat('https://shop.example/', regexp_replace(href, '^/+', '')) END AS url
FROM (
  SELECT page_id, unnest(range(1, CAST(len(hrefs) AS BIGINT) + 1)) AS place,
         unnest(hrefs) AS href, unnest(names) AS name
  FROM (SELECT page_id,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS names
        FROM pages)
)
WHERE place > 1 AND href <> ''"""

_DETAIL = """
SELECT p_partkey AS page_id,
       concat('https://shop.example/catalogue/', p_partkey, '/index.html') AS url,
       CASE WHEN p_size > 10 THEN p_brand WHEN p_size > 5 THEN 'Unknown' END AS category,
       concat('A ', p_name, ' & more.') AS description,
       concat(CASE WHEN p_size > 40 THEN 'https://shop.example/media/'
                   ELSE 'https://img.example/' END, p_partkey, '.jpg') AS image_url,
       CASE WHEN p_size <> 20 THEN concat('u', p_partkey) END AS upc,
       CASE WHEN p_size <> 20 THEN p_type END AS product_type,
       CASE WHEN p_size <> 20 THEN p_retailprice END AS price_excl_tax,
       CASE WHEN p_size NOT IN (20, 50) THEN p_retailprice END AS price_incl_tax,
       CASE WHEN p_size <> 20 THEN 0.0::DOUBLE END AS tax,
       CASE WHEN p_size > 30 THEN p_size WHEN p_size <> 20 THEN 0 END AS number_of_reviews,
       CASE WHEN p_size <> 20 THEN concat('In stock (', p_size, ' available)') END AS availability,
       CASE WHEN p_size = 50 THEN 'malformed price' END AS error
FROM part"""

_PRODUCT_KV = """
SELECT p_partkey AS page_id, CAST(line AS INT) AS line, key, value
FROM part, (VALUES (0, 'upc'), (1, 'product_type'), (2, 'price_excl_tax'), (3, 'price_incl_tax'),
                   (4, 'tax'), (5, 'availability'), (6, 'number_of_reviews')) k(line, key),
LATERAL (SELECT CASE line
    WHEN 0 THEN concat('u', p_partkey)
    WHEN 1 THEN p_type
    WHEN 2 THEN concat('£', CAST(p_retailprice AS VARCHAR))
    WHEN 3 THEN CASE WHEN p_size = 50 THEN '£1.2.3'
                     ELSE concat('£', CAST(p_retailprice AS VARCHAR)) END
    WHEN 4 THEN '£0.00'
    WHEN 5 THEN concat('In stock (', p_size, ' available)')
    ELSE CASE WHEN p_size > 30 THEN CAST(p_size AS VARCHAR) ELSE 'many' END END AS value) x
WHERE p_size <> 20"""

_LINES = """
SELECT p_partkey AS page_id, CAST(line AS INT) AS line, key, value
FROM part, (VALUES (0, 'upc'), (1, 'product_type'), (2, 'price_excl_tax'), (3, 'price_incl_tax'),
                   (4, 'tax'), (5, 'availability'), (6, 'number_of_reviews'), (7, 'upc')) k(line, key),
LATERAL (SELECT CASE line
    WHEN 0 THEN concat('u', p_partkey)
    WHEN 1 THEN p_type
    WHEN 2 THEN concat('£', CAST(p_retailprice AS VARCHAR))
    WHEN 3 THEN concat('£', CAST(p_retailprice AS VARCHAR), ' only')
    WHEN 4 THEN 'none'
    WHEN 5 THEN 'In stock'
    WHEN 6 THEN CASE WHEN p_size > 30 THEN CAST(p_size AS VARCHAR) ELSE 'many' END
    ELSE CASE WHEN p_size > 40 THEN concat('v', p_partkey) END END AS value) x
WHERE value IS NOT NULL"""

_PAGE_COUNTS = """
counted AS (
  SELECT coalesce(category, 'Unknown') AS category, CAST(id % 12 + 1 AS INT) AS page FROM books
),
page_counts AS (
  SELECT category, page, count(*) FILTER (page <> length(category) % 5 + 4) AS n_books
  FROM counted GROUP BY category, page
),
category_index AS (
  SELECT DISTINCT p_brand AS name, concat('https://shop.example/catalogue/category/',
         lower(replace(p_brand, '#', '_')), '/index.html') AS url
  FROM part
)"""

_BATCH = """
batch AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''
              ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS upc,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 5
                THEN repeat(concat(p_name, ' ', p_type), 60)
              WHEN l_returnflag = 'R' AND l_linenumber = 4 THEN NULL
              ELSE concat(p_name, ' ', p_type) END AS title,
         CASE WHEN l_extendedprice <= 100000 THEN l_extendedprice / 1000 END AS price,
         CASE WHEN l_linestatus = 'O'
                THEN concat('In stock (', CAST(CAST(l_quantity AS INT) AS VARCHAR), ' available)')
              WHEN l_returnflag = 'N' THEN NULL
              WHEN l_returnflag = 'A' THEN 'In stock'
              ELSE 'Out of stock' END AS availability,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0
              ELSE l_linenumber END AS rating,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 3
                THEN repeat(NULLIF(p_brand, 'Brand#1'), 20)
              ELSE NULLIF(p_brand, 'Brand#1') END AS category,
         concat('https://shop.example/catalogue/', CAST(p_partkey AS VARCHAR), '/index.html') AS url,
         l_extendedprice / 1000 AS price_excl_tax,
         l_extendedprice / 1000 * (1 + l_tax) AS price_incl_tax,
         l_extendedprice / 1000 * l_tax AS tax,
         0 AS number_of_reviews,
         l_shipdate AS scraped_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
checked AS (
  SELECT *, CASE WHEN title IS NULL THEN 'title is missing'
                 WHEN price IS NULL THEN 'price is missing'
                 WHEN length(title) > 500 THEN 'title is longer than 500'
                 WHEN length(availability) > 100 THEN 'availability is longer than 100'
                 WHEN length(category) > 100 THEN 'category is longer than 100'
                 WHEN length(upc) > 100 THEN 'upc is longer than 100' END AS reason
  FROM batch
),
target AS (
  SELECT DISTINCT upc FROM books
  WHERE scraped_at < TIMESTAMP '1999-01-01' AND upc IS NOT NULL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY upc ORDER BY price NULLS FIRST, tax NULLS FIRST,
              title NULLS FIRST, availability NULLS FIRST, rating NULLS FIRST,
              category NULLS FIRST, url NULLS FIRST, price_incl_tax NULLS FIRST,
              scraped_at NULLS FIRST) AS place
  FROM checked WHERE reason IS NULL
),
accepted AS (
  SELECT * FROM ranked
  WHERE upc IS NULL OR (place = 1 AND upc NOT IN (SELECT upc FROM target))
)"""


def _price_range_counts(prices: str, first: str) -> str:
    return _b(f"""
SELECT b.label AS price_range, count(p.price) AS n
FROM (VALUES ('£0-20'), ('£20-40'), ('£40-60'), ('£60-80'), ('£80+')) b(label)
LEFT JOIN (SELECT {prices} AS price FROM books) p ON {_bins('p.price', first)} = b.label
GROUP BY b.label""")


_JSON_FIELDS = [
    ("id", "CAST(id AS VARCHAR)"),
    ("title", "to_json(title)"),
    ("price", "to_json(price)"),
    ("availability", "to_json(availability)"),
    ("rating", "CAST(rating AS VARCHAR)"),
    ("category", "to_json(category)"),
    ("url", "to_json(url)"),
    ("description", "NULL"),
    ("upc", "to_json(upc)"),
    ("product_type", "NULL"),
    ("price_excl_tax", "to_json(price_excl_tax)"),
    ("price_incl_tax", "to_json(price_incl_tax)"),
    ("tax", "to_json(tax)"),
    ("number_of_reviews", "CAST(number_of_reviews AS VARCHAR)"),
    ("image_url", "NULL"),
    ("scraped_at", "concat('\"', strftime(scraped_at, '%Y-%m-%dT%H:%M:%S'), '\"')"),
    ("created_at", "concat('\"', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '\"')"),
    ("updated_at", "NULL"),
]


def _json() -> str:
    parts = [f"'\"{name}\":', coalesce(CAST({value} AS VARCHAR), 'null')" for name, value in _JSON_FIELDS]
    return _b("SELECT concat('{', " + ", ',', ".join(parts) + ", '}') AS json FROM books")


_SAMPLE = """
SELECT id, title, price, rating FROM (
  SELECT id, title, price, rating,
         row_number() OVER (PARTITION BY id, title, price, rating) AS copy FROM frame)
ORDER BY md5(concat_ws('|', '0', id, title, price, rating, copy)), id NULLS FIRST,
         title NULLS FIRST, price NULLS FIRST, rating NULLS FIRST LIMIT 500"""

ORACLES: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, html FROM pages",
    "scan_books": _b("SELECT * FROM books"),
    "books_json": _json(),
    "lenient_types": _b("""
SELECT id, CASE WHEN rating = 2 THEN 0.0::DOUBLE ELSE price END AS price,
       CASE WHEN rating = 3 THEN 0 ELSE coalesce(rating, 0) END AS rating,
       CASE WHEN rating = 4 THEN NULL ELSE scraped_at END AS scraped_at
FROM books"""),
    "extract_listing": _pods(_LISTING_URL, "Unknown", "1.0"),
    "extract_category_listing": _pods(_CATEGORY_URL, "Tea", "1234.56"),
    "extract_rejects": """
SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS INT) AS pos,
       'no title link' AS error
FROM pages""",
    "extract_detail": _DETAIL,
    "product_kv": _PRODUCT_KV,
    "extract_categories": _LINK_ROWS.format(name="trim(name)"),
    "parse_price": _b(f"""
SELECT id, {_price_number('t')} AS price,
       regexp_extract(t, '[0-9.]+') <> '' AND TRY_CAST(regexp_extract(t, '[0-9.]+') AS DOUBLE) IS NULL
         AS malformed
FROM (SELECT id, CASE WHEN rating IS NULL THEN 'free' WHEN rating = 0 THEN concat('1.2.', id)
                      ELSE concat('£', id, '.50 each') END AS t FROM books)"""),
    "parse_rating": _b("SELECT id, coalesce(rating, 0) AS rating FROM books"),
    "resolve_urls": _b("""
SELECT id,
       CASE WHEN rating = 1 THEN concat('http://x/', id)
            WHEN rating = 2 THEN concat('https://shop.example/catalogue/', id, '/i.html')
            WHEN rating = 3 THEN concat('https://shop.example/catalogue/', id, '/i.html')
            WHEN rating = 5 THEN ''
            ELSE concat('https://shop.example/catalogue/', id) END AS url,
       CASE WHEN rating = 1 THEN concat('http://x/', id)
            WHEN rating = 2 THEN concat('https://shop.example/catalogue/catalogue/', id, '/i.html')
            WHEN rating = 3 THEN concat('https://shop.example/catalogue/', id, '/i.html')
            WHEN rating = 4 THEN concat('catalogue/', id)
            WHEN rating = 5 THEN ''
            ELSE CAST(id AS VARCHAR) END AS category_url
FROM books"""),
    "normalize_keys": _LINES,
    "pivot_product": """
SELECT p_partkey AS page_id,
       CASE WHEN p_size > 40 THEN concat('v', p_partkey) ELSE concat('u', p_partkey) END AS upc,
       p_type AS product_type, p_retailprice AS price_excl_tax, p_retailprice AS price_incl_tax,
       0.0::DOUBLE AS tax, CASE WHEN p_size > 30 THEN p_size ELSE 0 END AS number_of_reviews
FROM part""",
    "category_links": _LINK_ROWS.format(name="trim(name)"),
    "page_plan": f"""WITH {_BOOKS}, {_PAGE_COUNTS},
last AS (SELECT category, max(page) AS pages FROM page_counts GROUP BY category)
SELECT name, CAST(place AS INT) AS page,
       CASE WHEN place = 1 THEN url
            ELSE replace(url, 'index.html', concat('page-', place, '.html')) END AS url
FROM (SELECT name, url, unnest(range(1, CAST(pages AS BIGINT) + 1)) AS place
      FROM category_index JOIN last ON name = category)""",
    "page_plan_first": f"""WITH {_BOOKS}, {_PAGE_COUNTS}
SELECT name, 1 AS page, url FROM category_index""",
    "contiguous_pages": f"""WITH {_BOOKS}, {_PAGE_COUNTS},
filled AS (SELECT * FROM page_counts WHERE n_books > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY page) AS place FROM filled)
SELECT category, page, n_books FROM placed WHERE page = place""",
    # A book without category or rating is on the start page, which no category owns.
    "tag_category": _b("""
SELECT id, title, price,
       CASE WHEN category IS NULL OR rating IS NULL THEN 'https://shop.example/'
            ELSE concat('https://shop.example/catalogue/category/', lower(replace(category, '#', '_')), '/',
                        CASE WHEN rating = 0 THEN 'index.html'
                             ELSE concat('page-', rating + 1, '.html') END) END AS page_url,
       CASE WHEN category IS NULL OR rating IS NULL THEN 'Unknown' ELSE category END AS category
FROM books"""),
    "enrich_listing": _f("""
, d AS (
  SELECT concat('https://shop.example/catalogue/', p_partkey, '/index.html') AS url,
         CASE WHEN p_size > 10 THEN p_type END AS category, p_size AS number_of_reviews
  FROM part WHERE p_size <> 7
)
SELECT f.id, f.title, f.price, f.availability, f.rating, f.url,
       coalesce(d.category, f.category) AS category,
       CASE WHEN d.url IS NOT NULL THEN 'copy 0' END AS description,
       d.number_of_reviews
FROM frame f LEFT JOIN d ON f.url = d.url"""),
    "union_listings": _f("""
SELECT title, price, availability, rating, url, 'Unknown' AS category FROM frame
UNION ALL
SELECT title, price, availability, rating, url, category FROM frame WHERE category <> 'Unknown'"""),
    "load_books": f"""WITH {_BOOKS}, {_BATCH}
SELECT upc, title, price, availability, rating, category, tax, scraped_at FROM accepted""",
    "load_rejects": f"""WITH {_BOOKS}, {_BATCH}
SELECT upc, title, price, category, reason FROM checked WHERE reason IS NOT NULL""",
    "load_summary": f"""WITH {_BOOKS}, {_BATCH},
n AS (SELECT (SELECT count(*) FROM accepted) AS inserted, count(*) AS records,
             count(reason) AS rejected FROM checked)
SELECT inserted, records - inserted - rejected AS skipped, rejected FROM n""",
    "enriched_books": _f(
        "SELECT id, category, stock_quantity, in_stock, price_range, price FROM frame"
    ),
    "books_by_price": _b(
        "SELECT id, title, price, category FROM books WHERE price BETWEEN 20 AND 40"
    ),
    "api_books": _b(f"""
SELECT id, title, price, availability, rating, category, url FROM books
{_LATEST}, id NULLS FIRST, title NULLS FIRST, price NULLS FIRST, availability NULLS FIRST,
rating NULLS FIRST, category NULLS FIRST, url NULLS FIRST LIMIT 100"""),
    "api_books_range": _b("""
SELECT id, title, price, availability, rating, category, url FROM books
WHERE price BETWEEN 20 AND 40"""),
    "api_books_strict": _b(f"""
SELECT id, title, price, availability, rating, category, url FROM books WHERE price >= 90
{_LATEST}, id NULLS FIRST, title NULLS FIRST, price NULLS FIRST, availability NULLS FIRST,
rating NULLS FIRST, category NULLS FIRST, url NULLS FIRST LIMIT 50"""),
    "explore": _f(f"SELECT title, price, rating, category, availability FROM frame WHERE {_EXPLORE}"),
    "explore_capped": _f("""
SELECT left(title, 8) AS title, id, stock_quantity FROM frame
ORDER BY created_at DESC NULLS FIRST, frame.title NULLS FIRST, id NULLS FIRST,
         stock_quantity NULLS FIRST LIMIT 1000"""),
    "explore_counts": _f(
        f"SELECT count(*) FILTER ({_EXPLORE}) AS shown, count(*) AS total FROM frame"
    ),
    "filter_options": _f("""
SELECT 'category' AS option, category AS value, NULL::DOUBLE AS max_price FROM frame GROUP BY category
UNION ALL
SELECT 'rating', CAST(rating AS VARCHAR), NULL FROM frame WHERE rating IS NOT NULL GROUP BY rating
UNION ALL
SELECT 'max_price', NULL, max(price) FROM frame"""),
    "usable_columns": _f("\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM frame" for c in _NUMERIC[:5]
    )),
    "top_category_books": _f(f"""
SELECT id, title, price, category FROM frame
WHERE category IN (SELECT category FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 10)"""),
    "statistics": _b("""
SELECT count(id) AS total_books, round(coalesce(avg(price), 0.0), 6) AS avg_price,
       coalesce(min(price), 0.0) AS min_price, coalesce(max(price), 0.0) AS max_price
FROM books"""),
    "overview_metrics": _f("""
SELECT count(*) AS total_books, round(avg(price), 6) AS avg_price, round(avg(rating), 6) AS avg_rating,
       count(*) FILTER (in_stock) AS in_stock, count(DISTINCT category) AS categories,
       round(count(*) FILTER (in_stock) / nullif(count(*), 0) * 100, 6) AS in_stock_pct
FROM frame"""),
    "overview_text": _f("""
SELECT format('{:,}', count(*)) AS total_books, format('£{:.2f}', avg(price)) AS avg_price,
       format('{:.1f}/5', avg(rating)) AS avg_rating,
       format('{:,} ({:.1f}%)', count(*) FILTER (in_stock),
              count(*) FILTER (in_stock) / count(*) * 100) AS in_stock,
       format('{}', count(DISTINCT category)) AS categories
FROM frame"""),
    "category_counts": _f(_CATEGORY_COUNTS),
    "category_counts_top": _f(f"SELECT * FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 15"),
    "category_share": _f(_share(
        f"SELECT * FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 10"
    )),
    "rating_counts": _f(_RATING_COUNTS),
    "rating_share": _f(_share(_RATING_COUNTS)),
    "stock_status": _f(_STOCK_STATUS),
    "stock_share": _f(_share(_STOCK_STATUS)),
    "price_range_counts": _price_range_counts("price", ">"),
    "price_range_counts_lowest": _price_range_counts(
        "CASE WHEN rating = 5 THEN 0.0 ELSE price END", ">="
    ),
    "price_by_top_category": _f(f"""
SELECT category, round(avg(price), 6) AS mean_price, min(price) AS min_price, max(price) AS max_price
FROM frame
WHERE category IN (SELECT category FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 10)
GROUP BY category"""),
    "category_stats": _f("""
SELECT category, round_even(avg(price) * 100, 0) / 100 AS avg_price,
       round_even(min(price) * 100, 0) / 100 AS min_price,
       round_even(max(price) * 100, 0) / 100 AS max_price,
       round_even(avg(rating) * 100, 0) / 100 AS avg_rating,
       count(*) FILTER (in_stock) AS in_stock, count(id) AS total_books
FROM frame GROUP BY category ORDER BY total_books DESC, category LIMIT 20"""),
    "category_stock": _f("""
SELECT category, count(*) FILTER (in_stock) AS in_stock, count(id) AS total,
       count(id) - count(*) FILTER (in_stock) AS out_of_stock
FROM frame GROUP BY category ORDER BY total DESC, category LIMIT 15"""),
    "avg_price_by_rating": _f("""
SELECT rating, round(avg(price), 6) AS avg_price FROM frame WHERE rating IS NOT NULL GROUP BY rating"""),
    "price_center": _f(
        "SELECT round(avg(price), 8) AS mean_price, round(median(price), 8) AS median_price FROM frame"
    ),
    "price_histogram": _histogram("price", 50),
    "price_histogram_30": _histogram("price", 30),
    "stock_histogram": _histogram("stock_quantity", 20),
    "price_box_by_rating": _f("""
, q AS (
  SELECT rating, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
         quantile_cont(price, 0.75) AS q3
  FROM frame WHERE rating IS NOT NULL GROUP BY rating
)
SELECT f.rating, round(any_value(q1), 8) AS q1, round(any_value(median), 8) AS median,
       round(any_value(q3), 8) AS q3, count(*) AS n,
       round(min(price), 8) AS lowest, round(max(price), 8) AS highest,
       round(min(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 8)
         AS lower_whisker,
       round(max(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 8)
         AS upper_whisker,
       count(*) FILTER (NOT price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM frame f JOIN q ON f.rating = q.rating GROUP BY f.rating"""),
    "price_quantiles": _f("""
SELECT category, round(quantile_cont(price, 0.1), 8) AS p10, round(quantile_cont(price, 0.5), 8) AS p50,
       round(quantile_cont(price, 0.9), 8) AS p90
FROM frame GROUP BY category"""),
    "correlation_matrix": _correlation(),
    "price_rating_ols": _f("""
SELECT round(regr_slope(price, rating), 6) AS slope, round(regr_intercept(price, rating), 6) AS intercept,
       round(CASE WHEN var_pop(rating) = 0 THEN NULL WHEN var_pop(price) = 0 THEN 1.0
                  ELSE regr_r2(price, rating) END, 6) AS r2,
       count(*) AS n
FROM frame WHERE price IS NOT NULL AND rating IS NOT NULL"""),
    "latest_books": _b(f"""
SELECT id, title, price, created_at FROM books
{_LATEST}, id NULLS FIRST, title NULLS FIRST, price NULLS FIRST LIMIT 100"""),
    "latest_ten": _b(f"""
SELECT title, price, rating, created_at FROM books
{_LATEST}, title NULLS FIRST, price NULLS FIRST, rating NULLS FIRST LIMIT 10"""),
    "top_expensive": _f(f"""
SELECT concat(left(title, 50), '...') AS title, price, category, rating
FROM (SELECT title, price, category, rating FROM frame {_TOP})"""),
    "top_rated": _f(f"""
SELECT concat(left(title, 50), '...') AS title, price, category, rating
FROM (SELECT title, price, category, rating FROM frame WHERE rating = 5 {_TOP})"""),
    "top_expensive_plain": _f(f"""
SELECT left(title, 50) AS title, price, category, rating
FROM (SELECT title, price, category, rating FROM frame {_TOP})"""),
    "best_value": _f("""
SELECT concat(left(title, 60), '...') AS title, price, rating, category,
       round(value_score, 6) AS value_score, concat(left(title, 30), '...') AS title_short
FROM (SELECT title, price, rating, category, rating / nullif(price + 1, 0) AS value_score FROM frame
      ORDER BY value_score DESC NULLS LAST, title NULLS FIRST, price NULLS FIRST,
               rating NULLS FIRST, category NULLS FIRST LIMIT 15)"""),
    "sample_books": _f(_SAMPLE),
    "daily_counts": _f("""
SELECT CAST(scraped_at AS DATE) AS scrape_date, count(*) AS n FROM frame
WHERE scraped_at IS NOT NULL GROUP BY 1"""),
    "cumulative_counts": _f("""
SELECT scrape_date, n, CAST(sum(n) OVER (ORDER BY scrape_date) AS BIGINT) AS cumulative
FROM (SELECT CAST(scraped_at AS DATE) AS scrape_date, count(*) AS n FROM frame
      WHERE scraped_at IS NOT NULL GROUP BY 1)"""),
}
ORACLES["stream_daily_counts"] = ORACLES["daily_counts"]
ORACLES["tag_category_shuffled"] = ORACLES["tag_category"]
ORACLES["enrich_listing_shuffled"] = ORACLES["enrich_listing"]
ORACLES["price_rating_ols_sample"] = _f(f"""
SELECT round(regr_slope(price, rating), 6) AS slope, round(regr_intercept(price, rating), 6) AS intercept,
       round(CASE WHEN var_pop(rating) = 0 THEN NULL WHEN var_pop(price) = 0 THEN 1.0
                  ELSE regr_r2(price, rating) END, 6) AS r2,
       count(*) AS n
FROM ({_SAMPLE}) WHERE price IS NOT NULL AND rating IS NOT NULL""")
ORACLES["catalogue_plan"] = """
SELECT CAST(i AS INT) AS page,
       CASE WHEN i = 1 THEN 'https://shop.example/'
            ELSE concat('https://shop.example/catalogue/page-', i, '.html') END AS url
FROM (SELECT unnest(range(1, (SELECT count(*) FROM pages) + 1)) AS i)"""
ORACLES["stream_ingest"] = f"""
SELECT title, price, availability, rating, url,
       CASE WHEN pos = 3 THEN 'Tea' ELSE category END AS category,
       CASE WHEN pos = 3 THEN concat('u', page_id) END AS upc
FROM ({_pods(_LISTING_URL, "Unknown", "1.0")})"""
ORACLES["load_round_trip"] = f"""
WITH {_BATCH.replace("SELECT DISTINCT upc FROM books", "SELECT upc FROM batch")
            .replace("WHERE scraped_at < TIMESTAMP '1999-01-01' AND upc IS NOT NULL", "WHERE false")}
SELECT row_number() OVER (ORDER BY price NULLS FIRST, tax NULLS FIRST, title NULLS FIRST,
         availability NULLS FIRST, rating NULLS FIRST, category NULLS FIRST, url NULLS FIRST,
         upc NULLS FIRST, price_incl_tax NULLS FIRST, scraped_at NULLS FIRST) AS id,
       upc, title, price, rating, category, tax, scraped_at
FROM accepted"""
ORACLES["crawl_by_category"] = f"""
WITH pods AS (
  SELECT *, CAST(p_size % 6 + 1 AS INT) AS page FROM part
  WHERE p_size % 6 + 1 <> length(p_brand) % 5 + 4
),
ends AS (
  SELECT p_brand, min(page) AS last
  FROM (SELECT p_brand, page FROM pods UNION SELECT p_brand, 0 FROM pods) x
  WHERE NOT EXISTS (SELECT 1 FROM pods y WHERE y.p_brand = x.p_brand AND y.page = x.page + 1)
  GROUP BY p_brand
),
detail AS ({_DETAIL})
SELECT p_name AS title, p_retailprice AS price, 'In stock' AS availability,
       3::INT AS rating, concat('https://shop.example/catalogue/', p_partkey, '/index.html') AS url,
       coalesce(detail.category, p_brand) AS category, detail.upc, detail.description
FROM pods JOIN ends USING (p_brand)
LEFT JOIN detail ON detail.page_id = p_partkey AND detail.error IS NULL
WHERE page <= last"""
ORACLES["load_books_bucketed"] = ORACLES["load_books"]
ORACLES["books_by_price_clustered"] = ORACLES["books_by_price"]
ORACLES["books_of_a_year_clustered"] = _b("""
SELECT id, title, category, created_at FROM books
WHERE category = 'Brand#13'
  AND created_at BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-12-31 23:59:59'""")
ORACLES["upc_lookup"] = _b("""
SELECT id, upc, title, price FROM books WHERE upc IN ('11', '21', '323', '6401', '59991', 'x')""")
ORACLES["extract_listing_sql"] = ORACLES["extract_listing"]
ORACLES["product_attributes"] = f"""
SELECT page_id, max(value) FILTER (key = 'upc') AS upc,
       max(value) FILTER (key = 'availability') AS availability,
       TRY_CAST(max(value) FILTER (key = 'number_of_reviews') AS INT) AS number_of_reviews
FROM ({_PRODUCT_KV}) GROUP BY page_id"""
ORACLES["attribute_counts"] = f"SELECT key, count(*) AS n FROM ({_PRODUCT_KV}) GROUP BY key"
ORACLES["kept_statistics"] = ORACLES["statistics"]
ORACLES["kept_category_stats"] = ORACLES["category_stats"]
ORACLES["kept_cumulative_counts"] = ORACLES["cumulative_counts"]
ORACLES["kept_sketches"] = _f("""
SELECT category, true AS median_is_near, true AS distinct_is_near FROM frame GROUP BY category""")
ORACLES["table_reset"] = _b("""
SELECT count(*) AS loaded, count(*) AS before_reset, 0::BIGINT AS after_reset
FROM books WHERE upc IS NULL""")
ORACLES["csv_round_trip"] = _b("SELECT id, title, price, rating FROM books")
ORACLES["load_unknown_fields"] = _b("""
SELECT upc, title, price, 'unknown field weight' AS reason FROM books WHERE rating = 5""")
