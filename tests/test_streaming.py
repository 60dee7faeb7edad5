from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagemart.operators.timeline import daily_counts
from pagemart.schema import PAGES
from pagemart.sources import derived
from pagemart.sources.books import BooksTable, page_stream
from pagemart.streaming.daily import late_rows, read_daily_counts, stream_daily_counts
from pagemart.streaming import matching
from pagemart.streaming.ingest import PageIngest, load_pages, records_of_pages
from tests.test_extract import BASE, DETAIL, LISTING


URL_A, URL_B = BASE + "catalogue/a_1/index.html", BASE + "catalogue/b_2/index.html"
LISTING_B = LISTING.replace("a_1", "b_2").replace("A long title", "B")
DETAIL_B = DETAIL.replace("u1", "u2")


class Arrivals:
    """Page files that arrive one by one, and the table they are loaded into."""

    def __init__(self, spark, folder, name):
        self.spark, self.folder = spark, str(folder / "pages")
        self.table = BooksTable(spark, name, str(folder / "books"))
        self.table.create()
        self.ingest = PageIngest(self.table, BASE, str(folder / "state"))

    def file(self, *rows):
        frame = self.spark.createDataFrame(rows, PAGES).coalesce(1)
        frame.write.mode("append").parquet(self.folder)

    def run(self, **options):
        stream = page_stream(self.spark, self.folder, **options)
        self.ingest.run(stream).awaitTermination()

    def rows(self):
        found = self.table.read().collect()
        return sorted((r["title"], r["category"], r["upc"] or "", r["url"]) for r in found)


BATCH = [("A long title", "Poetry", "u1", URL_A), ("B", "Poetry", "u2", URL_B)]


@pytest.mark.parametrize("order", ["before", "after", "with", "apart"])
def test_details_complete_listings_whenever_they_arrive(spark, tmp_path, order):
    pages = {
        "a": (1, BASE, LISTING),
        "b": (2, BASE, LISTING_B),
        "da": (3, URL_A, DETAIL),
        "db": (4, URL_B, DETAIL_B),
    }
    files = {
        "before": [("da", "db"), ("a", "b")],
        "after": [("a", "b"), ("da",), ("db",)],
        "with": [("a", "b", "da", "db")],
        "apart": [("a",), ("db",), ("b",), ("da",)],
    }[order]
    arrivals = Arrivals(spark, tmp_path, f"books_{order}")
    for names in files:
        arrivals.file(*[pages[n] for n in names])
    arrivals.run(max_files=1)
    arrivals.run(max_files=1)
    assert arrivals.rows() == BATCH
    assert arrivals.ingest.load_waiting().inserted == 0
    assert sum(r["inserted"] for r in arrivals.ingest.results().collect()) == 2
    # The second item of each listing has no heading.
    assert arrivals.ingest.rejects().count() == 2
    arrivals.table.drop(confirm=True)


def test_listings_wait_until_told_otherwise(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path, "books_waiting")
    arrivals.file((1, BASE, LISTING))
    arrivals.run()
    assert arrivals.rows() == []
    arrivals.file((2, URL_A, DETAIL), (3, BASE, LISTING_B))
    arrivals.run()
    assert arrivals.rows() == BATCH[:1]
    assert arrivals.ingest.load_waiting().inserted == 1
    assert arrivals.rows() == [BATCH[0], ("B", "Unknown", "", URL_B)]
    assert arrivals.ingest.load_waiting().inserted == 0
    # The same book again is skipped.
    arrivals.file((5, BASE, LISTING), (6, URL_A, DETAIL))
    arrivals.run()
    assert len(arrivals.rows()) == 2
    pages = spark.read.schema(PAGES).parquet(arrivals.folder)
    assert records_of_pages(pages, BASE).count() == 3
    arrivals.table.drop(confirm=True)


def test_load_leaves_no_intermediate_tables(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    table = BooksTable(spark, "books_clean", str(tmp_path / "books"))
    table.create()
    pages = spark.createDataFrame([(1, BASE, LISTING), (2, URL_A, DETAIL)], PAGES)
    before = {p.name for pattern in ("load-*", "crawl-*") for p in shared.glob(pattern)}
    result = load_pages(pages, table, BASE, str(tmp_path / "rejects"))
    assert (result.inserted, result.rejected) == (1, 1)
    rejects = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [tuple(r) for r in rejects] == [(1, 1, "no title link")]
    assert {p.name for pattern in ("load-*", "crawl-*") for p in shared.glob(pattern)} == before
    table.drop(confirm=True)


def test_all_rejects_are_kept_and_counted(spark, tmp_path):
    table = BooksTable(spark, "books_rejects", str(tmp_path / "books"))
    table.create()
    pages = spark.createDataFrame([(i, BASE, LISTING) for i in range(150)], PAGES)
    result = load_pages(pages, table, BASE, str(tmp_path / "rejects"))
    assert (result.inserted, result.rejected) == (150, 150)
    assert spark.read.parquet(str(tmp_path / "rejects")).select("page_id").distinct().count() == 150
    table.drop(confirm=True)


@pytest.mark.parametrize("broken", ["rows", "append", "done"])
def test_a_load_that_failed_is_taken_up_and_adds_nothing_twice(spark, tmp_path, monkeypatch, broken):
    """Records without a UPC as well: the detail has none."""
    arrivals = Arrivals(spark, tmp_path, f"books_again_{broken}")
    bare = DETAIL.replace("<th>UPC</th>", "<th>Other</th>")
    assert bare != DETAIL
    arrivals.file((1, BASE, LISTING), (2, URL_A, bare), (3, BASE, LISTING_B), (4, URL_B, DETAIL_B))
    kept = BooksTable.append

    def failing(table, rows):
        if broken == "append":
            raise RuntimeError("lost")
        if broken == "done":
            kept(table, rows)
            raise RuntimeError("lost")

    monkeypatch.setattr(BooksTable, "append", failing)
    if broken == "rows":
        monkeypatch.setattr("pagemart.streaming.ingest.stamped", lambda rows: 1 / 0)
    with pytest.raises(Exception):
        arrivals.run()
    monkeypatch.undo()
    arrivals.run()
    assert [r[0] for r in arrivals.rows()] == ["A long title", "B"]
    assert sorted(r["id"] for r in arrivals.table.read().collect()) == [1, 2]
    assert [tuple(r) for r in arrivals.ingest.results().collect()] == [(2, 0, 0)]
    arrivals.table.drop(confirm=True)


def test_known_upcs_of_the_table_are_skipped(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path, "books_known")
    arrivals.table.insert({"title": "Here before", "price": 1.0, "upc": "u1"})
    arrivals.file((1, BASE, LISTING), (2, URL_A, DETAIL), (3, BASE, LISTING_B), (4, URL_B, DETAIL_B))
    arrivals.run()
    assert [(r[0], r[2]) for r in arrivals.rows()] == [("B", "u2"), ("Here before", "u1")]
    assert [tuple(r) for r in arrivals.ingest.results().collect()] == [(1, 1, 0)]
    arrivals.table.drop(confirm=True)


def test_rows_leave_without_detail_when_patience_ends(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path, "books_patience")
    arrivals.ingest.patience = 1
    arrivals.file((1, BASE, LISTING))
    arrivals.run()
    arrivals.file((2, URL_B, DETAIL_B))
    arrivals.run()
    assert arrivals.rows() == [("A long title", "Unknown", "", URL_A)]
    arrivals.table.drop(confirm=True)


def test_batches_cost_the_same_however_many_there_were(spark, tmp_path, monkeypatch):
    """Files of the table and of the state that a batch reads do not grow with the batches."""
    arrivals = Arrivals(spark, tmp_path, "books_cost")
    for i in range(12):
        url = f"{BASE}catalogue/x_{i}/index.html"
        listing = LISTING.replace("a_1", f"x_{i}").replace("A long title", f"X{i}")
        arrivals.file((2 * i, BASE, listing), (2 * i + 1, url, DETAIL.replace("u1", f"x{i}")))
    reads = []
    read, scan = PageIngest._batch, BooksTable.read

    def batch(ingest, rows, number):
        before = len(reads)
        read(ingest, rows, number)
        scans[number] = len(reads) - before

    scans = {}
    monkeypatch.setattr(PageIngest, "_batch", batch)
    monkeypatch.setattr(BooksTable, "read", lambda table: reads.append(1) or scan(table))
    arrivals.run(max_files=1)
    assert len(arrivals.rows()) == 12
    # Only the first batch looks at the table, for its last id.
    assert scans[0] == 1 and not any(scans[n] for n in scans if n)
    ledger = Path(arrivals.ingest.state) / "ledger"
    assert len(list(ledger.glob("*"))) <= 6
    arrivals.table.drop(confirm=True)


def test_days_in_any_order_are_all_counted(spark, tmp_path):
    folder = str(tmp_path / "books")
    days = ["2024-05-09", "2021-01-01", "2024-05-09", "2019-12-31", "2024-05-10", "2021-01-01"]
    for day in days:
        frame = spark.range(7).select(F.lit(day).cast("timestamp_ntz").alias("scraped_at"))
        frame.coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema("scraped_at timestamp_ntz").option("maxFilesPerTrigger", 1)
    out = str(tmp_path / "out")
    stream_daily_counts(reader.parquet(folder), out, str(tmp_path / "state")).awaitTermination()
    found = read_daily_counts(spark, out).collect()
    assert found == daily_counts(spark.read.parquet(folder)).collect()
    assert sum(r["n"] for r in found) == 42
    # One version for the next batch and one for its repetition.
    assert len(list(Path(out).glob("version=*"))) == 2


def test_late_rows_are_counted_when_a_delay_is_given(spark, tmp_path):
    folder, out = str(tmp_path / "books"), str(tmp_path / "out")
    for day in ("2024-05-09", "2024-05-10", "2019-12-31"):
        frame = spark.range(7).select(F.lit(day).cast("timestamp_ntz").alias("scraped_at"))
        frame.coalesce(1).write.mode("append").parquet(folder)
        reader = spark.readStream.schema("scraped_at timestamp_ntz").parquet(folder)
        query = stream_daily_counts(reader, out, str(tmp_path / "state"), delay="30 days")
        query.awaitTermination()
    assert late_rows(query) > 0
    assert [r["n"] for r in read_daily_counts(spark, out).collect()] == [7, 7]


def test_late_rows_of_more_batches_than_progress_keeps(spark, tmp_path):
    """Twelve batches each leave out a day; Spark is told to keep the progress of five."""
    folder, out = str(tmp_path / "books"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        for day in ("2024-05-09", "2024-05-10", *(f"2019-{m:02}-01" for m in range(1, 13))):
            frame = spark.range(3).select(F.lit(day).cast("timestamp_ntz").alias("scraped_at"))
            frame.coalesce(1).write.mode("append").parquet(folder)
        reader = spark.readStream.schema("scraped_at timestamp_ntz").option("maxFilesPerTrigger", 1)
        query = stream_daily_counts(reader.parquet(folder), out, str(tmp_path / "state"), delay="1 day")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    # Every late batch leaves out as much as the last one.
    (each,) = (o["numRowsDroppedByWatermark"] for o in query.recentProgress[-1]["stateOperators"])
    assert each and len(query.recentProgress) < 12 and late_rows(query) == 12 * each


def test_streamed_days_equal_batch_days(spark, tmp_path):
    folder = str(tmp_path / "books")
    hours = F.make_dt_interval(hours=F.col("id").cast("int"))
    scraped = (F.lit("2024-05-01").cast("timestamp") + hours).cast("timestamp_ntz")
    books = spark.range(300).select(F.when(F.col("id") % 10 > 0, scraped).alias("scraped_at"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in (books.where("hour(scraped_at) < 12 OR scraped_at IS NULL"), books.where("hour(scraped_at) >= 12")):
        part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(books.schema).parquet(folder)
        stream_daily_counts(stream, out, state).awaitTermination()
    batch = daily_counts(spark.read.parquet(folder)).collect()
    assert read_daily_counts(spark, out).collect() == batch and len(batch) == 13


def test_streamed_days_do_not_depend_on_the_time_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        folder = str(tmp_path / "books")
        texts = ["2024-05-01 00:10:00", "2024-05-01 23:50:00", "2024-05-02 00:00:00"]
        frame = spark.createDataFrame([(t,) for t in texts], "t string")
        frame = frame.select(F.col("t").cast("timestamp_ntz").alias("scraped_at"))
        frame.write.parquet(folder)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        out = str(tmp_path / "out")
        stream_daily_counts(stream, out, str(tmp_path / "state")).awaitTermination()
        got = read_daily_counts(spark, out).collect()
        assert got == daily_counts(frame).collect() and [r["n"] for r in got] == [2, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tasks_of_the_daily_state_stay_apart(spark, tmp_path, monkeypatch):
    """A coalesced batch runs all partitions of the state in one task, with the memory of all."""
    folder = str(tmp_path / "books")
    spark.range(40).select(
        F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz").alias("scraped_at")
    ).write.parquet(folder)

    def coalesce(frame, number):
        raise AssertionError("coalesced")

    stream = spark.readStream.schema("scraped_at timestamp_ntz").parquet(folder)
    out = str(tmp_path / "out")
    monkeypatch.setattr(type(stream), "coalesce", coalesce)
    stream_daily_counts(stream, out, str(tmp_path / "state")).awaitTermination()
    monkeypatch.undo()
    assert [r["n"] for r in read_daily_counts(spark, out).collect()] == [1] * 40
    assert len(list(Path(out).glob("version=*/*.parquet"))) == 1


def test_files_of_a_stream_grow_with_the_scan(spark, tmp_path):
    """A scan of many tasks is not shuffled into four files; a small one is dealt evenly."""
    for parts, files, taken in ((9, 9, 3), (1, 4, 1)):
        folder = str(tmp_path / f"files{parts}")
        # Equal rows, too, are spread.
        rows = spark.range(2000).select((F.col("id") * 0).alias("id")).repartition(parts)
        derived.in_files(rows, folder)
        counts = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
        assert len(counts) == files and sum(counts) == 2000 and max(counts) < 800
        assert derived.files_per_batch(spark, folder) == taken


class Held:
    """A state of one key, and the uses of it."""

    def __init__(self):
        self.value, self.rows, self.uses = None, [], 0

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return Held()

    def get(self):
        self.uses += 1
        return self.value

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.uses, self.value = self.uses + 1, value

    def appendList(self, rows):
        self.rows += rows


def test_rows_pass_the_state_as_rows_and_use_it_only_where_they_need_it(monkeypatch):
    monkeypatch.setattr(matching, "_batch_id", lambda: 3)
    made = Row("key", "kind", "page_id", "pos", "payload")
    match, state = matching.MatchDetails(-1, None), Held()
    match.init(state)
    rejects = [made("#", "reject", i, None, "bad") for i in range(5)]
    found = list(match.handleInputRows(("#",), iter(rejects), None))
    assert [tuple(r) for r in found] == [("reject", i, None, None, "bad", 3) for i in range(5)]
    assert state.uses == 0
    # A listing that waits gives no row at all.
    assert list(match.handleInputRows(("u",), iter([made("u", "listing", None, 1, "{}")]), None)) == []
    assert match.waiting.rows == [(None, 1, "{}", 3)] and state.uses == 1
    state.value = (7, "{d}")
    found = list(match.handleInputRows(("u",), iter([made("u", "listing", 1, 1, "{}")]), None))
    assert [tuple(r) for r in found] == [("record", 1, 1, "{}", "{d}", 3)]

    made = Row("key", "page_id", "pos", "payload", "status")
    first, state = matching.FirstOfKey(), Held()
    first.init(state)
    rows = [made("p", 1, 1, "{}", "open"), made("p", None, 1, "{}", "invalid")]
    assert [r["status"] for r in first.handleInputRows(("p",), iter(rows), None)] == ["open", "invalid"]
    assert state.uses == 0
    rows = [made("u", 1, 1, "{}", "keyed"), made("u", None, 1, "{}", "keyed")]
    found = [tuple(r) for r in first.handleInputRows(("u",), iter(rows), None)]
    assert found == [(None, 1, "{}", "new"), (1, 1, "{}", "skipped")]
