"""The books table: create, drop, read, load."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemart.operators.load import plan_load, record_counts
from pagemart.plans.serial_ids import with_serial_ids
from pagemart.schema import BOOKS, PAGES, RECORD
from pagemart.sources.files import Scratch


@dataclass(frozen=True)
class LoadResult:
    inserted: int
    skipped: int
    rejected: int
    first_rejected: list[str] = field(default_factory=list)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue pages (page_id, url, html)."""
    return spark.read.schema(PAGES).parquet(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The whole table from its folder, typed."""
    return spark.read.schema(BOOKS).parquet(path)


def utc_now() -> Column:
    """The time now on a UTC clock, in any session zone."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def stamped(numbered: DataFrame) -> DataFrame:
    """Numbered records as rows of the table, with the columns it fills in."""
    now = utc_now()
    rows = numbered.withColumns(
        {
            "number_of_reviews": F.coalesce("number_of_reviews", F.lit(0)),
            "scraped_at": F.coalesce("scraped_at", now),
            "created_at": now,
            "updated_at": now,
        }
    )
    return rows.select(BOOKS.fieldNames())


def page_stream(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """Page files of a folder as a stream, at most `max_files` to a batch if that is given."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


class BooksTable:
    """A books table in the catalog, stored as Parquet, at `location` if one is given.

    With `buckets` its rows are stored in so many buckets by UPC, each file sorted by UPC. A
    load that joins on the UPC then shuffles its batch into the buckets and reads the table
    where it is.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str = "books",
        location: str | None = None,
        buckets: int | None = None,
    ):
        self.spark = spark
        self.name = name
        self.location = location
        self.buckets = buckets

    def create(self) -> None:
        """Create the table unless it is there."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BOOKS)
        place = f" LOCATION '{self.location}'" if self.location else ""
        layout = f" CLUSTERED BY (upc) SORTED BY (upc) INTO {self.buckets} BUCKETS" if self.buckets else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet{layout}{place}")

    def drop(self, confirm: bool = False) -> None:
        """Drop the table and its rows; refuses without confirm=True."""
        if not confirm:
            raise ValueError("dropping the table needs confirm=True")
        if self.location and self.spark.catalog.tableExists(self.name):
            # Dropping a table at a given location would keep its files: empty it first.
            nothing = self.spark.createDataFrame([], BOOKS)
            nothing.write.insertInto(self.name, overwrite=True)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def reset(self, confirm: bool = False) -> None:
        """An empty table of the current schema."""
        self.drop(confirm)
        self.create()

    def read(self) -> DataFrame:
        """The table as it is now, with what other sessions have added."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def last_id(self) -> int:
        return self.read().agg(F.max("id").alias("m")).first()["m"] or 0

    def append(self, rows: DataFrame) -> None:
        """Add rows that have every column, ids included."""
        rows = rows.select(BOOKS.fieldNames())
        if self.buckets:
            # One file per bucket. Rows without a UPC are all of one bucket: their tasks write
            # them as they have them, so no task gets them all.
            keyed = rows.where(F.col("upc").isNotNull())
            keyed.repartition(self.buckets, "upc").write.insertInto(self.name)
            rows = rows.where(F.col("upc").isNull())
        rows.write.insertInto(self.name)

    def load(self, batch: DataFrame, order: list[str] | None = None) -> LoadResult:
        """Append what the load rules accept; ids follow `order` if it is given.

        The batch is computed once and written to the shared folder, which is cleared again at
        the end. Running the same load again is safe for records with a UPC; records without
        one are added each time. There must be one writer at a time: ids and UPCs are only
        checked against what the table holds when the load begins.
        """
        with Scratch(self.spark, "load") as scratch:
            # The job that writes the batch counts it as well.
            counts = Observation()
            batch = scratch.table(batch.observe(counts, *record_counts(batch, order or [])))
            return self._load(batch, counts, order, scratch)

    def _load(
        self, batch: DataFrame, observed: Observation, order: list[str] | None, scratch: Scratch
    ) -> LoadResult:
        target = self.read()
        plan = plan_load(batch, target, order, cut_target=True)
        ties = RECORD.fieldNames() if plan.places else []
        by = [F.col(c).asc_nulls_first() for c in plan.places + ties]
        numbered, inserted = with_serial_ids(plan.accepted, self.last_id(), by, scratch)
        self.append(stamped(numbered))
        counts, titles = observed.get, []
        if counts["rejected"]:
            titles = [r["title"] for r in plan.rejected.select("title").limit(5).collect()]
        skipped = counts["records"] - counts["rejected"] - inserted
        return LoadResult(inserted, skipped, counts["rejected"], titles)

    def insert(self, record: dict) -> int | None:
        """Insert one record and return its id, or None if it is invalid or its UPC is taken."""
        unknown = [k for k in record if k not in RECORD.fieldNames()]
        if unknown:
            raise TypeError(f"unknown fields: {', '.join(unknown)}")
        row = [tuple(record.get(name) for name in RECORD.fieldNames())]
        before = self.last_id()
        done = self.load(self.spark.createDataFrame(row, RECORD))
        return before + 1 if done.inserted else None
