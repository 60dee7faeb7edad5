"""Catalogue pages to records, in one go or as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemart.operators import extract
from pagemart.operators.combine import enrich_listing
from pagemart.operators.crawl import catalogue_plan, contiguous_pages, start_address
from pagemart.operators.load import is_valid
from pagemart.plans.lookup import first_per_key, lookup_join
from pagemart.plans.serial_ids import with_serial_ids
from pagemart.schema import BOOKS, DETAIL, LISTING, RECORD
from pagemart.sources.books import BooksTable, LoadResult, stamped
from pagemart.sources.files import Scratch, delete_folder, file_numbers, numbered_folders
from pagemart.streaming import matching

_SPECS = {
    "listing": extract.LISTING_SPEC,
    "detail": extract.DETAIL_SPEC,
    "category": extract.CATEGORY_SPEC,
}
_DETAIL = T.StructType([f for f in DETAIL if f.name != "url"])


@dataclass(frozen=True)
class Crawl:
    """What the pages give: records with their place, and what could not be read."""

    records: DataFrame
    rejects: DataFrame


def _parsed(pages: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """Raw records by kind; every page is parsed once."""
    parsed = scratch.table(extract.parse_pages(pages, _SPECS))
    return {kind: parsed.where(F.col("kind") == kind).drop("kind") for kind in _SPECS}


def _details(raw: DataFrame, pages: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Good details, and rejects of detail pages."""
    found = extract.extract_detail(pages, base_url, raw=raw)
    bad = found.where("error IS NOT NULL")
    return (
        found.where("error IS NULL").drop("error"),
        bad.select("page_id", F.lit(0).alias("pos"), "error"),
    )


def _page_number(url: Column) -> Column:
    number = F.regexp_extract(url, r"page-([0-9]+)\.html", 1)
    return F.coalesce(number.try_cast("int"), F.lit(1))


def _in_categories(
    found: DataFrame, categories: DataFrame, first_page_only: bool, scratch: Scratch
) -> DataFrame:
    """Listing rows of category pages, up to the first empty page of their category."""
    names = categories.select(F.col("url").alias("_start"), F.col("name").alias("_name"))
    names = first_per_key(names, "_start")
    placed = found.withColumns(
        {"_start": start_address(F.col("page_url")), "page": _page_number(F.col("page_url"))}
    )
    placed = scratch.table(lookup_join(placed, names, "_start", "inner"))
    good = placed.where(F.col("error").isNull())
    sizes = good.groupBy(F.col("_start").alias("category"), "page").agg(F.count("*").alias("n_books"))
    kept = contiguous_pages(scratch.table(sizes)).select(F.col("category").alias("_start"), "page")
    if first_page_only:
        kept = kept.where("page = 1")
    rows = placed.join(kept, ["_start", "page"], "left_semi")
    return rows.withColumn("category", F.col("_name")).select(found.columns)


def crawl_records(
    pages: DataFrame,
    base_url: str,
    scratch: Scratch,
    by_category: bool = False,
    include_details: bool = True,
    max_pages: int | None = None,
) -> Crawl:
    """Records of the listing pages, completed from the detail pages among the same pages.

    By category, only pages of the categories in the sidebars count, each category up to its
    first empty page, and rows carry the category of their page until a detail names another.
    `max_pages` limits a crawl of the catalogue to its first pages, and one by category to the
    first page of each. The frames are good as long as `scratch` is.
    """
    raw = _parsed(pages, scratch)
    category = F.lit(extract.UNKNOWN) if by_category else None
    found = extract.extract_listing(pages, base_url, category, raw=raw["listing"])
    if by_category:
        categories = extract.extract_categories(pages, base_url, raw=raw["category"])
        names = categories.select("name", "url").distinct()
        found = _in_categories(found, names, max_pages is not None, scratch)
    elif max_pages is not None:
        plan = catalogue_plan(pages.sparkSession, base_url, max_pages)
        planned = plan.select(F.col("url").alias("page_url"))
        found = found.join(F.broadcast(planned), "page_url", "left_semi").select(found.columns)
    listing, rejects = extract.good_rows(found), extract.rejects(found)
    if include_details:
        detail, bad = _details(raw["detail"], pages, base_url)
        rejects = rejects.unionByName(bad)
        listing = enrich_listing(listing, detail, [F.col("page_id")])
    return Crawl(listing, rejects)


def records_of_pages(pages: DataFrame, base_url: str, scratch: Scratch | None = None) -> DataFrame:
    """Records of a crawl of the catalogue; without `scratch` its tables stay in the shared
    folder until the cluster clears it."""
    return crawl_records(pages, base_url, scratch or Scratch(pages.sparkSession, "crawl")).records


def load_pages(
    pages: DataFrame, table: BooksTable, base_url: str, rejects: str, **options
) -> LoadResult:
    """Crawl and load in one go, and write what could not be read to the folder `rejects`.

    The result counts records that broke a load rule and items that could not be read alike
    as rejected; the folder has (page_id, pos, error) of all of the latter.
    """
    with Scratch(pages.sparkSession, "crawl") as scratch:
        crawl = crawl_records(pages, base_url, scratch, **options)
        unread = Observation()
        counted = crawl.rejects.observe(unread, F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(rejects)
        result = table.load(crawl.records, order=["page_id", "pos"])
    return replace(result, rejected=result.rejected + unread.get["n"])


@dataclass(frozen=True)
class _Entry:
    """One load of the ledger: its key, its ids and its counts."""

    number: int
    key: str
    first_id: int
    last_id: int
    inserted: int
    skipped: int
    rejected: int


class PageIngest:
    """The load of arriving pages, whatever files a listing and its detail come in.

    Details, waiting listing rows and loaded UPCs are in Spark's state store, below `state` in
    the shared storage; a batch touches the keys it brings, so batches cost the same however
    much was loaded before. When a crawl is complete, `load_waiting` loads what still waits,
    without detail, so that runs and that together load what one batch over all pages would.
    `patience` (seconds) loads a waiting row without detail after so long, at the next batch.

    Every load is entered in a ledger: its numbered rows first, then the table, then a mark. A
    load that is run again after a failure takes its rows from there, and looks by their ids
    whether the table has them, so no record is added twice, with or without UPC. While the
    state lives, the table has no other writer.

    Details of one url: the smallest page_id among those that are there when the listing loads.
    """

    def __init__(self, table: BooksTable, base_url: str, state: str, patience: float | None = None):
        self.table, self.base_url, self.state = table, base_url, state.rstrip("/")
        self.patience = None if patience is None else int(patience * 1000)
        self.spark: SparkSession = table.spark

    def run(self, pages: DataFrame) -> StreamingQuery:
        """Load all pages that are there, then stop; the next run takes up what is new."""
        with _state_in_rocksdb(self.spark):
            return (
                self._statuses(pages)
                .writeStream.foreachBatch(self._batch)
                .outputMode("append")
                .option("checkpointLocation", f"{self.state}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )

    def load_waiting(self) -> LoadResult:
        """Load the listings that still wait for a detail, and wait for nothing more."""
        version, released = self._last_batch(), self._released()
        if version is None or version == released:
            return LoadResult(0, 0, 0)
        with Scratch(self.spark, "ingest") as scratch:
            with _state_in_rocksdb(self.spark):
                waiting = (
                    self.spark.read.format("statestore")
                    .options(batchId=version, operatorId=_MATCH, stateVarName="waiting")
                    .load(f"{self.state}/checkpoint")
                    .select("list_element.*")
                )
                listed = waiting.where(F.col("since") > released)
                listed = listed.select(
                    F.lit("record").alias("kind"),
                    "page_id",
                    "pos",
                    F.col("payload").alias("listing"),
                    F.lit(None).cast("string").alias("detail"),
                )
                rows = scratch.table(_checked(listed).drop("key"))
            result = self._append(f"waiting-{version}", rows, scratch)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.state}/released/batch={version}")
        return result

    def rejects(self) -> DataFrame:
        """(page_id, pos, error) of everything that could not be read so far."""
        return self._read("rejects", "page_id bigint, pos int, error string")

    def results(self) -> DataFrame:
        """(inserted, skipped, rejected) of every load that had records."""
        return self._read("results", "inserted bigint, skipped bigint, rejected bigint")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not numbered_folders(self.spark, f"{self.state}/{name}", "batch="):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.state}/{name}").drop("batch")

    def _last_batch(self) -> int | None:
        return max(file_numbers(self.spark, f"{self.state}/checkpoint/commits"), default=None)

    def _released(self) -> int:
        """The last batch whose waiting rows were loaded without detail."""
        return max(numbered_folders(self.spark, f"{self.state}/released", "batch="), default=-1)

    def _statuses(self, pages: DataFrame) -> DataFrame:
        """(page_id, pos, payload, status) of the records that leave the state, and of rejects."""
        specs = {kind: _SPECS[kind] for kind in ("listing", "detail")}
        raw = extract.with_detail_texts(extract.parse_pages(pages, specs))
        listing = extract.listing_columns(self.base_url)
        detail = extract.detail_columns(self.base_url)
        is_listing = F.col("kind") == "listing"
        error = F.when(is_listing, listing["error"]).otherwise(detail["error"])
        position = F.when(is_listing, F.col("pos")).otherwise(0)
        payload = F.when(
            is_listing, F.to_json(F.struct(*[listing[f.name].alias(f.name) for f in LISTING]))
        ).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in detail.items() if n != "error"])))
        rows = raw.where(is_listing | extract.holds_detail()).select(
            F.when(error.isNotNull(), "reject").otherwise(F.col("kind")).alias("kind"),
            F.when(is_listing, listing["url"]).otherwise(F.col("url")).alias("url"),
            "page_id",
            position.alias("pos"),
            F.coalesce(error, payload).alias("payload"),
        )
        # A detail without an address completes nothing; rejects only pass through.
        rows = rows.where((F.col("kind") != "detail") | F.col("url").isNotNull())
        key = F.when(F.col("kind") == "reject", _bundle("#")).otherwise(F.col("url"))
        rows = rows.withColumn("key", key)
        matched = rows.drop("url").groupBy("key").transformWithState(
            matching.MatchDetails(self._released(), self.patience),
            T.StructType.fromDDL(matching.MATCH_OUT),
            "Append",
            "None" if self.patience is None else "ProcessingTime",
        )
        known = None
        if self._last_batch() is None:
            upcs = self.table.read().where(F.col("upc").isNotNull())
            known = upcs.select(F.concat(F.lit("u"), "upc").alias("key")).distinct().groupBy("key")
        return (
            _checked(matched.drop("since"))
            .groupBy("key")
            .transformWithState(
                matching.FirstOfKey(),
                T.StructType.fromDDL(matching.FIRST_OUT),
                "Append",
                "None" if self.patience is None else "ProcessingTime",
                known,
            )
        )

    def _batch(self, statuses: DataFrame, batch_id: int) -> None:
        with Scratch(self.spark, "ingest") as scratch:
            rows = scratch.table(statuses)
            unread = rows.where("status = 'reject'").select("page_id", "pos", F.col("payload").alias("error"))
            self._save(unread, "rejects", batch_id)
            self._append(f"batch-{batch_id}", rows.where("status <> 'reject'"), scratch)

    def _save(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.state}/{name}/batch={number}")

    def _append(self, key: str, rows: DataFrame, scratch: Scratch) -> LoadResult:
        """Enter a load in the ledger, add its rows to the table, and mark it as done."""
        entry = self._entry()
        again = entry is not None and entry.key == key
        if not again:
            entry = self._entered(key, rows, entry, scratch)
            if entry is None:
                return LoadResult(0, 0, 0)
        ledger, number = f"{self.state}/ledger", entry.number
        done = number in numbered_folders(self.spark, ledger, "done=")
        if not done and entry.inserted:
            there = again and not self.table.read().where(F.col("id") >= entry.first_id).isEmpty()
            if not there:
                self.table.append(self.spark.read.schema(BOOKS).parquet(f"{ledger}/rows={number}"))
        counts = (entry.inserted, entry.skipped, entry.rejected)
        if not done:
            result = self.spark.createDataFrame([counts], "inserted bigint, skipped bigint, rejected bigint")
            self._save(result, "results", number)
            self.spark.range(1).write.mode("overwrite").parquet(f"{ledger}/done={number}")
        for name in ("rows", "entry", "done"):
            delete_folder(self.spark, f"{ledger}/{name}={number - 1}")
        return LoadResult(*counts)

    def _entry(self) -> _Entry | None:
        """The newest load of the ledger."""
        numbers = numbered_folders(self.spark, f"{self.state}/ledger", "entry=")
        if not numbers:
            return None
        row = self.spark.read.schema(_ENTRY).parquet(f"{self.state}/ledger/entry={numbers[-1]}").first()
        return _Entry(numbers[-1], *row)

    def _entered(self, key: str, rows: DataFrame, before: _Entry | None, scratch: Scratch) -> _Entry | None:
        """The ledger's entry of a new load, None if there are no records."""
        counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        if not counts:
            return None
        start = before.last_id if before else self.table.last_id()
        number = before.number + 1 if before else 0
        accepted = rows.where("status IN ('new', 'open')")
        record = F.from_json("payload", RECORD).alias("record")
        records = accepted.select("page_id", "pos", record).select("page_id", "pos", "record.*")
        order = [F.col(c).asc_nulls_first() for c in ("page_id", "pos", *RECORD.fieldNames())]
        numbered, inserted = with_serial_ids(records, start, order, scratch)
        path = f"{self.state}/ledger/rows={number}"
        stamped(numbered).write.mode("overwrite").parquet(path)
        values = (key, start + 1, start + inserted, inserted, counts.get("skipped", 0), counts.get("invalid", 0))
        entry = self.spark.createDataFrame([values], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/ledger/entry={number}")
        return _Entry(number, *values)


_ENTRY = "key string, first_id bigint, last_id bigint, inserted bigint, skipped bigint, rejected bigint"
#: Number of the stateful operator that matches details; they are counted from the output.
_MATCH = 1
#: Keys that the rows of a batch without state share.
_BUNDLES = 256


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB and checkpoint its changes."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Timers would ask for one empty batch after the other, and a run would not end.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _bundle(mark: str) -> Column:
    """A key for rows that use no state: each key costs time, so they share some."""
    return F.concat(F.lit(mark), F.pmod(F.xxhash64("page_id", "pos"), F.lit(_BUNDLES)).cast("string"))


def _checked(matched: DataFrame) -> DataFrame:
    """(key, page_id, pos, payload, status) of matched rows: whole records as JSON, and whether
    they are valid, have a UPC (`keyed`) or none (`open`)."""
    listing, detail = F.from_json("listing", LISTING), F.from_json("detail", _DETAIL)
    parts = matched.select("kind", "page_id", "pos", "detail", listing.alias("l"), detail.alias("d"))

    def value(name: str) -> Column:
        sides = [F.col(f"d.{name}")] if name in _DETAIL.fieldNames() else []
        sides += [F.col(f"l.{name}")] if name in LISTING.fieldNames() else []
        return F.coalesce(*sides) if sides else F.lit(None)

    records = parts.select(
        "kind",
        "page_id",
        "pos",
        F.col("detail").alias("error"),
        *[value(f.name).cast(f.dataType).alias(f.name) for f in RECORD],
    )
    status = (
        F.when(F.col("kind") == "reject", "reject")
        .when(~is_valid([]), "invalid")
        .when(F.col("upc").isNull(), "open")
        .otherwise("keyed")
    )
    payload = F.when(F.col("kind") == "reject", F.col("error")).otherwise(
        F.to_json(F.struct(*RECORD.fieldNames()))
    )
    rows = records.select("page_id", "pos", payload.alias("payload"), status.alias("status"), "upc")
    key = F.when(F.col("status") == "keyed", F.concat(F.lit("u"), "upc")).otherwise(_bundle("p"))
    return rows.select(key.alias("key"), "page_id", "pos", "payload", "status")


def stream_ingest(
    pages: DataFrame, table: BooksTable, base_url: str, checkpoint: str
) -> StreamingQuery:
    """One run of `PageIngest` with its state in `checkpoint`."""
    return PageIngest(table, base_url, checkpoint).run(pages)
