"""Daily counts of a stream of books."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pagemart.sources.files import delete_folder, numbered_folders

_VERSION = "version="
_SCHEMA = "scrape_date date, n bigint"


def stream_daily_counts(
    books: DataFrame, out: str, checkpoint: str, delay: str | None = None
) -> StreamingQuery:
    """Count books per scrape date into `out`, whatever order they arrive in.

    The state is one row per day, so no day is ever closed unless `delay` asks for it: then
    rows of days older than the newest by more than that are left out, and `late_rows` tells
    how many. Every batch writes the counts of all days as a new version and removes those
    before the last; a batch that is run again replaces its own version.
    """
    # Days of the session's calendar, as in the batch report; time windows would be UTC days.
    day = F.date_trunc("day", F.col("scraped_at").cast("timestamp"))
    days = books.where(F.col("scraped_at").isNotNull()).select(day.alias("day"))
    if delay is not None:
        days = days.withWatermark("day", delay)
        _listener(books.sparkSession)
    counts = days.groupBy("day").agg(F.count("*").alias("n"))
    counts = counts.select(F.to_date("day").alias("scrape_date"), "n")

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = [v for v in numbered_folders(spark, out, _VERSION) if v < batch_id]
        if versions:
            known = spark.read.schema(_SCHEMA).parquet(f"{out}/{_VERSION}{versions[-1]}")
            # One row per day on both sides.
            batch = batch.unionByName(known.join(batch, "scrape_date", "left_anti"))
        # One row per day goes to one file; coalesce would run the tasks of the state as one.
        batch.repartition(1).write.mode("overwrite").parquet(f"{out}/{_VERSION}{batch_id}")
        for old in versions[:-1]:
            delete_folder(spark, f"{out}/{_VERSION}{old}")

    return (
        counts.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Adds up what the watermarks of runs leave out, batch by batch, however many there are."""

    def __init__(self) -> None:
        self.totals: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        with self.lock:
            self.totals[run] = self.totals.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def total(self, run: str, ended: bool, patience: float = 60.0) -> int:
        """The total of a run; of one that has ended, after its last batch was reported."""
        if ended and not self._end(run).wait(patience):
            raise TimeoutError(f"the end of run {run} was not reported")
        with self.lock:
            return self.totals.get(run, 0)


_LISTENERS: dict[str, LateRows] = {}


def _listener(spark: SparkSession) -> LateRows:
    """The listener of the application, added once."""
    application = spark.sparkContext.applicationId
    if application not in _LISTENERS:
        _LISTENERS[application] = LateRows()
        spark.streams.addListener(_LISTENERS[application])
    return _LISTENERS[application]


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows that the watermark of a run of `stream_daily_counts` left out, in all batches."""
    found = _LISTENERS[SparkSession.active().sparkContext.applicationId]
    return found.total(str(query.runId), not query.isActive)


def read_daily_counts(spark: SparkSession, out: str) -> DataFrame:
    """The latest count of every day."""
    versions = numbered_folders(spark, out, _VERSION)
    if not versions:
        return spark.createDataFrame([], _SCHEMA)
    latest = spark.read.schema(_SCHEMA).parquet(f"{out}/{_VERSION}{versions[-1]}")
    return latest.orderBy("scrape_date")
