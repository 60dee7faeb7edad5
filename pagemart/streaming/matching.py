"""What the stream of pages remembers, in Spark's state store.

One state per url: the detail of the book, and the listing rows that wait for it. One state
per UPC: that it was loaded. A batch reads and writes the state of its own keys only, so its
cost does not grow with what was loaded before. Rows come and go as rows: most keys have one,
and a pandas frame for each of them takes far longer than its state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

# The tasks need this one module; it travels with the job instead of being installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows in: listing rows and details, each as JSON. Rows out: a listing with its detail, or the
#: row of an item that could not be read.
MATCH_IN = "key string, kind string, page_id long, pos int, payload string"
MATCH_OUT = "kind string, page_id long, pos int, listing string, detail string, since long"
FIRST_OUT = "page_id long, pos int, payload string, status string"


def _batch_id() -> int:
    return int(TaskContext.get().getLocalProperty("streaming.sql.batchId") or 0)


def _place(value: int | None) -> tuple[bool, int]:
    """Nulls first."""
    return (False, 0) if value is None else (True, value)


_MATCHED = Row("kind", "page_id", "pos", "listing", "detail", "since")
_FIRST = Row("page_id", "pos", "payload", "status")


class MatchDetails(StatefulProcessor):
    """Listing rows leave when the detail of their url is there, in whatever order both come.

    Of several details of one url, the one with the smallest page_id counts among those that
    are there when a listing row leaves. Rows that came in batches up to `released` were
    loaded without a detail and wait no more. With `patience` (milliseconds) a listing row
    leaves without a detail after so long; it takes a batch to notice.
    """

    def __init__(self, released: int, patience: int | None):
        self.released, self.patience = released, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.detail = handle.getValueState("detail", "page_id long, payload string")
        self.waiting = handle.getListState("waiting", "page_id long, pos int, payload string, since long")

    def _waited(self, detail: str | None) -> list[Row]:
        """The rows that have waited, which wait no more."""
        waiting = list(self.waiting.get())
        if waiting:
            self.waiting.clear()
        return [
            _MATCHED("record", page_id, pos, payload, detail, since)
            for page_id, pos, payload, since in waiting
            if since > self.released
        ]

    def handleInputRows(
        self, key: tuple, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        listings, details = [], []
        batch = _batch_id()
        for row in rows:
            if row.kind == "listing":
                listings.append((row.page_id, row.pos, row.payload, batch))
            elif row.kind == "detail":
                details.append((_place(row.page_id), row.payload, row.page_id))
            else:
                yield _MATCHED("reject", row.page_id, row.pos, None, row.payload, batch)
        # Each use of the state is a message: rows that need not wait are not put there.
        known = self.detail.get() if details or listings else None
        if details:
            candidates = [*details, (_place(known[0]), known[1], known[0])] if known else details
            _, payload, page_id = min(candidates, key=lambda d: d[:2])
            if not known or (page_id, payload) != tuple(known):
                self.detail.update((page_id, payload))
            if not known:
                yield from self._waited(payload)
            known = (page_id, payload)
        if known:
            for page_id, pos, payload, since in listings:
                yield _MATCHED("record", page_id, pos, payload, known[1], since)
        elif listings:
            self.waiting.appendList(listings)
            if self.patience is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        yield from self._waited(None)

    def close(self) -> None:
        pass


class FirstOfKey(StatefulProcessor):
    """The first record of each UPC is new, all others are skipped; what is no valid record or
    has no UPC passes through with its status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(
        self, key: tuple, rows: Iterator[Row], timerValues: TimerValues
    ) -> Iterator[Row]:
        keyed = []
        for row in rows:
            if row.status == "keyed":
                keyed.append((row.page_id, row.pos, row.payload))
            else:
                yield _FIRST(row.page_id, row.pos, row.payload, row.status)
        if keyed:
            keyed.sort(key=lambda r: (_place(r[0]), _place(r[1]), r[2]))
            new = not self.seen.exists()
            if new:
                self.seen.update((True,))
            for i, record in enumerate(keyed):
                yield _FIRST(*record, "new" if new and i == 0 else "skipped")

    def handleInitialState(
        self, key: tuple, initialState: Row, timerValues: TimerValues
    ) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass
