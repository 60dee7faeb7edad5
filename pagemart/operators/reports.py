"""One cached report frame shared by all reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from pagemart.operators.enrich import enriched


class ReportFrame:
    """The enriched books table, kept in memory and on disk until cleared.

    The caller decides when the data is stale; nothing expires by itself.
    """

    def __init__(self, books: DataFrame):
        self._books = books
        self._frame: DataFrame | None = None

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = enriched(self._books).persist(StorageLevel.MEMORY_AND_DISK)
        return self._frame

    def clear(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None

    @property
    def is_empty(self) -> bool:
        return self.frame.isEmpty()
