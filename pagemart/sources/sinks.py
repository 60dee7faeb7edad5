"""Exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemart.functions.text import iso_timestamp


def export_csv(frame: DataFrame, folder: str, columns: list[str] | None = None) -> str:
    """Write the chosen columns as CSV with a header below a time-stamped folder."""
    path = f"{folder.rstrip('/')}/books_data_{datetime.now():%Y%m%d_%H%M%S}"
    chosen = frame.select(columns) if columns else frame
    chosen.write.option("header", True).option("escape", '"').csv(path)
    return path


def with_iso_times(frame: DataFrame) -> DataFrame:
    """Timestamps as ISO 8601 texts."""
    times = [name for name, kind in frame.dtypes if kind in ("timestamp", "timestamp_ntz")]
    return frame.withColumns({c: iso_timestamp(F.col(c)) for c in times})


def to_json_rows(frame: DataFrame) -> DataFrame:
    """One JSON object per row, nulls written out."""
    rows = with_iso_times(frame)
    return rows.select(
        F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json")
    )


def export_json(frame: DataFrame, folder: str) -> None:
    """Write JSON lines."""
    with_iso_times(frame).write.option("ignoreNullFields", False).json(folder)
