"""What a load adds to the books table, what it skips and what it rejects.

Rules: a record must be valid; a UPC already in the table is skipped, not updated; within the
batch the first record of a UPC wins; records without a UPC are always added; the blank UPC
'' is a key like any other. One plan of an aggregate and an anti join decides for the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemart.plans.lookup import first_per_key, held_if_small
from pagemart.schema import MAX_LENGTH, RECORD


@dataclass(frozen=True)
class LoadPlan:
    """What a load would do. `accepted` also carries the `places` columns, the record order."""

    accepted: DataFrame
    rejected: DataFrame
    counts: DataFrame
    places: list[str]

    @property
    def summary(self) -> DataFrame:
        """Inserted, skipped and rejected records, one row."""
        inserted = self.accepted.agg(F.count("*").alias("n")).select("n").scalar()
        return self.counts.withColumn("inserted", inserted).select(
            "inserted",
            (F.col("records") - F.col("inserted") - F.col("rejected")).alias("skipped"),
            "rejected",
        )


def _rules(
    unknown: list[str], column: Callable[[str], Column] = F.col
) -> list[tuple[Column, str]]:
    """(condition that a valid record meets, text if it does not), in order."""
    rules = [(column(c).isNotNull(), f"{c} is missing") for c in ("title", "price")]
    rules += [
        (F.coalesce(F.length(column(c)) <= longest, F.lit(True)), f"{c} is longer than {longest}")
        for c, longest in MAX_LENGTH.items()
    ]
    return rules + [(F.col(c).isNull(), f"unknown field {c}") for c in unknown]


def is_valid(unknown: list[str], column: Callable[[str], Column] = F.col) -> Column:
    """All rules as one conjunction of plain conditions, which the scan can take over."""
    return reduce(Column.__and__, [met for met, _ in _rules(unknown, column)])


def reject_reason(unknown: list[str]) -> Column:
    """First rule a record breaks, NULL for a valid one."""
    reason = F.lit(None).cast("string")
    for met, text in reversed(_rules(unknown)):
        reason = F.when(~met, F.lit(text)).otherwise(reason)
    return reason


def as_records(batch: DataFrame) -> DataFrame:
    """The batch with every record column, absent ones null, unknown ones kept behind."""
    known = [
        (F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RECORD
    ]
    extra = [c for c in batch.columns if c not in RECORD.fieldNames()]
    return batch.select(*known, *extra)


def record_counts(batch: DataFrame, order: list[str]) -> list[Column]:
    """Aggregates over a batch as it comes: `records` and `rejected`, as a plan would count them."""
    known = {f.name: f for f in RECORD}

    def typed(name: str) -> Column:
        value = F.col(name) if name in batch.columns else F.lit(None)
        return value.cast(known[name].dataType)

    unknown = [c for c in batch.columns if c not in known and c not in order]
    return [
        F.count("*").alias("records"),
        F.count_if(~is_valid(unknown, typed)).alias("rejected"),
    ]


def plan_load(
    batch: DataFrame,
    target: DataFrame,
    order: list[str] | None = None,
    cut_target: bool = False,
) -> LoadPlan:
    """Decide a load of `batch` into `target`, which needs only a upc column.

    With `cut_target` the keys of the batch are counted first; if they are few, they are
    broadcast and the target is cut down to them where it is read, so that a small batch does
    not shuffle the keys of a large table. Give it a batch that is written out.

    `order` names batch columns that give the order of the records; they may be outside the
    record schema and are dropped. Further ties are broken by the record itself.
    """
    order = order or []
    places = [f"_place_{i}" for i in range(len(order))]
    aside = [c for c in order if c not in RECORD.fieldNames()]
    records = as_records(batch.withColumns(dict(zip(places, map(F.col, order)))).drop(*aside))
    unknown = [c for c in records.columns if c not in RECORD.fieldNames() + places]
    valid = records.where(is_valid(unknown)).drop(*unknown)
    rejected = records.where(~is_valid(unknown)).withColumn("reason", reject_reason(unknown))
    without_key = valid.where(F.col("upc").isNull())
    with_key = valid.where(F.col("upc").isNotNull())
    first = first_per_key(with_key, "upc", [F.col(c) for c in places])
    known = target.select("upc").where(F.col("upc").isNotNull())
    keys = held_if_small(with_key.select("upc").distinct()) if cut_target else None
    if keys is not None:
        known = known.join(F.broadcast(keys), "upc", "left_semi").distinct()
    else:
        # Never broadcast: the size of one column of a table is an estimate by types, which is
        # far too low where the other columns are mostly null.
        known = known.hint("merge")
    new = first.join(known, "upc", "left_anti").select(valid.columns)
    return LoadPlan(
        accepted=new.unionByName(without_key),
        rejected=rejected.drop(*places),
        counts=records.agg(
            F.count("*").alias("records"), F.count_if(~is_valid(unknown)).alias("rejected")
        ),
        places=places,
    )
