"""Exact percentiles whose memory does not grow with the data.

Groups within a measured size use the built-in exact percentile, which keeps every distinct
value of a group in one task. Larger groups are narrowed by histograms: count the values per
equal-width bin between the lowest and the highest value, keep the bin that holds the wanted
rank, use its own lowest and highest value as the new limits, repeat. Each round is one scan
of the key and value columns with a fixed number of counters per group, and each interval ends
a round with fewer distinct values than it had, so the rounds end.

Infinite values and NaN have no place in equal-width bins. They are counted per group, and
ranks among them are answered from the counts: negative infinity comes first, then the finite
values, then infinity, then NaN, as in the built-in percentile.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemart.plans.lookup import checkpointed, small_rows

SMALL_GROUP = 100_000
BINS = 4096


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] | None = None,
    names: list[str] | None = None,
    small_group: int = SMALL_GROUP,
    bins: int = BINS,
) -> DataFrame:
    """One row per group with the linearly interpolated percentiles; null keys have none."""
    keys = list(by or [])
    names = names or [f"p{i}" for i in range(len(probabilities))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    infinite = F.col("_v").isin(float("inf"), float("-inf"))
    finite = ~F.isnan("_v") & ~infinite
    extent = rows.groupBy(*keys).agg(
        F.count("*").alias("_m"),
        F.count_if(F.col("_v") == float("-inf")).alias("_first"),
        F.count_if(finite).alias("_finite"),
        F.count_if(F.col("_v") == float("inf")).alias("_last"),
        F.min(F.when(finite, F.col("_v"))).alias("_lo"),
        F.max(F.when(finite, F.col("_v"))).alias("_hi"),
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    place = (F.col("_m") - 1) * F.col("_p")
    # A target: ranks _k and _k + 1 lie between _lo and _hi, with _below rows under _lo; the
    # percentile is the _part between their values.
    targets = extent.where(F.col("_m") > 0).withColumn("_p", wanted)

    def beyond(rank: Column) -> Column:
        """The value of a rank that is not among the finite values, else null."""
        after = rank - F.col("_first") - F.col("_finite")
        return (
            F.when(rank < F.col("_first"), float("-inf"))
            .when(after >= F.col("_last"), float("nan"))
            .when(after >= 0, float("inf"))
        )

    rank = F.floor(place)
    targets = targets.select(
        *keys,
        "_m",
        "_p",
        F.greatest(rank - F.col("_first"), F.lit(0)).alias("_k"),
        (place - rank).alias("_part"),
        F.lit(0).cast("bigint").alias("_below"),
        "_lo",
        "_hi",
        beyond(rank).alias("_low_beyond"),
        beyond(F.least(rank + 1, F.col("_m") - 1)).alias("_high_beyond"),
        # A rank beyond the finite values is answered already.
        (F.coalesce(F.col("_lo") < F.col("_hi"), F.lit(False)) & beyond(rank).isNull()).alias("_open"),
    )
    state = _State(targets)
    if state.largest() <= small_group:
        percentile = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probabilities]))
        picked = rows.groupBy(*keys).agg(percentile.alias("_p"))
        return picked.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    done = []
    finite_rows = rows.where(finite)
    while True:
        low = F.coalesce("_low_beyond", "_lo")
        high = F.coalesce("_high_beyond", F.when(F.col("_low_beyond").isNull(), F.col("_hi")), "_lo")
        mixed = low * (1 - F.col("_part")) + high * F.col("_part")
        is_beyond = F.coalesce("_low_beyond", "_high_beyond").isNotNull()
        between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")
        value_at = (
            F.when((F.col("_part") == 0) | low.eqNullSafe(high), low)
            .when(is_beyond, mixed)
            .otherwise(between)
        )
        done.append(state.frame.where("NOT _open").select(*keys, "_p", value_at.alias("_value")))
        if not state.any_open():
            break
        state = _State(_narrowed(finite_rows, state, keys, bins))
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_p") == F.lit(float(p)), F.col("_value"))).alias(n)
            for p, n in zip(probabilities, names)
        ]
    )


class _State:
    """The targets between two rounds: local rows when few, a checkpoint when many."""

    def __init__(self, targets: DataFrame):
        self.rows = small_rows(targets)
        if self.rows is None:
            self.frame = checkpointed(targets)
        else:
            self.frame = targets.sparkSession.createDataFrame(self.rows, schema=targets.schema)

    def largest(self) -> int:
        if self.rows is None:
            return self.frame.agg(F.max("_m").alias("m")).first()["m"]
        return pc.max(self.rows["_m"]).as_py() or 0

    def any_open(self) -> bool:
        if self.rows is None:
            return not self.frame.where("_open").isEmpty()
        return bool(pc.any(self.rows["_open"]).as_py())


def _inside(rows: DataFrame, state: _State, keys: list[str]) -> DataFrame:
    """Each value once per open interval that it lies in."""
    if keys:
        spans = state.frame.where("_open").select(*keys, "_lo", "_hi").distinct()
        # At most one interval per probability and group, and broadcast only if measured.
        within = rows.join(spans if state.rows is None else F.broadcast(spans), keys)
    else:
        limits = {(r["_lo"], r["_hi"]) for r in state.rows.to_pylist() if r["_open"]}
        spans = [F.struct(F.lit(a).alias("_lo"), F.lit(b).alias("_hi")) for a, b in sorted(limits)]
        within = rows.select("_v", F.inline(F.array(*spans)))
    return within.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(rows: DataFrame, state: _State, keys: list[str], bins: int) -> DataFrame:
    """Histogram the open intervals and put each target into the bin of its rank."""
    # Halving first keeps the width finite for the widest doubles.
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    spot = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / F.nullif(width, F.lit(0.0)) * bins)
    # Neighbouring numbers may have no width between them: the lowest value against the rest.
    spot = F.coalesce(spot, F.when(F.col("_v") > F.col("_lo"), bins - 1).otherwise(0))
    histogram = (
        _inside(rows, state, keys)
        .withColumn("_bin", F.least(spot, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "_lo", "_hi", "_bin")
        .agg(
            F.count("*").alias("_n"),
            F.min("_v").alias("_bin_lo"),
            F.max("_v").alias("_bin_hi"),
        )
    )
    # The histogram has at most `bins` rows per group and interval.
    order = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin")
    histogram = histogram.withColumn(
        "_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_next_lo", F.lead("_bin_lo").over(order))
    rank = F.col("_k") - F.col("_below")
    found = state.frame.where("_open").join(histogram, [*keys, "_lo", "_hi"]).where(
        (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    )
    # The rank is the last of its bin: its value and the next one are known.
    split = (rank + 1 == F.col("_upto")) & F.col("_next_lo").isNotNull()
    low = F.when(split, F.col("_bin_hi")).otherwise(F.col("_bin_lo"))
    high = F.when(split, F.col("_next_lo")).otherwise(F.col("_bin_hi"))
    # The highest rank of all has no next one.
    last = (rank + 1 == F.col("_upto")) & F.col("_next_lo").isNull()
    low = F.when(last, F.col("_bin_hi")).otherwise(low)
    return found.select(
        *keys,
        "_m",
        "_p",
        "_k",
        "_part",
        (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below"),
        low.alias("_lo"),
        high.alias("_hi"),
        "_low_beyond",
        "_high_beyond",
        (~split & (low < high)).alias("_open"),
    )
