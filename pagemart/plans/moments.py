"""Means, spreads and covariances of many column pairs from one aggregate.

Rows are grouped by which columns they have a value in; each group holds its count and, over
values shifted near their mean, the sums and the sums of products. Groups of different tables
or loads with the same shifts add up, so they can be kept and merged. A pair of columns takes
the groups in which both have values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PairMoments:
    """Of the rows where both columns of a pair have a value."""

    n: int
    mean_x: float
    mean_y: float
    spread_x: float
    spread_y: float
    product: float
    is_constant: bool

    @property
    def r(self) -> float | None:
        """Pearson correlation; none with a constant column or under two rows."""
        if self.n < 2 or self.is_constant:
            return None
        spread = math.sqrt(self.spread_x) * math.sqrt(self.spread_y)
        return self.product / spread if spread else None


def pattern_sums(frame: DataFrame, columns: list[str], shifts: list[float]) -> DataFrame:
    """(pattern, n, s_i, low_i, high_i, p_i_j): a row for each combination of columns with values."""
    numbers = [F.col(c).cast("double") for c in columns]
    bits = [F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(numbers)]
    pattern = sum(bits[1:], bits[0])
    shifted = [F.coalesce(v - F.lit(s), F.lit(0.0)).alias(f"v_{i}") for i, (v, s) in enumerate(zip(numbers, shifts, strict=True))]
    rows = frame.select(pattern.alias("pattern"), *shifted)
    places = range(len(columns))
    return rows.groupBy("pattern").agg(
        F.count("*").alias("n"),
        *[F.sum(f"v_{i}").alias(f"s_{i}") for i in places],
        *[F.min(f"v_{i}").alias(f"low_{i}") for i in places],
        *[F.max(f"v_{i}").alias(f"high_{i}") for i in places],
        *[F.sum(F.col(f"v_{i}") * F.col(f"v_{j}")).alias(f"p_{i}_{j}") for i in places for j in places if i <= j],
    )


def merged_sums(*parts: DataFrame) -> DataFrame:
    """One row per pattern from parts with the same columns and shifts."""
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    kinds = {"low": F.min, "high": F.max}
    names = [c for c in whole.columns if c != "pattern"]
    return whole.groupBy("pattern").agg(*[kinds.get(c.split("_")[0], F.sum)(c).alias(c) for c in names])


def pair_moments(sums: list, shifts: list[float], i: int, j: int) -> PairMoments:
    """The moments of columns i <= j from the rows of `pattern_sums`."""
    both = (1 << i) | (1 << j)
    rows = [r for r in sums if r["pattern"] & both == both]
    n = sum(r["n"] for r in rows)
    if not n:
        return PairMoments(0, math.nan, math.nan, 0.0, 0.0, 0.0, True)
    total = {name: math.fsum(r[name] for r in rows) for name in (f"s_{i}", f"s_{j}", f"p_{i}_{i}", f"p_{j}_{j}", f"p_{i}_{j}")}
    mean_x, mean_y = total[f"s_{i}"] / n, total[f"s_{j}"] / n
    constant = any(min(r[f"low_{k}"] for r in rows) == max(r[f"high_{k}"] for r in rows) for k in (i, j))
    return PairMoments(
        n,
        mean_x + shifts[i],
        mean_y + shifts[j],
        max(total[f"p_{i}_{i}"] - n * mean_x * mean_x, 0.0),
        max(total[f"p_{j}_{j}"] - n * mean_y * mean_y, 0.0),
        total[f"p_{i}_{j}"] - n * mean_x * mean_y,
        constant,
    )


def pair_columns(patterns: Column, i: int, j: int) -> Column:
    """The same as columns (n, r) over an array of all rows of `pattern_sums`."""
    both = (1 << i) | (1 << j)
    sums = {"s_x": f"s_{i}", "s_y": f"s_{j}", "p_x": f"p_{i}_{i}", "p_y": f"p_{j}_{j}", "p": f"p_{i}_{j}"}
    limits = {"low_x": f"low_{i}", "high_x": f"high_{i}", "low_y": f"low_{j}", "high_y": f"high_{j}"}
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0).cast("long").alias("n"),
        *[F.lit(0.0).alias(k) for k in sums],
        *[none.alias(k) for k in limits],
    )

    def add(total: Column, row: Column) -> Column:
        more = F.struct(
            (total["n"] + row["n"]).alias("n"),
            *[(total[k] + row[v]).alias(k) for k, v in sums.items()],
            *[
                (F.least if k.startswith("low") else F.greatest)(total[k], row[v]).alias(k)
                for k, v in limits.items()
            ],
        )
        return F.when(row["pattern"].bitwiseAND(F.lit(both)) == both, more).otherwise(total)

    def finish(t: Column) -> Column:
        spread_x = F.greatest(t["p_x"] - t["s_x"] * t["s_x"] / t["n"], F.lit(0.0))
        spread_y = F.greatest(t["p_y"] - t["s_y"] * t["s_y"] / t["n"], F.lit(0.0))
        varied = (t["n"] > 1) & (t["low_x"] < t["high_x"]) & (t["low_y"] < t["high_y"])
        spread = F.nullif(F.sqrt(spread_x) * F.sqrt(spread_y), F.lit(0.0))
        r = F.when(varied, (t["p"] - t["s_x"] * t["s_y"] / t["n"]) / spread)
        return F.struct(t["n"].alias("n"), r.alias("r"))

    return F.aggregate(patterns, start, add, finish)


def shifts_of(frame: DataFrame, columns: list[str]) -> list[float]:
    """The mean of each column, which sums of products are taken around; 0 without values."""
    means = frame.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [m if m is not None and math.isfinite(m) else 0.0 for m in means]
