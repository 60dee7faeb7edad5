"""Mixing sources to target weights: a temperature on source shares, realised as blocks.

A source with share q of all tokens gets weight q**x / sum(q**x). The exponent x is bisected:
the largest in [0, 1] whose weights reach a target entropy, raised where some source would be
repeated more often than allowed. The target is a share of the way from the entropy of the
sources as they are to that of an even mix, unless it is given as a share of the latter. The
budget of tokens times the weight is what a source must deliver: whole passes over its documents
and part of one more. With `keep_all` the budget is the least that passes every source once, so
no document is left out and the smaller sources are repeated.

A pass is a permutation of blocks, and of the documents within each block, both by seeded
hashes. Where a document starts in the pass is the tokens of the blocks before it plus those
before it in its block, so no task sees more than a block and a source may hold most of the
rows.

Everything is a column expression; the bisection runs inside one row that has an entry per
source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemart.llm.common import WORD, documents, let, written

#: How far the weights go from the entropy of the natural shares to that of an even mix.
ENTROPY_GAP = 0.5
#: No document is taken more often than this, rounded up.
MAX_PASSES = 4.0
BLOCK_TOKENS = 1 << 18
SALTS = 16
STEPS = 60


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _powers(logs: Column, x: Column) -> Column:
    return F.transform(logs, lambda l: F.exp(l * x))


def entropy(logs: Column, x: Column) -> Column:
    """Entropy (nats) of the weights for logarithms of shares and an exponent."""

    def of(powers: Column) -> Column:
        weighted = _sum(F.zip_with(powers, logs, lambda p, l: p * l))
        return F.ln(_sum(powers)) - x * weighted / _sum(powers)

    return let(_powers(logs, x), of)


def most_passes(logs: Column, x: Column, passes: Column) -> Column:
    """How often the most repeated source is passed, if an even mix passes all `passes` times."""

    def of(powers: Column) -> Column:
        ratios = F.zip_with(powers, logs, lambda p, l: p / F.exp(l))
        return F.array_max(ratios) * passes / _sum(powers)

    return let(_powers(logs, x), of)


def pass_ratio(logs: Column, x: Column) -> Column:
    """How much more often the most repeated source is passed than the least repeated."""

    def of(ratios: Column) -> Column:
        return F.array_max(ratios) / F.array_min(ratios)

    return let(F.transform(logs, lambda l: F.exp(l * (x - 1))), of)


def bisect(above: Callable[[Column], Column]) -> Column:
    """The interval in [0, 1], halved STEPS times, that holds the answer, as [low, high].

    `above(x)` tells that the answer is at or above x.
    """
    start = F.array(F.lit(0.0), F.lit(1.0))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        start,
        lambda interval, _: let(
            (interval[0] + interval[1]) / 2,
            lambda x: F.when(above(x), F.array(x, interval[1])).otherwise(F.array(interval[0], x)),
        ),
    )


def source_weights(
    sources: DataFrame,
    target_entropy: float | None = None,
    max_passes: float = MAX_PASSES,
    budget: int | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """(source, tokens, exponent, weight, target): what each source must deliver.

    `target_entropy` is a share of the largest possible entropy; without it the target lies
    ENTROPY_GAP of the way to that.

    `sources` has (source, tokens). The budget is the tokens of the corpus unless given, and at
    most `max_passes` times them. A source without tokens has no row; a null source is a source.
    """
    found = sources.where(F.col("tokens") > 0)
    whole = found.agg(
        F.sum("tokens").alias("total"),
        F.array_sort(F.collect_list(F.struct("tokens", "source"))).alias("sources"),
    ).where(F.col("total") > 0)
    logs = F.transform("sources", lambda s: F.ln(s["tokens"] / F.col("total")))
    most = F.col("total") * max_passes
    wanted = F.least(F.lit(budget).cast("double"), most) if budget is not None else F.least("total", most)
    whole = whole.select("total", "sources", logs.alias("logs"), wanted.cast("double").alias("budget"))
    even, natural = F.ln(F.size("sources").cast("double")), entropy(F.col("logs"), F.lit(1.0))
    goal = natural + ENTROPY_GAP * (even - natural) if target_entropy is None else target_entropy * even
    whole = whole.withColumn("goal", goal)
    goal, passes = F.col("goal"), F.col("budget") / F.col("total")

    def too_often(x: Column) -> Column:
        often = pass_ratio(F.col("logs"), x) if keep_all else most_passes(F.col("logs"), x, passes)
        return often > max_passes

    flat = bisect(lambda x: entropy(F.col("logs"), x) >= goal)
    steep = bisect(too_often)
    whole = whole.withColumns(
        {
            "flat": F.when(entropy(F.col("logs"), F.lit(1.0)) >= goal, 1.0).otherwise(flat[0]),
            "steep": F.when(~too_often(F.lit(0.0)), 0.0).otherwise(steep[1]),
        }
    ).withColumn("exponent", F.greatest("flat", "steep"))
    powers = whole.withColumn("powers", _powers(F.col("logs"), F.col("exponent")))
    powers = powers.withColumn("z", _sum(F.col("powers")))
    if keep_all:
        # Of the largest ratio of tokens to weight; rounded up a little, so a pass is whole.
        ratios = F.zip_with("sources", "powers", lambda s, p: s["tokens"] * F.col("z") / p)
        powers = powers.withColumn("budget", F.array_max(ratios) * (1 + 1e-12))
    each = powers.select(
        "exponent", "budget", "z", F.explode(F.arrays_zip("sources", "powers")).alias("one")
    )
    return each.select(
        F.col("one.sources.source").alias("source"),
        F.col("one.sources.tokens").alias("tokens"),
        "exponent",
        (F.col("one.powers") / F.col("z")).alias("weight"),
        (F.col("budget") * F.col("one.powers") / F.col("z")).alias("target"),
    )


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_passes: float = MAX_PASSES,
    budget: int | None = None,
    seed: int = 7,
    keep_all: bool = False,
) -> DataFrame:
    """One row per document taken: (doc_id, source, n_words, weight, pass, position, key, nth).

    `pass` counts from 0; `position` (0 to 1) is how far into the source's target the document
    starts, so that sorting all rows by it interleaves the sources by weight. `key` and `nth`
    name the row of `docs`: equal rows have equal keys and different nth.

    A source delivers its target and at most one document more. Documents without words start
    where the next one does and take nothing. Null sources are one source. A corpus without
    words gives no rows. Further columns are ignored.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("n_words"), _row_key(docs).alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    rows = written(rows.withColumn("nth", nth), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("n_words").alias("tokens"))
    weights = written(source_weights(sources, target_entropy, max_passes, budget, keep_all), "mix-weights")

    # Salted: each row of the small side once per salt, so a source is spread over SALTS tasks.
    salted = weights.withColumns(
        {
            "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))),
            "blocks": F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)),
            "whole": F.floor(F.col("target") / F.col("tokens")).cast("long"),
        }
    ).withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.pmod("key", F.lit(SALTS)) == F.col("salt"))
    taken = rows.join(salted, same).drop("of", "salt")
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    taken = taken.withColumns(
        {
            "block": F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")),
            "shuffle": F.xxhash64(F.lit(seed + 1), "pass", "key", "nth"),
        }
    )
    parts = ["source", "pass", "block"]
    totals = taken.groupBy(*parts).agg(F.sum("n_words").alias("block_words"))
    order = F.xxhash64(F.lit(seed + 2), "pass", "block")
    before = Window.partitionBy("source", "pass").orderBy(order, "block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"b_{c}") for c in parts],
        F.coalesce(F.sum("block_words").over(before), F.lit(0)).alias("block_start"),
    )
    inside = Window.partitionBy(*parts).orderBy("shuffle", "key", "nth")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = taken.withColumn("inside", F.coalesce(F.sum("n_words").over(inside), F.lit(0)))
    match = F.lit(True)
    for c in parts:
        match = match & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    placed = placed.join(starts, match)
    start = F.col("pass") * F.col("tokens") + F.col("block_start") + F.col("inside")
    return placed.where(start < F.col("target")).select(
        "doc_id",
        "source",
        "n_words",
        "weight",
        F.col("pass").cast("int").alias("pass"),
        (start / F.col("target")).alias("position"),
        "key",
        "nth",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of `docs`, one row per document taken by `mix`, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    keyed = docs.select(row, _row_key(docs).alias("key")).withColumn("nth", nth)
    taken = mix(docs, **options).select("key", "nth")
    return keyed.join(taken, ["key", "nth"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir), keep_all=True)
    return found.withColumn("source_share", F.round("weight", 9)).drop("key", "nth", "weight")
