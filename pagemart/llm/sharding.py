"""Shards of near-equal bytes from groups that must stay whole: largest differencing.

Equal texts form a group, which no shard may split. Differencing (Karmarkar and Karp) keeps a
set of partial partitions, each with one sum per shard, and repeatedly combines the two with
the largest spread, the fullest shard of one with the emptiest of the other.

A heap is sequential, so it must not see one entry per group of the corpus. Groups of at
least 1/HEAVY of all bytes (HEAVY of them at most) enter it on their own; all others are first
gathered into BUNDLES unions of whole groups by a hash. With no more than HEAVY + BUNDLES
groups every group enters it on its own. The heap so has HEAVY + BUNDLES
entries at most, whatever the size of the corpus, and the bundles are small enough to level
out the heavy groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemart.llm.common import documents, in_corpus, written

HEAVY = 4096
BUNDLES = 8192
SLOT_ROWS = 100_000


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each entry, by largest differencing."""
    if not len(sizes):
        return []
    # A partition is (sums, children); a child is (partition number, the order of its sums).
    made: list[tuple] = []
    heap: list[tuple[int, int]] = []

    def put(sums: list[int], children: tuple) -> None:
        heapq.heappush(heap, (min(sums) - max(sums), len(made)))
        made.append((sums, children))

    for size in sizes:
        put([int(size)] + [0] * (shards - 1), ())
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        down = sorted(range(shards), key=made[a][0].__getitem__, reverse=True)
        up = sorted(range(shards), key=made[b][0].__getitem__)
        sums = [made[a][0][i] + made[b][0][j] for i, j in zip(down, up, strict=True)]
        put(sums, ((a, down), (b, up)))
    # From the last partition down: which shard each sum of a partition ends in.
    ends: dict[int, list[int]] = {len(made) - 1: list(range(shards))}
    for number in range(len(made) - 1, len(sizes) - 1, -1):
        own = ends.pop(number)
        for child, order in made[number][1]:
            place = [0] * shards
            for shard, part in zip(own, order, strict=True):
                place[part] = shard
            ends[child] = place
    return [ends[i][0] for i in range(len(sizes))]


def assign_shards(rows: DataFrame, key: str, size: str, shards: int = 8) -> DataFrame:
    """`rows` with a `shard` (0 to shards - 1): rows of one key together, sizes near equal.

    Reads `rows` three times; give it a written table. Rows with a null key form one group.
    """
    groups = rows.groupBy(key).agg(F.sum(size).alias("_bytes"))
    total = groups.agg(F.sum("_bytes").alias("_total"), F.count("*").alias("_groups"))
    # One row joined to all, then HEAVY + BUNDLES rows at most: both broadcasts are bounded.
    few = F.col("_groups") <= HEAVY + BUNDLES
    heavy = groups.join(F.broadcast(total)).where(few | (F.col("_bytes") * HEAVY >= F.col("_total")))
    heavy = heavy.select(F.col(key).alias("_heavy"), F.lit(True).alias("_alone"))
    alone = F.coalesce(F.col("_alone"), F.lit(False))
    node = F.when(alone, F.xxhash64(F.col(key))).otherwise(
        F.pmod(F.xxhash64(F.lit("bundle"), F.col(key)), F.lit(BUNDLES))
    )
    placed = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")), "left")
    placed = placed.withColumns({"_alone": alone, "_node": node}).drop("_heavy")
    nodes = placed.groupBy("_alone", "_node").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_bytes"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_bytes", "descending"), ("_alone", "ascending"), ("_node", "ascending")])
        found = differencing(table["_bytes"].to_pylist(), shards)
        return table.select(["_alone", "_node"]).append_column("shard", pa.array(found, pa.int32()))

    solved = (
        nodes.withColumn("_all", F.lit("one"))
        .groupBy("_all")
        .applyInArrow(solve, "_alone boolean, _node long, shard int")
    )
    return placed.join(F.broadcast(solved), ["_alone", "_node"]).drop("_alone", "_node")


def numbered(rows: DataFrame, group: str, order: list[Column], spread: Column, count: int) -> DataFrame:
    """`rows` with a gapless `slot` from 0 in each group.

    Rows are numbered within parts of a group, found by the hash `spread`, and each part
    starts where the parts before it end; no task holds a whole group.
    """
    parted = rows.withColumn("_part", in_corpus(spread, count, SLOT_ROWS))
    sizes = parted.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (
        parted.withColumn("_place", within)
        .join(starts.drop("_rows"), [group, "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_part", "_place", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard and its slot there, by the law `bytes`.

    Size is the UTF-8 length of the text plus 1; a null text counts as empty, and null and
    empty texts form one group. Repeated rows are rows of their own in the same shard. A null
    doc_id is allowed. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )
    rows = written(rows, "shard-sizes")
    placed = assign_shards(rows, "_key", "size", shards)
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size", "_key")]
    spread = F.xxhash64("doc_id", "text_crc32")
    slots = numbered(placed, "shard", order, spread, rows.count())
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
