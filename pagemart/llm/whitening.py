"""Whitening of embeddings by the principal components of their covariance.

Entries become integers, so equal vectors are equal and sums are exact. The covariance is that of
the distinct vectors: one distinct, one pass for the sums, one for the products of centred
vectors. Tasks send one row of sums, and one partial matrix as wide as the vectors. The
components come from `feast`; a last pass over the distinct vectors measures how far the
covariance of the whitened ones is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.feast import largest_pairs
from pagemart.sources.files import Scratch

#: Fixed by the contract.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: 64 times an entry is cut off at this size, so sums over an Arrow batch stay within 64 bits.
LARGEST = 1 << 45


def whole_numbers(embedding: Column) -> Column:
    """The entries as whole numbers: floor(SCALE * c) + OFFSET."""

    def of(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
        return F.floor(scaled).cast("long") + F.lit(OFFSET)

    return F.transform(embedding, of)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that can be used, all of one length.

    Null vectors and those with null or non-finite entries go, and so do empty ones and those of
    another length than most (of equally frequent lengths the larger counts).
    """

    def finite(c: Column) -> Column:
        c = c.cast("double")
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

    rows = embeddings.select("vec_id", "embedding")
    rows = rows.where((F.size("embedding") > 0) & F.forall("embedding", finite))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("embedding") == (most["d"] if most else 0))
    return rows.select("vec_id", whole_numbers(F.col("embedding")).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Centre:
    """Number of vectors and their exact sums; what is subtracted from each vector."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    @property
    def is_short(self) -> bool:
        """Whether sums of squares of n * x - sum fit 64 bits for all vectors."""
        reach = (
            max(self.n * h - s, s - self.n * w)
            for s, w, h in zip(self.sums, self.low, self.high, strict=True)
        )
        return sum(r * r for r in reach) < 1 << 62

    def _parts(self) -> tuple[np.ndarray, np.ndarray]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sum / n; whole numbers are subtracted first, so nothing cancels."""
        whole, rest = self._parts()
        return (x - whole) - rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - sum)^2, exactly; null where 64 bits can't hold it."""
        whole, rest = self._parts()
        if self.is_short:
            far = self.n * (x - whole) - rest
            return pa.array((far * far).sum(axis=1), pa.int64())
        far = self.n * (x - whole).astype(object) - rest.astype(object)
        found = [int(v) for v in (far * far).sum(axis=1)]
        return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def centre_of(fit: DataFrame) -> Centre:
    """The centre of the vectors `x`: a row per dimension comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                columns = [x.sum(axis=0), x.min(axis=0), x.max(axis=0)]
                yield pa.record_batch(
                    [pa.array([batch.num_rows], pa.int64()), *[pa.array([c], pa.list_(pa.int64())) for c in columns]],
                    ["n", "sums", "low", "high"],
                )

    parts = fit.mapInArrow(add, "n long, sums array<long>, low array<long>, high array<long>")
    each = parts.select("n", F.posexplode(F.arrays_zip("sums", "low", "high")).alias("d", "of"))
    rows = each.groupBy("d").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("of.sums").cast("decimal(38,0)")).alias("sum"),
        F.min("of.low").alias("low"),
        F.max("of.high").alias("high"),
    )
    found = rows.orderBy("d").collect()
    if not found:
        return Centre(0, (), (), ())
    return Centre(found[0]["n"], *(tuple(int(r[c]) for r in found) for c in ("sum", "low", "high")))


def _products(fit: DataFrame, centre: Centre, weights: np.ndarray | None = None) -> np.ndarray:
    """The sum of y y' over the centred vectors y, or over their images under `weights`, in a
    matrix with one more row and column for the sum of y itself."""
    shared = fit.sparkSession.sparkContext.broadcast((centre, weights))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, weights = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centre.centred(_matrix(batch))
                y = np.column_stack([y if weights is None else y @ weights, np.ones(len(y))])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            size = len(total)
            part = TaskContext.get().partitionId()
            yield pa.record_batch(
                [pa.array(np.full(size, part), pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(total))],
                ["part", "row", "sums"],
            )

    def add(table: pa.Table) -> pa.Table:
        # In the order of the parts, so that the same table gives the same sums.
        table = table.sort_by("part")
        rows = np.array(table["sums"].to_pylist())
        return pa.table({"row": table["row"][:1], "sums": pa.array([rows.sum(axis=0)])})

    parts = fit.mapInArrow(multiply, "part int, row int, sums array<double>")
    rows = parts.groupBy("row").applyInArrow(add, "row int, sums array<double>").orderBy("row").collect()
    shared.unpersist()
    return np.array([row["sums"] for row in rows])


def _covariance(products: np.ndarray, n: int) -> np.ndarray:
    mean = products[-1, :-1] / n
    found = products[:-1, :-1] / n - np.outer(mean, mean)
    return (found + found.T) / 2


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the components are the columns of `components`."""

    centre: Centre
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of `x`.

    Components whose eigenvalue is rounding noise next to the largest are left out, so there
    may be fewer than asked for, and none if all vectors are equal or there are none.
    """
    spark = x.sparkSession
    with Scratch(spark, "whitening") as scratch:
        distinct = scratch.table(x.select("x").distinct())
        centre = centre_of(distinct)
        covariance = _covariance(_products(distinct, centre), centre.n) if centre.n else np.zeros((0, 0))
        values, vectors = largest_pairs(spark, covariance, components)
        if not len(values):
            return Whitening(centre, values, vectors, values, 0.0)
        products = _products(distinct, centre, vectors / np.sqrt(values))
        error = np.abs(_covariance(products, centre.n) - np.eye(len(values))).max()
    return Whitening(centre, values, vectors, values / np.trace(covariance), float(error))


def whitened(x: DataFrame, found: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    vector and component, components numbered from 1."""
    shared = x.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType(
        [
            x.schema["vec_id"],
            *T.StructType.fromDDL("component int, deviation long, whitened double, explained double"),
        ]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        k = len(found.values)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                [
                    batch["vec_id"].take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    found.centre.deviation(x).take(row),
                    pa.array((found.centre.centred(x) @ found.weights).ravel()),
                    pa.array(np.tile(found.explained, len(x))),
                ],
                schema.names,
            )

    rows = x.mapInArrow(project, schema)
    return rows.select(
        "vec_id",
        "component",
        F.lit(found.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(found.identity_error).alias("identity_error"),
    )


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of `embeddings` whitened, see `vectors`, `fit` and `whitened`.

    Null and repeated vec_ids are rows like any other. Entries beyond LARGEST / SCALE are cut
    off there. Further columns are ignored. An empty table gives no rows.
    """
    x = vectors(embeddings)
    return whitened(x, fit(x, components))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
