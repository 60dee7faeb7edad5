"""Largest eigenpairs of a symmetric matrix by contour integration.

Inertia counts tell how many eigenvalues lie above any shift, so intervals with a known number
of eigenvalues are laid out first, with their edges in gaps. On each interval the projector onto
its eigenvectors is a contour integral of the resolvent around it; a quadrature of complex
shifted solves applies it to a set of vectors, Rayleigh-Ritz extracts pairs from the span, and
this repeats until the residuals are at rounding level. The solves of all intervals and nodes
are independent: they are the rows of a Spark job, one job per round. At the end the number of
pairs found in every interval must be that of the inertia counts.

The matrix is as wide as the vectors it came from, whatever their number; WIDEST bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a matrix at most: 128 MB go to every task.
WIDEST = 4096
#: Nodes on the upper half of a contour; the lower half is its mirror image.
NODES = 8
#: Eigenvalues of an interval, unless they lie too close to be parted.
PER_INTERVAL = 8
#: How far from the next eigenvalue an edge should be, as a share of half the interval.
ROOM = 0.15
ROUNDS = 40
EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = matrix.astype(float)
    size = len(a)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, v[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Counts of eigenvalues above shifts."""

    def __init__(self, matrix: np.ndarray):
        self.diagonal, self.beside = tridiagonal(matrix)
        reach = np.abs(np.concatenate([self.beside, [0]])) + np.abs(np.concatenate([[0], self.beside]))
        #: No eigenvalue is larger in size.
        self.norm = float(np.max(np.abs(self.diagonal) + reach, initial=0.0))
        self.tiny = max(self.norm * EPS * EPS, np.finfo(float).tiny)

    def above(self, shifts: np.ndarray) -> np.ndarray:
        """How many eigenvalues are larger than each shift: the positive pivots of T - shift."""
        shifts = np.asarray(shifts, float)
        count = np.zeros(shifts.shape, np.int64)
        pivot = np.ones_like(shifts)
        for i, d in enumerate(self.diagonal):
            coupling = self.beside[i - 1] ** 2 if i else 0.0
            pivot = d - shifts - coupling / pivot
            pivot = np.where(np.abs(pivot) < self.tiny, -self.tiny, pivot)
            count += pivot > 0
        return count

    def largest(self, count: int, digits: float = 1e-13) -> np.ndarray:
        """The largest eigenvalues, falling, each to within `digits` times the norm."""
        wanted = np.arange(1, count + 1)
        low = np.full(count, -self.norm * (1 + 4 * EPS))
        high = np.full(count, self.norm * (1 + 4 * EPS))
        while np.any(high - low > digits * self.norm):
            middle = (low + high) / 2
            higher = self.above(middle) >= wanted
            low, high = np.where(higher, middle, low), np.where(higher, high, middle)
        return (low + high) / 2


@dataclass(frozen=True)
class Interval:
    low: float
    high: float
    count: int


def intervals(inertia: Inertia, wanted: int, floor: float) -> list[Interval]:
    """Intervals that hold the `wanted` largest eigenvalues above `floor`, and those that can't
    be told from the last of them; edges stand in the middle of gaps."""
    size = len(inertia.diagonal)
    total = int(inertia.above(np.array([floor]))[0])
    if not total:
        return []
    known = inertia.largest(min(size, 2 * wanted + PER_INTERVAL))
    near = 1e-11 * inertia.norm
    values = known[: min(total, len(known))]
    gaps = values[:-1] - values[1:]
    last = min(wanted, len(values))
    while last < len(values) and gaps[last - 1] <= near:
        last += 1
    if last == len(values) < total:  # a cluster beyond what was looked at
        return intervals(inertia, 2 * len(values), floor)
    after = max(floor, float(known[last])) if last < len(known) else floor
    below = np.append(values[1:last], after)
    parts = (values[:last] - below) / 2  # from an eigenvalue to the edge below it
    edges = [inertia.norm * (1 + 8 * EPS)]
    begin = 0
    while begin < last:
        # The longest interval whose edge is far from eigenvalues, as its own width goes; of
        # those with a near edge the best. Clusters stay whole.
        ends = np.array([e for e in range(begin + 1, last + 1) if e == last or gaps[e - 1] > near])
        ends = ends[: max(1, int((ends <= begin + PER_INTERVAL).sum()))]
        lows = values[ends - 1] - parts[ends - 1]
        room = np.minimum(2 * parts[ends - 1] / (edges[-1] - lows), ROOM)
        end = int(ends[np.flatnonzero(room == room.max())[-1]])
        edges.append(float(values[end - 1] - parts[end - 1]))
        begin = end
    counts = inertia.above(np.array(edges))
    return [
        Interval(edges[i + 1], edges[i], int(counts[i + 1] - counts[i])) for i in range(len(edges) - 1)
    ]


def ritz(matrix: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values (falling) and vectors of the span."""
    basis, _ = np.linalg.qr(span)
    small = basis.T @ (matrix @ basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ vectors)[:, ::-1]


def shifted_solve(matrix: np.ndarray, interval: Interval, node: int, span: np.ndarray) -> np.ndarray:
    """The share of one quadrature node in the projection of the span."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2
    turn = np.exp(0.5j * np.pi * (1 + points[node]))
    shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
    solved = np.linalg.solve(shifted, span.astype(complex))
    return (0.5 * radius * weights[node]) * (turn * solved).real


def _projected(spark: SparkSession, matrix, todo: dict[int, Interval], spans: dict[int, np.ndarray]):
    """The projected spans; each (interval, node) is solved by a task."""
    shared = spark.sparkContext.broadcast((matrix.value, todo, spans))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, todo, spans = shared.value
        for batch in batches:
            for number, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = shifted_solve(whole, todo[number], node, spans[number])
                yield pa.record_batch(
                    [pa.array([number], pa.int32()), pa.array([node], pa.int32()), pa.array([part.tobytes()])],
                    ["number", "node", "part"],
                )

    pairs = [(number, node) for number in todo for node in range(NODES)]
    asked = spark.createDataFrame(pairs, "number int, node int").repartition(len(pairs), "number", "node")
    found: dict[int, np.ndarray] = {number: np.zeros_like(spans[number]) for number in todo}
    for row in asked.mapInArrow(solve, "number int, node int, part binary").sort("number", "node").collect():
        number = row["number"]
        found[number] += np.frombuffer(row["part"]).reshape(found[number].shape)
    shared.unpersist()
    return found


def largest_pairs(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) that stand out from 0, `wanted` at most, and their unit
    vectors as columns, the largest entry of each positive.

    Of equal eigenvalues across the border some vectors of their common space are taken. A matrix
    of zeros, or without rows, has no pairs.
    """
    size = len(matrix)
    if size > WIDEST:
        raise ValueError(f"a matrix of {size} rows; {WIDEST} is the widest")
    inertia = Inertia(matrix)
    plan = intervals(inertia, wanted, 8 * size * EPS * inertia.norm) if size and inertia.norm else []
    if not plan:
        return np.zeros(0), np.zeros((size, 0))
    draw = np.random.Generator(np.random.PCG64(20240602))
    spans = {
        number: draw.standard_normal((size, min(size, interval.count + interval.count // 2 + 4)))
        for number, interval in enumerate(plan)
    }
    shared = spark.sparkContext.broadcast(matrix)
    todo = dict(enumerate(plan))
    pairs: dict[int, np.ndarray] = {}
    residual = dict.fromkeys(todo, np.inf)
    for _ in range(ROUNDS):
        for number, span in _projected(spark, shared, todo, spans).items():
            interval = todo[number]
            values, vectors = ritz(matrix, span)
            spans[number] = vectors
            inside = np.flatnonzero((values > interval.low) & (values <= interval.high))
            rest = matrix @ vectors[:, inside] - vectors[:, inside] * values[inside]
            far = np.linalg.norm(rest, axis=0)
            if len(inside) < interval.count:
                continue
            # A span with room for more has mixtures of vectors from both sides as well; those
            # are no pairs, and their residuals stay large.
            inside = inside[np.sort(np.argsort(far)[: interval.count])]
            now = float(np.sort(far)[: interval.count].max())
            # Done at rounding level, or when a round near it brings no more.
            good = now <= 4 * size * EPS * inertia.norm
            if good and (now <= EPS * inertia.norm or now > residual[number] / 4):
                pairs[number] = vectors[:, inside]
            residual[number] = now
        todo = {number: interval for number, interval in todo.items() if number not in pairs}
        if not todo:
            break
    shared.unpersist()
    if todo:
        raise ArithmeticError(f"eigenvalues not found in {sorted(todo)} of {plan}")
    values, vectors = ritz(matrix, np.concatenate([pairs[n] for n in range(len(plan))], axis=1))
    values, vectors = values[:wanted], vectors[:, :wanted]
    tops = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(values))]
    return values, vectors * np.where(tops < 0, -1.0, 1.0)
