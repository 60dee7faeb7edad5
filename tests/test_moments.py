import math
import random

import numpy as np
import pytest

from pagemart.operators.distributions import correlation_matrix
from pagemart.plans import moments

SCHEMA = "a double, b double, c int, d double"


def rows_of(count, seed=1, offset=0.0):
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        a = draw.gauss(0, 1)
        values = [a + offset, 2 * a + draw.gauss(0, 1) + offset, draw.randrange(5), 7.25]
        rows.append(tuple(None if draw.random() < 0.2 else v for v in values))
    return rows


def brute_force(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    x, y = np.array(both).T
    return np.corrcoef(x, y)[0, 1]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_equals_a_direct_correlation(spark, offset):
    rows = rows_of(400, offset=offset)
    found = {(r["x"], r["y"]): r["r"] for r in correlation_matrix(spark.createDataFrame(rows, SCHEMA), list("abcd")).collect()}
    assert len(found) == 16
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            assert found[x, y] == pytest.approx(brute_force(rows, i, j), abs=1e-6)
    # A constant column has no r, not even with itself.
    assert all(found["d", y] is None and found[y, "d"] is None for y in "abcd")


def test_parts_merge_to_the_whole(spark):
    rows = rows_of(300, 2)
    columns, shifts = ["a", "b", "c"], [0.5, -0.5, 2.0]
    parts = [
        moments.pattern_sums(spark.createDataFrame(rows[a:b], SCHEMA), columns, shifts)
        for a, b in ((0, 100), (100, 120), (120, 300))
    ]
    merged = moments.merged_sums(*parts).collect()
    whole = moments.pattern_sums(spark.createDataFrame(rows, SCHEMA), columns, shifts).collect()
    for i, j in ((0, 0), (0, 1), (1, 2)):
        one, two = moments.pair_moments(merged, shifts, i, j), moments.pair_moments(whole, shifts, i, j)
        assert one.n == two.n and one.r == pytest.approx(two.r, abs=1e-12)
        assert one.mean_x == pytest.approx(two.mean_x) and one.spread_y == pytest.approx(two.spread_y)


def test_columns_without_values(spark):
    rows = [(1.0, None, 1, None), (2.0, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {(r["x"], r["y"]): r["r"] for r in correlation_matrix(frame, ["a", "b", "c", "absent"]).collect()}
    assert found == {("a", "a"): pytest.approx(1.0), ("a", "c"): None, ("c", "a"): None, ("c", "c"): None}
    assert correlation_matrix(frame, ["a", "b"]).collect() == []
    assert correlation_matrix(frame, ["absent"]).collect() == []
    assert correlation_matrix(frame.limit(0), ["a", "c"]).collect() == []
    assert math.isnan(moments.pair_moments([], [0.0], 0, 0).mean_x)
