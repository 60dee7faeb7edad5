import math

import numpy as np
import pytest

from pagemart.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<double>"


def spectrum(values, seed=0):
    draw = np.random.default_rng(seed)
    basis, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    return basis @ np.diag(np.array(values, float)) @ basis.T


SPECTRA = {
    "spread": list(range(1, 41)),
    "ties within": [9, 9, 9, 8, 8, 7, 7, 7, *[1] * 20],
    "ties at the border": [9, *[5] * 12, 4, 3],
    "all equal": [2] * 20,
    "low rank": [7, 3, 1, *[0] * 30],
    "close": [1 + i * 1e-4 for i in range(40)],
    "wide range": [10.0 ** (-i / 2) for i in range(20)],
    "one": [4],
    "negative": [-5, -4, 3, 2, 1, -1],
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("wanted", [3, 16])
def test_pairs_are_the_largest(spark, name, wanted):
    matrix = spectrum(SPECTRA[name], len(name))
    matrix = (matrix + matrix.T) / 2
    values, vectors = feast.largest_pairs(spark, matrix, wanted)
    expected = np.linalg.eigvalsh(matrix)[::-1]
    norm = np.abs(expected).max()
    expected = expected[expected > 1e-12 * norm][:wanted]
    size = len(matrix)
    assert len(values) == pytest.approx(len(expected), abs=0)
    assert np.allclose(values, expected[: len(values)], rtol=0, atol=1e-14 * norm * size)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-14 * norm * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14 * size


def test_no_pairs_of_zeros(spark):
    assert len(feast.largest_pairs(spark, np.zeros((5, 5)), 3)[0]) == 0
    assert len(feast.largest_pairs(spark, np.zeros((0, 0)), 3)[0]) == 0


def test_inertia_counts():
    matrix = spectrum([3, 3, 2, 0.5, 0, -1, -4])
    inertia = feast.Inertia(matrix)
    assert inertia.above(np.array([4, 2.5, 1, 0.1, -0.1, -2, -5])).tolist() == [0, 2, 3, 4, 5, 6, 7]
    assert np.allclose(inertia.largest(4), [3, 3, 2, 0.5], atol=1e-7)


def usable(rows):
    return [
        (i, v) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)
    ]


def brute_force(rows, components=16):
    """(vec_id, component, n, deviation, |whitened|, explained), by whole numbers and eigh."""
    whole = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in usable(rows)]
    distinct = sorted({x for _, x in whole})
    n = len(distinct)
    sums = [sum(column) for column in zip(*distinct, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in distinct])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = []
    for i, x in whole:
        far = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(min(components, int((values > 1e-12 * values[0]).sum()))):
            y = np.array(far) / n @ vectors[:, c] / math.sqrt(values[c])
            found.append((i, c + 1, n, sum(f * f for f in far), abs(y), values[c] / values.sum()))
    return found


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[4]))


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whiten(frame, **options).collect()
    got = by_key((r[0], r[1], r[2], r[3], abs(r[4]), r[5], r[6]) for r in got)
    expected = by_key(brute_force(rows, **options))
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[4] == pytest.approx(b[4], abs=1e-8)
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] < 1e-9
    assert len({r[6] for r in got}) <= 1
    return got


def vectors(count, seed=1, scale=1.0):
    draw = np.random.default_rng(seed)
    mixed = draw.standard_normal((count, 6)) @ draw.standard_normal((6, 6)) * scale
    return [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]


def test_equals_eigh(spark):
    check(spark, vectors(300))
    check(spark, vectors(300), components=2)


def test_copies_are_fitted_once_and_all_returned(spark):
    rows = vectors(40)
    rows += [(100 + i, rows[i % 3][1]) for i in range(90)] + rows[:5]
    got = check(spark, rows)
    assert {r[2] for r in got} == {40}


def test_awkward_rows(spark):
    rows = vectors(50)
    bad = [None, [], [1.0] * 5, [None] + [1.0] * 5, [float("nan")] + [0.0] * 5, [float("inf")] * 6]
    rows += [(200 + i, v) for i, v in enumerate(bad)]
    rows += [(None, [0.5, -0.5, 0.25, 3.0, -2.0, 1.0]), (0, [1e4, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = check(spark, rows)
    assert not {200 + i for i in range(len(bad))} & {r[0] for r in got}


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i % 7), float(i % 5), 0.0, 0.0, 1.0, 1.0]) for i in range(35)]
    assert {r[1] for r in check(spark, rows)} == {1, 2}


def test_equal_or_no_vectors_give_no_rows(spark):
    for rows in ([], [(1, None)], [(i, [1.0, 2.0]) for i in range(4)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_entries_are_exact_or_null(spark):
    rows = vectors(30, scale=1e6)
    frame = spark.createDataFrame([*rows, (99, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0])], SCHEMA)
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame).collect()}
    assert set(found) == {*range(30), 99} and found[99] is None
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    centre = whitening.Centre(30, tuple(sums), tuple(map(min, zip(*x))), tuple(map(max, zip(*x))))
    assert not centre.is_short or centre.deviation(np.array(x))[0].as_py()


def test_other_columns_and_float_entries(spark):
    rows = [(i, v, "x", 1, 2) for i, v in vectors(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int, component int")
    plain = [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows]
    got = by_key((*r[:4], abs(r[4]), *r[5:]) for r in whitening.whiten(frame).collect())
    assert [r[:4] for r in got] == [r[:4] for r in by_key(brute_force(plain))]
