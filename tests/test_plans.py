import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemart import session
from pagemart.plans import lookup
from pagemart.plans.order_statistics import exact_percentiles
from pagemart.plans.serial_ids import with_serial_ids
from pagemart.sources.files import Scratch, numbered_folders


def interpolated(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_narrowed_percentiles_are_exact(spark, bins):
    draw = random.Random(3)
    data = {
        "spread": [draw.uniform(-5, 5) for _ in range(300)],
        "one value": [2.5] * 40,
        "two values": [1.0] * 3 + [9.0] * 3,
        "far outliers": [draw.uniform(0, 1) for _ in range(60)] + [1e12, -1e12, 1e300, -1e308],
        "hot value": [7.0] * 200 + [draw.uniform(0, 14) for _ in range(100)],
        "single": [4.0],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("spread", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_percentiles(frame, "v", probabilities, ["k"], small_group=0, bins=bins)
    found = {r["k"]: list(r)[1:] for r in got.collect()}
    assert set(found) == set(data)
    for key, values in data.items():
        assert found[key] == pytest.approx([interpolated(values, p) for p in probabilities])
    built_in = exact_percentiles(frame, "v", probabilities, ["k"])
    assert {r["k"]: list(r)[1:] for r in built_in.collect()}["spread"] == pytest.approx(found["spread"])


def test_percentiles_beyond_the_finite_values(spark):
    """Infinite values and NaN: both ways agree, and the rounds end."""
    inf, nan = float("inf"), float("nan")
    finite = [i / 4 for i in range(50)]
    data = {
        "high": [*finite, inf],
        "nan": [*finite, nan],
        "all": [-inf, -inf, *finite, inf, nan, nan],
        "half": [-inf] * 50 + finite,
        "none": [-inf, inf, nan],
        "only nan": [nan, nan],
        "tiny": [5e-324, 1e-323, 1.5e-323, 2e-323],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probabilities = [0.0, 0.3, 0.5, 0.51, 0.99, 1.0]
    for bins in (2, 4096):
        got = exact_percentiles(frame, "v", probabilities, ["k"], small_group=0, bins=bins)
        want = exact_percentiles(frame, "v", probabilities, ["k"])
        got, want = ({r["k"]: list(r)[1:] for r in f.collect()} for f in (got, want))
        assert got.keys() == want.keys() == data.keys()
        for key in data:
            assert got[key] == pytest.approx(want[key], nan_ok=True), key


def test_percentiles_without_groups(spark):
    frame = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    got = exact_percentiles(frame, "v", [0.5, 0.1], small_group=0, names=["m", "t"]).first()
    assert got["m"] == statistics.median(range(1, 1001)) and got["t"] == pytest.approx(100.9)
    assert exact_percentiles(frame.where("false"), "v", [0.5]).first()["p0"] is None


def test_percentiles_with_many_groups_are_checkpointed(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_ROWS", 1)
    monkeypatch.setattr(lookup.small_rows, "__defaults__", (1,))
    frame = spark.range(400).select((F.col("id") % 5).alias("k"), F.col("id").cast("double").alias("v"))
    got = exact_percentiles(frame, "v", [0.5], ["k"], small_group=0, bins=16).orderBy("k")
    assert [r["p0"] for r in got.collect()] == [197.5, 198.5, 199.5, 200.5, 201.5]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_rows", [0, 2, 20_000])
def test_lookup_join_ways_agree(spark, how, max_rows):
    """A third of the rows share a key, another third has none; every way gives one result."""
    left = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3), ("k7", 4)], "key string, v int")
    got = lookup.lookup_join(left, right, "key", how, max_rows=max_rows, sample=1.0)
    want = left.join(right, "key", how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_hot_keys_are_found(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key")
    )
    assert lookup.hot_keys(frame, "key", fraction=1.0) == ["hot"]


def test_first_per_key_reduces_before_the_shuffle(spark):
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "z")], "k string, n int, t string")
    first = lookup.first_per_key(frame, "k", [F.col("n")])
    assert sorted(map(repr, first.collect())) == sorted(
        map(repr, frame.where("t <> 'x' OR t IS NULL").collect())
    )
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_serial_ids_follow_the_order(spark):
    frame = spark.range(500).select((F.lit(1000) - F.col("id")).alias("n")).repartition(7)
    with Scratch(spark) as scratch:
        numbered, total = with_serial_ids(frame, 40, [F.col("n")], scratch)
        rows = [tuple(r) for r in numbered.orderBy("id").select("id", "n").collect()]
    assert total == 500
    assert rows == [(41 + i, 501 + i) for i in range(500)]


def test_scratch_is_cleared(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("once-*"))
    with Scratch(spark, "once") as scratch:
        assert scratch.table(spark.range(5)).count() == 5
        assert set(shared.glob("once-*")) - before
    assert set(shared.glob("once-*")) == before
    for number in (3, 11):
        spark.range(1).write.parquet(f"{tmp_path}/v={number}")
    (tmp_path / "v=12").mkdir()
    assert numbered_folders(spark, str(tmp_path), "v=") == [3, 11]
    assert numbered_folders(spark, f"{tmp_path}/missing", "v=") == []


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_measured_sides_count_bytes(spark, monkeypatch):
    frame = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert lookup.is_small(frame) and lookup.held_if_small(frame).count() == 10
    monkeypatch.setattr(lookup, "SMALL_BYTES", 5000)
    assert not lookup.is_small(frame) and lookup.held_if_small(frame) is None
    assert not lookup.is_small(frame.limit(1), 0)
