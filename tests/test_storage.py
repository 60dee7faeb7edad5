import re

import pytest
from pyspark.sql import functions as F

from pagemart.operators.load import plan_load
from pagemart.sources import clustered
from pagemart.sources.books import BooksTable


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def scanned_rows(frame):
    """Rows that came out of the scans of a frame, by their metrics."""
    frame.collect()
    found, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if name.endswith("QueryStage"):
            todo.append(node.plan())
    return found


@pytest.fixture()
def books(spark):
    return spark.range(40_000).select(
        F.col("id"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("price"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))).alias("category"),
        F.timestamp_micros(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10**15))).cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), F.xxhash64("id", F.lit(3)))).alias("upc"),
    )


@pytest.fixture()
def copy(spark, books, tmp_path):
    path = str(tmp_path / "clustered")
    clustered.write_clustered(books, path, ["price", "category", "created_at"], ["upc"], 32)
    return clustered.read_clustered(spark, path, books.schema)


def test_the_copy_has_all_rows(books, copy):
    assert sorted(map(repr, copy.collect())) == sorted(map(repr, books.collect()))


@pytest.fixture()
def skipping(spark, copy, books):
    path = copy.inputFiles()[0].rsplit("/", 1)[0]
    return lambda **within: clustered.read_clustered(spark, path, books.schema, within)


@pytest.mark.parametrize(
    ("column", "low", "high"),
    [("price", 20.0, 25.0), ("category", "c7", "c7"), ("created_at", None, "1971-06-01 00:00:00")],
)
def test_ranges_in_each_column_skip_most_of_the_copy(books, skipping, column, low, high):
    found = skipping(**{column: (low, high)})
    wanted = F.lit(True)
    if low is not None:
        wanted = wanted & (F.col(column) >= F.lit(low).cast(books.schema[column].dataType))
    wanted = wanted & (F.col(column) <= F.lit(high).cast(books.schema[column].dataType))
    assert found.columns == books.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, books.where(wanted).collect()))
    assert found.count() and scanned_rows(found) < 0.6 * books.count()


def test_ranges_in_two_columns_skip_more(books, copy):
    found = copy.where("price BETWEEN 20 AND 25 AND category = 'c7'")
    assert scanned_rows(found) < 0.35 * books.count()


def test_a_key_is_found_through_its_filter(books, copy):
    upc = books.where("id = 1000").first()["upc"]
    found = copy.where(F.col("upc") == upc)
    assert [r["id"] for r in found.collect()] == [1000]
    # About one row group of 32 holds the key, and a filter is wrong at times.
    assert scanned_rows(found) < 0.2 * books.count()
    assert scanned_rows(copy.where(F.col("upc") == "nowhere")) < 0.2 * books.count()


def test_interleaved_bits(spark):
    found = spark.range(64).select(
        clustered.interleaved([F.shiftright("id", 3), F.col("id").bitwiseAND(F.lit(7))], 3).alias("key"), "id"
    )
    for row in found.collect():
        x, y = row["id"] >> 3, row["id"] & 7
        assert row["key"] == int("".join(f"{x:03b}"[i] + f"{y:03b}"[i] for i in range(3)), 2)


def test_nulls_texts_and_constant_columns(spark, tmp_path):
    rows = [(None, None, "é" * i, 1.0) for i in range(9)] + [(float("nan"), "x", None, 1.0)] * 3
    frame = spark.createDataFrame(rows, "a double, b string, c string, d double")
    path = str(tmp_path / "odd")
    clustered.write_clustered(frame, path, ["a", "b", "c", "d"], ["c"], 3)
    assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, frame.collect()))
    clustered.write_clustered(frame.limit(0), path, ["a", "b"], ["c"], 3)
    assert spark.read.schema(frame.schema).parquet(path).count() == 0


def test_a_load_does_not_shuffle_a_bucketed_table(spark, tmp_path):
    table = BooksTable(spark, "books_in_buckets", str(tmp_path / "books"), buckets=4)
    table.create()
    record = [F.concat(F.lit("t"), "id").alias("title"), F.lit(1.0).alias("price")]
    keyed = spark.range(500).select(F.concat(F.lit("u"), "id").alias("upc"), *record)
    without = spark.range(300).select(F.lit(None).cast("string").alias("upc"), *record)
    first = table.load(keyed.unionByName(without))
    assert (first.inserted, first.skipped, first.rejected) == (800, 0, 0)
    again = table.load(keyed.unionByName(without))
    assert (again.inserted, again.skipped) == (300, 500)
    assert table.read().count() == 1100
    plain = BooksTable(spark, "books_plain", str(tmp_path / "plain"))
    plain.create()
    plain.load(keyed.unionByName(without))

    batch = spark.range(400, 900).select(F.concat(F.lit("u"), "id").alias("upc"), *record)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {}
        for target in (table, plain):
            accepted = plan_load(batch, target.read()).accepted
            assert accepted.count() == 400
            plans[target] = final_plan(accepted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def exchange_over_scan(text):
        """Exchanges between the join and the scan of the table."""
        lines = text.split("== Initial Plan ==")[0].splitlines()
        scan = next(i for i, line in enumerate(lines) if "books_" in line and "FileScan" in line)
        join = max(i for i, line in enumerate(lines[:scan]) if "LeftAnti" in line)
        depth = [len(re.match(r"[\s:+|-]*", line)[0]) for line in lines]
        return sum("Exchange" in lines[i] for i in range(join, scan) if depth[i] > depth[join] and ":" not in lines[i][: depth[join] + 2].replace(lines[join][: depth[join]], ""))

    assert "Bucketed: true" in plans[table]
    assert exchange_over_scan(plans[plain]) >= 1
    assert exchange_over_scan(plans[table]) == 0
    table.drop(confirm=True)
    plain.drop(confirm=True)


def test_keys_of_a_table_are_not_broadcast_by_its_estimated_size(spark, tmp_path):
    """One column of a table whose other columns are null is estimated far below its size."""
    for buckets in (None, 4):
        table = BooksTable(spark, f"books_estimated_{buckets}", str(tmp_path / f"b{buckets}"), buckets=buckets)
        table.create()
        record = [F.concat(F.lit("t"), "id").alias("title"), F.lit(1.0).alias("price")]
        table.load(spark.range(500).select(F.concat(F.lit("u"), "id").alias("upc"), *record))
        batch = spark.range(400, 900).select(F.concat(F.lit("u"), "id").alias("upc"), *record)
        accepted = plan_load(batch, table.read()).accepted
        assert accepted.count() == 400
        assert "BroadcastHashJoin" not in final_plan(accepted)
        table.drop(confirm=True)


def test_files_of_a_copy_grow_in_number_and_not_in_size(spark, books, tmp_path):
    path = str(tmp_path / "many")
    clustered.write_clustered(books, path, ["price", "category"], ["upc"], 2, file_bytes=200_000)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    # About 50 bytes a row: 10 files; ranges are drawn from a sample.
    assert 8 <= len(files) <= 16 and max(r["count"] for r in files) < 9_000
    assert sorted(map(repr, clustered.read_clustered(spark, path, books.schema).collect())) == sorted(
        map(repr, books.collect())
    )
