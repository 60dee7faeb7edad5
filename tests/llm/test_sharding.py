import random

from pagemart.llm import sharding
from pagemart.llm.sharding import differencing, shard_documents

from .conftest import rows_of


def test_differencing_is_even_and_complete():
    draw = random.Random(5)
    sizes = [draw.randint(1, 10_000) for _ in range(800)]
    found = differencing(sizes, 8)
    sums = [0] * 8
    for size, shard in zip(sizes, found, strict=True):
        sums[shard] += size
    assert sum(sums) == sum(sizes)
    assert max(sums) - min(sums) <= 3


def test_differencing_of_few():
    assert differencing([], 8) == []
    assert sorted(differencing([5, 5, 5], 3)) == [0, 1, 2]
    assert len(set(differencing([8, 7, 6, 5, 4], 2))) == 2


def test_shards_and_slots(documents, awkward):
    found = shard_documents(documents).collect()
    assert len(found) == len(awkward)
    by_id = {}
    for row in found:
        by_id.setdefault(row["doc_id"], set()).add(row["shard"])
        assert row["law"] == "bytes" and row["grown_shard"] is None
    assert by_id[0] == by_id[2] and by_id[8] == by_id[9] and len(by_id[9]) == 1
    assert by_id[3] == by_id[4], "null and empty texts are one group"
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sizes = {r["doc_id"]: r["size"] for r in found}
    assert sizes[3] == 1 and sizes[7] == 30001 and sizes[12] == len(awkward[13][1].encode()) + 1


def test_other_columns_and_empty(clashing, documents, no_documents):
    assert rows_of(shard_documents(clashing)) == rows_of(shard_documents(documents))
    assert shard_documents(no_documents).count() == 0


def test_few_groups_are_not_bundled(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES", 1)
    sizes = [10_000_000] * 2 + [1000] * 300 + [None]
    rows = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    found = sharding.assign_shards(rows, "key", "size", 2).groupBy("shard").sum("size").collect()
    assert [r[1] for r in found] == [10_150_000] * 2
