import math

import pytest
from pyspark.sql import functions as F

from pagemart.llm import mixing

from .conftest import rows_of

SIZES = {"big": 900_000, "middle": 90_000, "small": 9_000, None: 1_000}


def weights(spark, **options):
    frame = spark.createDataFrame(list(SIZES.items()) + [("empty", 0)], "source string, tokens long")
    return {r["source"]: r for r in mixing.source_weights(frame, **options).collect()}


def entropy(values):
    return -sum(v * math.log(v) for v in values if v)


def test_target_entropy_is_met(spark):
    found = weights(spark, target_entropy=0.7, max_passes=1e9)
    assert set(found) == set(SIZES)
    shares = [r["weight"] for r in found.values()]
    assert sum(shares) == pytest.approx(1)
    assert entropy(shares) == pytest.approx(0.7 * math.log(4), abs=1e-9)
    x = found["big"]["exponent"]
    powers = {s: (n / 1_000_000) ** x for s, n in SIZES.items()}
    for source, row in found.items():
        assert row["weight"] == pytest.approx(powers[source] / sum(powers.values()))
        assert row["target"] == pytest.approx(row["weight"] * 1_000_000)


def test_repetition_limit_comes_first(spark):
    found = weights(spark, target_entropy=1.0, max_passes=4.0)
    passes = [r["target"] / r["tokens"] for r in found.values()]
    assert max(passes) == pytest.approx(4.0) and max(passes) <= 4.0 + 1e-9
    assert entropy([r["weight"] for r in found.values()]) < math.log(4)


def test_natural_shares_when_they_do(spark):
    found = weights(spark, target_entropy=0.1, max_passes=4.0)
    assert found["big"]["exponent"] == 1.0
    assert found["big"]["weight"] == pytest.approx(0.9)
    halved = weights(spark, target_entropy=0.1, budget=500_000)
    assert halved["big"]["target"] == pytest.approx(450_000)
    capped = weights(spark, target_entropy=0.1, max_passes=2.0, budget=10**9)
    assert capped["big"]["target"] == pytest.approx(1_800_000)


def corpus(spark):
    rows = [(i, "w " * (20 + i % 30), "hot" if i % 3 else "abcd"[i % 4]) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sources_deliver_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 900)
    docs = corpus(spark)
    rows = mixing.mix(docs, target_entropy=0.99).collect()
    tokens = {}
    for doc in docs.collect():
        tokens[doc["source"]] = tokens.get(doc["source"], 0) + len(doc["text"].split())
    budget = sum(tokens.values())
    taken, counts, weight = {}, {}, {}
    for row in rows:
        source = row["source"]
        taken[source] = taken.get(source, 0) + row["n_words"]
        counts.setdefault((source, row["pass"]), []).append(row["doc_id"])
        weight[source] = row["weight"]
        assert 0 <= row["position"] < 1
    for source, total in tokens.items():
        target = weight[source] * budget
        assert target <= taken[source] < target + 50
        whole = int(target // total)
        for number in range(whole):
            ids = counts[source, number]
            assert len(ids) == len(set(ids)), "a pass takes each document once"
            assert len(ids) == sum(d["source"] == source for d in docs.collect())
    # Sorted by position, every stretch has the sources by weight.
    ordered = sorted(rows, key=lambda r: r["position"])
    half = ordered[: len(ordered) // 2]
    share = sum(r["n_words"] for r in half if r["source"] == "hot") / sum(r["n_words"] for r in half)
    assert share == pytest.approx(weight["hot"], abs=0.03)
    # The passes of a source are in different orders.
    first = [r["doc_id"] for r in ordered if r["source"] == "a" and r["pass"] == 0]
    second = [r["doc_id"] for r in ordered if r["source"] == "a" and r["pass"] == 1]
    assert second and first[: len(second)] != second


def test_mixed_documents_have_the_rows(documents, clashing, no_documents):
    found = mixing.mixed_documents(documents)
    assert found.columns == documents.columns
    taken = mixing.mix(documents)
    assert found.count() == taken.count() > 0
    assert rows_of(found.select("doc_id", "source")) == rows_of(taken.select("doc_id", "source"))
    assert {r["source"] for r in taken.collect()} <= {"a", "b", "c", "abc", None}
    columns = ["doc_id", "source", "n_words", "pass", "nth", F.round("position", 6)]
    assert rows_of(mixing.mix(clashing).select(columns)) == rows_of(taken.select(columns))
    assert mixing.mix(no_documents).count() == 0
    wordless = documents.where("doc_id IN (3, 4, 5)")
    assert mixing.mix(wordless).count() == 0


def test_plan_has_no_python(documents):
    plan = mixing.mixed_documents(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
