import math
import random
import re
from collections import Counter

import pytest

from pagemart.llm import lexical
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_force(docs, items, top=10):
    """Scores of all documents for all items, by the formula."""
    texts = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    sizes = [sum(own.values()) for _, own in texts]
    total, in_all = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, own in texts for t in own)
    rows = []
    for item, text in set(items):
        wanted = set(TERM.findall((text or "").translate(SMALL)))
        found = []
        for (doc, own), n in zip(texts, sizes, strict=True):
            score = 0
            for t in wanted & set(own):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * total) // in_all
                score += w * ((1000000000 * own[t]) // (1000 * own[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        found.sort()
        rows += [(item, rank, f[3], -f[0]) for rank, f in enumerate(found[:top], 1)]
    return sorted(map(repr, rows))


def searched(spark, docs, items, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(repr(tuple(r)) for r in lexical.search(frame, asked, **options).collect())


def passages(texts, count, seed):
    draw = random.Random(seed)
    for number in range(count):
        words = texts[draw.randrange(len(texts))].split()
        start = draw.randrange(max(1, len(words) - 12))
        yield number, " ".join(words[start : start + 12])


@pytest.mark.parametrize("first", [1, 20, 4096])
def test_finds_what_a_full_scan_finds(spark, monkeypatch, first):
    monkeypatch.setattr(lexical, "FIRST", first)
    texts = [prose(s, 20 + 7 * s, 60 + 3 * s) for s in range(120)]
    docs = list(enumerate(texts)) + [(500 + i, t) for i, t in enumerate(texts[:15])]
    items = list(passages(texts, 30, 1))
    assert searched(spark, docs, items) == brute_force(docs, items)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    texts = [prose(s, 60, 80) for s in range(40)]
    docs, items = list(enumerate(texts)), list(passages(texts, 12, 2))
    monkeypatch.setattr(lexical, "ITEMS", 5)
    assert searched(spark, docs, items, top=3) == brute_force(docs, items, 3)


def test_awkward_rows(spark, awkward):
    docs = [(row[0], row[1]) for row in awkward]
    items = [
        (0, "one TWO"),
        (0, "one TWO"),
        (1, None),
        (2, ""),
        (3, "-- !?"),
        (4, "größe 日本語 unknownword"),
        (None, "a b c"),
        (5, "the"),
        (6, prose(1, 300)),
    ]
    assert searched(spark, docs, items) == brute_force(docs, items)


def test_ties_go_by_id_and_repeated_rows_are_documents(spark):
    docs = [(i % 13, "same words here") for i in range(26)] + [(99, "others altogether")] * 40
    items = [(1, "same")]
    assert searched(spark, docs, items) == brute_force(docs, items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_terms_in_every_document_weigh_nothing(spark):
    docs = [(i, "common") for i in range(2000)]
    assert lexical.weight(2000, 2000) == 0
    assert searched(spark, docs, [(1, "common")]) == []


def test_further_columns_are_ignored(spark, clashing, documents):
    items = spark.createDataFrame([(1, "a b c", 5)], "item_id long, text string, rank int")
    more = clashing.withColumnRenamed("words", "rank").withColumnRenamed("n", "score")
    found = lexical.search(more, items).collect()
    assert found == lexical.search(documents, items.drop("rank")).collect()
    assert found


def test_most_documents_of_a_bucket_are_not_scored():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    common = [[0, 1, int(t)] for t in draw.integers(3, 400, 2000)]
    common[7] = [0, 1, 2]
    values = [[40, 50, 900]] * 2000
    length = [math.sqrt(sum(v * v for v in row)) for row in values]
    batch = pa.record_batch(
        [pa.array(range(2000)), pa.array(length), pa.array(common, pa.list_(pa.int32())), pa.array(values)],
        ["doc_id", "length", "places", "impacts"],
    )
    bucket = lexical.Bucket(batch, 400)
    item = np.array([2, 1, 0])
    read = bucket.read_terms(item, 900)
    assert read == 1
    assert bucket.candidates(item, read, 900).tolist() == [7]
    assert bucket.read_terms(item, 5000) == 0
