import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemart.llm import ngram_join
from pagemart.llm.components import components
from pagemart.llm.hashing import word_hashes

from .conftest import prose, rows_of


def shingles(text):
    found = [
        re.sub("[A-Z]", lambda m: m[0].lower(), w)
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ]
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_force(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    found = []
    for i, row in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        found.append((row[0], len(sets[i]), min(ids, default=None) if sets[i] else row[0]))
    return sorted(map(repr, found))


def got(frame):
    rows = ngram_join.link_documents(frame).collect()
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows)


def test_against_brute_force(documents, awkward):
    assert got(documents) == brute_force(awkward)


def edited(draw, tokens, edits):
    tokens = list(tokens)
    for _ in range(edits):
        place = draw.randrange(len(tokens))
        action = draw.random()
        if action < 0.4:
            tokens[place] = f"e{draw.randint(0, 99)}"
        elif action < 0.7:
            del tokens[place]
        else:
            tokens.insert(place, f"i{draw.randint(0, 99)}")
    return tokens


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_against_brute_force(spark, seed):
    """Chains of edits and passages that many documents share, in all sizes of sets."""
    draw = random.Random(seed)
    shared = prose(999, 25).split()
    rows = []
    for family in range(14):
        size = draw.choice([5, 6, 7, 8, 9, 12, 20, 33, 64, 130, 300])
        tokens = prose(seed * 50 + family, size, 3000).split()
        for _ in range(draw.randint(1, 9)):
            place = draw.randrange(len(tokens) + 1)
            whole = tokens[:place] + shared + tokens[place:] if draw.random() < 0.5 else tokens
            rows.append((len(rows), " ".join(whole)))
            tokens = edited(draw, tokens, draw.randint(0, max(1, len(tokens) // 25)))
            tokens = tokens or ["x"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(frame) == brute_force(rows)


def test_keys_meet_for_every_linked_pair():
    """The pigeonhole bound on sets alone, with and without frequent elements."""
    draw = np.random.default_rng(4)
    for trial in range(400):
        size = int(draw.integers(3, 120 if trial % 3 else 3000))
        a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
        changes = int(draw.integers(0, len(a) // 4 + 2))
        b = np.unique(np.concatenate([a[changes:], draw.integers(0, 1 << 63, changes // 2, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        union = len(a) + len(b) - shared
        frequent = np.zeros(ngram_join.COUNTERS, bool)
        if trial % 2:
            frequent[ngram_join.counter(a[: len(a) // 2])] = True
        both = ngram_join.Sketches([ngram_join.sketch(a), ngram_join.sketch(b)])
        flips = int(both.flips(0, np.array([1]))[0])
        assert flips <= union - shared
        if 100 * shared < 75 * union or min(len(a), len(b)) < 3 or len(a) == len(b) == shared:
            continue
        keys = [
            {k for band in ngram_join.bands(len(s)) for k in ngram_join.part_keys(s, band, frequent).tolist()}
            for s in (a, b)
        ]
        assert keys[0] & keys[1]


def test_word_hashes():
    texts = ["Hello World  foo", None, "", " x\ty\n", "hello world bar é\x0bÉ", "a" * 5000 + " b", "x" * 3]
    hashes, counts = word_hashes(pa.array(texts))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in expected]
    seen = {}
    for word, found in zip([w for ws in expected for w in ws], hashes.tolist(), strict=True):
        word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
        assert seen.setdefault(word, found) == found
    assert len(set(seen.values())) == len(seen)
    assert word_hashes(pa.array(texts * 3)[7:14])[0].tolist() == hashes.tolist()


def test_components(spark):
    edges = [(5, 4), (4, 9), (9, 1), (20, 21), (30, 30), (7, 6), (6, 8), (8, 7)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    labels = {r["node"]: r["label"] for r in found}
    assert labels[5] == labels[9] == 1 and labels[21] == 20 and labels[8] == 6
    assert {labels[100 + i] for i in range(41)} == {100}


def test_one_of_each(spark, documents, awkward):
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns
    groups = {}
    for text in brute_force(awkward):
        doc_id, size, component = eval(text)  # noqa: S307
        if size:
            groups.setdefault(component, []).append(doc_id)
    ids = [r["doc_id"] for r in kept.collect() if shingles(r["text"])]
    assert sorted(ids, key=repr) == sorted(groups, key=repr)
    wordless = sum(not shingles(r[1]) for r in awkward)
    assert kept.count() == len(ids) + wordless


def test_other_columns_and_empty(clashing, documents, no_documents):
    assert got(clashing) == got(documents)
    assert rows_of(ngram_join.one_of_each(clashing).select("doc_id", "text")) == rows_of(
        ngram_join.one_of_each(documents).select("doc_id", "text")
    )
    assert ngram_join.link_documents(no_documents).count() == 0
