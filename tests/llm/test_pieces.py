from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemart.llm import pieces

from .conftest import rows_of

pytestmark = pytest.mark.skipif(not Path(pieces.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def codec():
    return pieces.codec()


@pytest.fixture(scope="module")
def small():
    """A tiny vocabulary with many ways, ties included."""
    found = [(3, "▁", -2.0), (4, "a", -1.5), (5, "b", -1.5), (6, "ab", -2.0), (7, "▁a", -2.0), (8, "ba", -2.5)]
    return pieces.Codec(found + [(9, "aba", -3.0), (10, "▁▁", -2.2)], list(range(20, 276)))


def all_ways(codec, text):
    chars = f" {text}".replace(" ", "▁")
    found = []

    def walk(at, ids, score):
        if at == len(chars):
            found.append((score, ids))
            return
        for end in range(at + 1, min(at + codec.longest, len(chars)) + 1):
            piece = chars[at:end]
            if piece in codec.scores:
                walk(end, (*ids, codec.ids[piece]), score + codec.scores[piece])
        if chars[at] not in codec.scores:
            raw = f" {text}"[at].encode()
            walk(at + 1, (*ids, *[codec.byte_ids[b] for b in raw]), score + codec.byte_score * len(raw))

    walk(0, (), 0)
    return sorted(((s * pieces.UNIT, i) for s, i in found), reverse=True)


def check(codec, text, count):
    want = all_ways(codec, text)
    got = codec.encode(text, count)
    assert len(got) == min(count, len(want))
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:count]])
    ids = [tuple(np.frombuffer(b, np.int32).tolist()) for _, b in got]
    assert len(set(ids)) == len(ids)
    scores = {i: s for s, i in want}
    for (score, _), way in zip(got, ids, strict=True):
        assert scores[way] == pytest.approx(score)
        assert codec.decode(list(way)) == text


@pytest.mark.parametrize("text", ["", "a", "ab", "abab", "ab ba", "ababa  ab", "a\nb", "xé b", " ", "aba aba aba"])
@pytest.mark.parametrize("count", [1, 2, 5, 40])
def test_n_best_against_all_ways(small, text, count):
    check(small, text, count)


@pytest.mark.parametrize("text", ["the cat sat", "Größe x", "a\tb"])
def test_n_best_of_the_real_vocabulary(codec, text):
    check(codec, text, 6)


@pytest.mark.parametrize(
    "text", ["  two  spaces\n\n", "▁ literal ▁▁", "日本語 😀", "<0x0A> <s>", "x" * 3000, "a;\r\nb c　d", "\0"]
)
def test_round_trips(codec, text):
    ways = codec.encode(text, 3)
    for _, ids in ways:
        assert codec.decode(np.frombuffer(ids, np.int32).tolist()) == text


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    for i in range(300):
        codec.encode(f"word{i} other{i}", 2)
        assert len(codec.words) <= 53


def test_encode_and_decode(documents, clashing, awkward, no_documents):
    found = pieces.encode(documents)
    rows = found.collect()
    assert len(rows) == len(awkward)
    for row in rows:
        if row["text"] is None:
            assert row["ways"] is None and row["round_trip"] is None
        else:
            assert row["round_trip"] and 1 <= len(row["ways"]) <= pieces.N_BEST
            scores = [w["score"] for w in row["ways"]]
            assert scores == sorted(scores, reverse=True)
    ids = found.select("doc_id", "text", F.col("ways")[0]["ids"].alias("ids"))
    back = pieces.decode(ids.withColumnRenamed("text", "original"))
    assert back.where("NOT (text <=> original)").count() == 0
    assert rows_of(pieces.digest(pieces.encode(clashing))) == rows_of(pieces.digest(found))
    assert pieces.encode(no_documents).count() == 0


def test_slices_yield_all_rows(documents, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE_CHARS", 10)
    assert [i for a, b in pieces.slices(["abc"] * 9 + [None]) for i in range(a, b)] == list(range(10))


def test_words_are_remembered_in_little_memory(codec):
    """The record of a word takes less than the word; as objects it took over 150 bytes."""
    import tracemalloc

    own = pieces.Codec(codec.pieces, codec.byte_ids)
    units = [f" w{i * 7919 % 99991}" for i in range(20000)]
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for unit in units:
            own.words[unit]
        taken = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    # Number, entry and record; the words themselves are held by the test.
    assert taken / len(units) < 150


def test_words_that_came_again_stay(codec, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    own, fresh = (pieces.Codec(codec.pieces, codec.byte_ids) for _ in range(2))
    asked = []
    word = own.word
    monkeypatch.setattr(own, "word", lambda unit: asked.append(unit) or word(unit))
    for i in range(200):
        text = f"often Größe 日本 word{i}"
        found = own.encode(text, 4)
        monkeypatch.setattr(pieces, "REMEMBERED", 10**6)
        assert found == fresh.encode(text, 4)
        monkeypatch.setattr(pieces, "REMEMBERED", 40)
        assert len(own.words) <= 44
    assert asked.count(" often") == asked.count(" Größe") == 1


def test_smallest_and_gathered():
    import heapq
    import random

    draw = random.Random(5)
    for _ in range(300):
        values = [draw.choice([1, 2, 3, pieces.NO_WAY]) for _ in range(draw.randint(0, 9))]
        count = draw.randint(0, 6)
        want = heapq.nsmallest(count, range(len(values)), key=values.__getitem__)
        assert pieces.smallest(np.array(values, np.int64), count) == want
    parts = pieces.gathered(np.arange(9), np.array([4, 0, 7]), np.array([2, 0, 2]))
    assert parts.tolist() == [4, 5, 7, 8]
    assert pieces.gathered(np.arange(9), np.array([], int), np.array([], int)).tolist() == []
