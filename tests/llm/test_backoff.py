import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemart.llm import backoff
from pagemart.llm.language import remainder

from .conftest import rows_of


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words] + [None]


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def brute_force(rows, order):
    """The automaton as dictionaries of n-grams, followed word by word."""
    grams = [Counter() for _ in range(order)]
    for doc_id, text, *_ in rows:
        if held_out(doc_id):
            continue
        read = ["<s>", *tokens(text)]
        for i in range(1, len(read)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    grams[n - 1][tuple(read[i - n + 1 : i + 1])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    begins = sum(not held_out(r[0]) for r in rows)

    def probability(context, word):
        if not context:
            return (grams[0][(word,)] + 0.5) / (n + 0.5 * (v + 1))
        shorter = probability(context[1:], word)
        seen = begins if context == ("<s>",) else grams[len(context) - 1][context]
        trust = min(seen / (seen + backoff.MASS), backoff.TRUST)
        return trust * grams[len(context)][(*context, word)] / max(seen, 1) + (1 - trust) * shorter

    found = []
    for doc_id, text, *_ in rows:
        read = ["<s>", *tokens(text)]
        base = score = 0.0
        for i in range(1, len(read)):
            base += math.log10(probability((), read[i]))
            score += math.log10(probability(tuple(read[max(0, i - order + 1) : i]), read[i]))
        known = sum(grams[0][(t,)] > 0 for t in read[1:])
        found.append((doc_id, held_out(doc_id), len(read) - 1, known, n, base, score))
    return found


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(documents, awkward, order, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 30_000)
    frame = backoff.score_documents(documents, remainder(F.col("doc_id"), 5) == 1, order)
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    want = sorted(brute_force(awkward, order), key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[2])), sorted(want, key=lambda r: (repr(r[0]), r[2])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_states_sum_to_one():
    rows = [(i, "a b a c a b d", "en", "s", None) for i in range(6) if not held_out(i)]
    words = ["a", "b", "c", "d", None, "unknown"]

    # One unknown word stands for all the mass of unknown words.
    n = sum(len(tokens(r[1])) for r in rows)
    base = {w: (sum(t == w for r in rows for t in tokens(r[1])) + 0.5) / (n + 0.5 * 6) for w in words}
    assert sum(base.values()) == pytest.approx(1.0)
    seen = 3 * len(rows)
    trust = min(seen / (seen + backoff.MASS), backoff.TRUST)
    after_a = Counter({"b": 2 * len(rows), "c": len(rows)})
    assert sum(trust * after_a[w] / seen + (1 - trust) * base[w] for w in words) == pytest.approx(1.0)


def test_no_training_rows(documents):
    found = backoff.score_documents(documents, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in found)


def test_other_columns_and_empty(clashing, documents, no_documents):
    fold = remainder(F.col("doc_id"), 5) == 1
    plain = [F.col("doc_id"), F.col("n_known"), F.round("score", 6)]
    assert rows_of(backoff.score_documents(clashing, fold).select(plain)) == rows_of(
        backoff.score_documents(documents, fold).select(plain)
    )
    assert backoff.score_documents(no_documents, fold).count() == 0
