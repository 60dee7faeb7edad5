import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemart.llm import quality

from .conftest import rows_of


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_base_counts(documents, awkward):
    found = quality.quality(documents).collect()
    assert len(found) == len(awkward)
    expected = Counter((row[0], *base(row[1]).values()) for row in awkward)
    assert Counter((r["doc_id"], *[r[k] for k in base(None)]) for r in found) == expected
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_distance_by_hand(spark):
    rows = [([4, 0, 6], [1, 1, 2]), ([1, 1], [2, 2]), ([3, 0], [0, 5]), ([0, 0], [1, 1])]
    frame = spark.createDataFrame(rows, "p array<long>, q array<long>")
    found = [r[0] for r in frame.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]

    def expected(p, q):
        p = [x / max(sum(p), 1) for x in p]
        q = [x / max(sum(q), 1) for x in q]

        def h(v):
            return -sum(x * math.log2(x) for x in v if x)

        middle = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0, h(middle) - (h(p) + h(q)) / 2))

    for (p, q), got in zip(rows, found, strict=True):
        assert got == pytest.approx(expected(p, q), abs=1e-9)


def test_histograms(spark):
    text = "Ab cd, ef! 12 é Ü | x"
    frame = spark.createDataFrame([(text,)], "text string")
    classes = quality.character_classes(F.col("text"), F.lit(14))
    assert frame.select(classes).first()[0] == [7, 2, 2, 2, 1, 1, 6]
    hashes = F.array(*[F.lit(x).cast("long") for x in (5, 6, 5, 7, 9, 5)])
    common = F.array(F.lit(5).cast("long"), F.lit(9).cast("long"), F.lit(8).cast("long"))
    bins = frame.select(quality.word_bins(hashes, common)).first()[0]
    assert bins[:4] == [2, 3, 1, 0] and sum(bins) == 6


def test_odd_documents_lie_far(spark):
    clean = "the cat and the dog saw a bird in the old tree by the river and it sang "
    odd = "### | *** | $$$ % | " * 40
    rows = [(i, clean * 8 + f"w{i} x{i} y{i}", "en") for i in range(60)] + [(99, odd, "en")]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[99]["class_distance"] > 0.33 > by_id[0]["class_distance"]
    assert by_id[99]["word_distance"] > 0.5 > by_id[0]["word_distance"]


def test_nonsense_at_natural_coverage(spark):
    draw = random.Random(5)

    def nonsense(count):
        return ["".join(draw.choices("abcdefghijklmnopqrst", k=6)) for _ in range(count)]

    common = nonsense(32)

    def natural(count):
        return " ".join(draw.choice(common) if draw.random() < 0.25 else w for w in nonsense(count))

    rows = [(i, natural(150), "en") for i in range(100)]
    rows += [(200 + i, " ".join(nonsense(n)), "en") for i, n in enumerate((50, 100, 400, 1000))]
    # Without words that recur, lacking them says nothing.
    rows += [(300 + i, " ".join(nonsense(150)), "xx") for i in range(30)]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for r in found.collect():
        assert not r["base_failed"] and r["class_distance"] < 0.33 and r["word_distance"] < 0.5
        assert r["kept"] == (not 200 <= r["doc_id"] < 300), r


def test_other_columns_and_empty(clashing, documents, no_documents):
    assert rows_of(quality.quality(clashing)) == rows_of(quality.quality(documents))
    assert quality.quality(no_documents).count() == 0


def test_plan_has_no_python(documents):
    found = quality.features(documents, quality.common_words(documents))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
