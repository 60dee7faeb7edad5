import hashlib
import random
import re

from pyspark.sql import functions as F

from pagemart.llm import winnowing

from .conftest import rows_of


def expected_places(hashes, window):
    """The rightmost smallest of every window, by definition."""
    if not hashes:
        return []
    found = set()
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        smallest = min(part)
        found.add(i + max(k for k, h in enumerate(part) if h == smallest))
    return sorted(found)


def test_marks_by_definition(spark, awkward):
    rows = [(r[1],) for r in awkward]
    frame = spark.createDataFrame(rows, "text string")
    found = frame.select(
        "text",
        winnowing.gram_hashes(F.col("text")).alias("grams"),
        winnowing.winnow(F.col("text")).alias("marks"),
    ).collect()
    for row in found:
        tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", row["text"] or "")
        assert len(row["grams"]) == (max(1, len(tokens) - 3) if tokens else 0)
        # Unsigned, and without the lowest bit, as the packing sees them.
        order = [(h % (1 << 64)) >> 1 for h in row["grams"]]
        places = expected_places(order, winnowing.WINDOW)
        assert [m["place"] for m in row["marks"]] == places
        assert [m["hash"] for m in row["marks"]] == [row["grams"][p] for p in places]


def test_shared_run_leaves_a_mark(spark):
    run = " ".join(f"w{i}" for i in range(winnowing.WINDOW + winnowing.GRAM - 1))
    texts = [(f"a b c {run} d e f",), (f"{' '.join(f'q{i}' for i in range(70))} {run} z",)]
    frame = spark.createDataFrame(texts, "text string")
    one, two = [{m["hash"] for m in r[0]} for r in frame.select(winnowing.winnow(F.col("text"))).collect()]
    assert one & two


def test_shared_passage_without_spaces_at_two_offsets(spark):
    draw = random.Random(7)
    passage = "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(400)) + "😀" * 3
    other = "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(101))
    texts = [passage, "字" + passage, other + passage, other + passage[100:126] + other[::-1], passage[:16]]
    rows = [(i, text) for i, text in enumerate(texts)]
    found = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    marks = {r["doc_id"]: {m["hash"] for m in r["found"]} for r in found}
    # All windows of the passage are in the longer texts too.
    assert marks[0] <= marks[1] and marks[0] <= marks[2]
    # WINDOW + GRAM - 1 tokens of MAX_TOKEN characters, 26 characters, are enough.
    assert marks[0] & marks[3]
    assert len(marks[4]) == 1


def test_edited_texts_and_neighbours(documents, awkward, monkeypatch):
    found = winnowing.fingerprints(documents).collect()
    check(found, awkward)
    monkeypatch.setattr(winnowing, "ROWS_PER_RANGE", 3)
    check(winnowing.fingerprints(documents).collect(), awkward)


def check(found, awkward):
    assert len(found) == len(awkward)
    # Rows without doc_id and rows that share one have several orders; the rest has one.
    known = sorted(r for r in awkward if r[0] is not None)
    by_id = {}
    for row in found:
        by_id.setdefault(row["doc_id"], []).append(row)
    for row, following in zip(known, known[1:], strict=False):
        text, after = row[1] or "", following[1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        got = by_id[row[0]]
        assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in got}
        assert got[0]["n_chars"] == len(text)
        assert 0 <= got[0]["near_edited"] <= 1 and 0 <= got[0]["near_next"] <= 1
    assert by_id[0][0]["found"] == by_id[2][0]["found"]
    assert by_id[8][0]["near_next"] == 1.0
    assert by_id[0][0]["near_next"] > 0.5


def test_range_numbers(spark):
    borders = [3, 5, 9, 12, 40, 41, 50]
    frame = spark.createDataFrame([(i,) for i in [*range(60), None]], "x long")
    found = frame.select("x", winnowing.range_number(F.col("x"), borders, "bigint")).collect()
    for x, number in found:
        assert number == (0 if x is None else sum(b <= x for b in borders))


def test_other_columns_and_empty(clashing, documents, no_documents):
    def digest(docs):
        rows = winnowing.fingerprints(docs).where("doc_id is not null")
        return rows_of(rows.select("doc_id", "n_chars", "edited_sha256", "near_edited"))

    assert digest(clashing) == digest(documents)
    assert winnowing.fingerprints(no_documents).count() == 0


def test_plan_has_no_python(documents):
    plan = winnowing.fingerprints(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
