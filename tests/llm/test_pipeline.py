from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pagemart.llm import pieces

from .conftest import SCHEMA, prose
from .test_line_dedup import brute_force as repeated_lines
from .test_line_dedup import words
from .test_ngram_join import brute_force as components
from .test_ngram_join import shingles

pytestmark = pytest.mark.skipif(not Path(pieces.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    """Awkward rows and plain ones, in the layout of the shared tables."""
    extra = [(100 + i, prose(200 + i, 60 + i), "en", "ab"[i % 2], None) for i in range(12)]
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = spark.createDataFrame([*awkward, *extra], SCHEMA)
    rows.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """What goes into each stage and what comes out of the last, as the check tool runs them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_keep_the_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "language ID",
        "line dedup",
        "n-gram Jaccard join",
        "mixing sources to target weights",
        "SentencePiece encoding and decoding",
    ]
    for table in steps[:-1]:
        assert table.columns == steps[0].columns


def test_language_stage_drops_what_has_no_language(steps):
    before, after = Counter(r[:2] for r in rows_of(steps[0])), Counter(r[:2] for r in rows_of(steps[1]))
    assert not after - before
    for _, text in (before - after).elements():
        assert not any(map(str.isalpha, text or "")) or len(text) > 200
    assert all(r[2] is not None for r in rows_of(steps[1]))
    assert not any(not any(map(str.isalpha, r[1] or "")) for r in rows_of(steps[1]))


def test_line_stage_equals_brute_force(spark, steps):
    rows = rows_of(steps[1])
    texts = spark.createDataFrame([(t,) for t in sorted({r[1] for r in rows})], "text string")
    tie = {r[0]: r[1] for r in texts.select("text", F.xxhash64("text")).collect()}
    gone = repeated_lines(rows, tie)
    expected = Counter()
    for doc_id, text, *_ in rows:
        numbers = gone.get((doc_id, text), [])
        lines = text.split("\n")
        if numbers:
            left = [x for i, x in enumerate(lines) if i not in numbers]
            if not any(words(x) for x in left):
                continue
            text = "\n".join(left)
        expected[doc_id, text, len(text)] += 1
    assert Counter((r[0], r[1], r[4]) for r in rows_of(steps[2])) == expected


def test_join_stage_keeps_one_of_each_group(steps):
    before, after = rows_of(steps[2]), rows_of(steps[3])
    groups = {eval(r)[2] for r in components(before) if eval(r)[1]}  # noqa: S307
    kept = [r[0] for r in after if shingles(r[1])]
    assert sorted(map(repr, kept)) == sorted(map(repr, groups))
    assert set(after) <= set(before)


def test_mixing_stage_takes_rows_of_its_input(steps):
    before, after = Counter(rows_of(steps[3])), Counter(rows_of(steps[4]))
    assert after and set(after) <= set(before)
    # No document is taken more often than the limit of passes, rounded up.
    assert max(after[r] / before[r] for r in after) <= 5


def test_last_stage_decodes_to_the_texts(steps):
    decoded = pieces.decode(steps[5])
    assert Counter((r["doc_id"], r["text"]) for r in decoded.collect()) == Counter(
        r[:2] for r in rows_of(steps[4])
    )
    assert steps[5].where("NOT round_trip OR n_pieces <> size(ids)").count() == 0


def test_run_equals_the_stages(spark, folder, steps):
    found = entry.queries()["pipeline"](spark, folder)
    assert found.columns == steps[5].columns
    assert Counter(map(repr, found.collect())) == Counter(map(repr, steps[5].collect()))
    assert "pipeline" not in entry.oracle_sql()


def test_empty_table(spark, no_documents, tmp_path):
    docs = no_documents
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count() == 0
