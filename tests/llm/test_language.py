import numpy as np
from pyspark.sql import functions as F

from pagemart.llm import language

from .conftest import rows_of

ENGLISH = "the house by the river was old and the people who lived there were kind to every stranger that came along"
GERMAN = "das alte haus am fluss war schön und die leute die dort wohnten waren freundlich zu jedem fremden der kam"


def corpus(spark, count=40):
    rows = []
    for i in range(count):
        words = (ENGLISH if i % 2 else GERMAN).split()
        words = words[i % 7 :] + words[: i % 7]
        rows.append((i, " ".join(words * 4), "en" if i % 2 else "de"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = language.fit(language.learning_rows(docs))
    found = language.predict(docs, model).where(language.remainder(F.col("doc_id"), 4) == 2)
    assert found.count() > 3
    assert found.where("lang_pred <> lang OR score < 0 OR score > 1 OR rejected").count() == 0


def test_far_texts_are_rejected(spark):
    model = language.fit(corpus(spark))
    odd = "qzx xqz zzq qqx jjq xjx vvq " * 30
    rows = [(1, odd), (2, None), (3, "12 34 !?"), (4, ""), (5, "kurz"), (6, "²½ ٣")]
    found = language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["rejected"] and by_id[1]["lang_pred"] in ("de", "en")
    for i in (2, 3, 4, 6):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["rejected"]
    assert not by_id[5]["rejected"] and by_id[5]["lang_pred"] != "und"


def test_trigram_counts():
    counts = language.trigram_counts(["ab", None, "", "Ab ab!", "x1y"])
    assert counts.shape == (5, language.DIMENSIONS)
    assert counts.sum(axis=1).tolist() == [2, 0, 0, 4, 2]
    assert (2 * counts[0] == counts[3]).all()
    texts = ["some text here"] * 700 + ["y" * (3 << 20)] + [None]
    assert [i for a, b in language.blocks(texts) for i in range(a, b)] == list(range(702))


def test_kmeans_finds_clusters():
    draw = np.random.default_rng(1)
    centres = np.eye(3, 8, dtype=np.float32)
    points = np.repeat(centres, 20, axis=0) + draw.normal(0, 0.05, (60, 8)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    found = language.spherical_kmeans(points, 3)
    assert sorted(np.argmax(found, axis=1).tolist()) == [0, 1, 2]
    assert len(language.spherical_kmeans(points[:2], 4)) == 2


def test_awkward_rows(documents, clashing, awkward, no_documents):
    model = language.fit(language.learning_rows(documents))
    found = language.predict(documents, model)
    assert found.count() == len(awkward) and set(documents.columns) < set(found.columns)
    langs = {r["lang_pred"] for r in found.collect()}
    assert langs <= {"en", "de", "und"}
    again = language.predict(clashing, language.fit(language.learning_rows(clashing)))
    columns = ["doc_id", "lang_pred", F.round("score", 5), "rejected"]
    assert rows_of(again.select(columns)) == rows_of(found.select(columns))
    nothing = language.fit(no_documents)
    assert language.predict(no_documents, nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict(documents, nothing).collect()} == {"und"}
