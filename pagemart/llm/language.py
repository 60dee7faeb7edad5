"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte trigrams (small letters; marks and digits count as
spaces), each weighted log(1 + count) times the inverse document frequency, of length 1.
Document frequencies cover all learning documents. Each language is described by a few
centroids, found by spherical k-means on a bounded sample of its learning documents. A text
gets the language of the centroid with the largest cosine; it is rejected if it lies far
beyond nearly all texts the centroid was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import documents, written

DIMENSIONS = 4096
#: Learning documents per language for the centroids: the bound of the sample.
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 12
#: Clusters with a smaller share of a language's vectors get no centroid of their own.
MIN_SHARE = 0.05
#: A text is rejected below this share of a low quantile of the cosines of the centroid's texts.
REJECT_SHARE, LOW_QUANTILE = 0.5, 0.02
#: Texts with fewer trigrams say too little to be rejected.
MIN_TRIGRAMS = 200
#: Texts of one block share a count matrix; a longer text has a block of its own.
BLOCK_BYTES = 1 << 20

_FOLD = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """One row of DIMENSIONS counts per text."""
    parts = [(t or "").lower().encode().translate(_FOLD) for t in texts]
    # One space before and after each text; a trigram counts if its middle is no space, so
    # none reaches into the next text.
    data = np.frombuffer(b" " + b"".join(p + b" " for p in parts) + b" ", np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) + 1 for p in parts])
    first, middle, last = data[:-2], data[1:-1], data[2:]
    code = ((first << 16) | (middle << 8) | last) * np.uint32(2654435761)
    places = (code >> np.uint32(32 - 12)).astype(np.int64) + row * DIMENSIONS
    counts = np.bincount(places[middle != 32], minlength=len(parts) * DIMENSIONS)
    return counts.reshape(len(parts), DIMENSIONS)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BLOCK_BYTES and at most 256 texts."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text or "") > BLOCK_BYTES or i - start == 256):
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length 1, or 0 for a text without trigrams."""
    vectors = np.log1p(counts).astype(np.float32) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(vectors: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of length 1, none for clusters under MIN_SHARE of the vectors.

    Starts are drawn one after the other, far vectors more likely, from a fixed seed, so the
    same vectors give the same centroids and a single odd vector is an unlikely start. Vectors
    of a cluster that is too small join the nearest of the others.
    """
    draw = np.random.Generator(np.random.PCG64(20240603))
    chosen = [int(draw.integers(len(vectors)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        far = np.maximum(1 - nearest.astype(float), 0) ** 2
        far[chosen] = 0
        if not far.any():
            break
        chosen.append(int(draw.choice(len(vectors), p=far / far.sum())))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for step in range(2 * ROUNDS):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sizes = np.bincount(own, minlength=len(centroids))
        if step >= ROUNDS:
            large = sizes >= max(1, MIN_SHARE * len(vectors))
            if large.all():
                break
            large[np.argmax(sizes)] = True
            centroids = centroids[large]
            own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the folds; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(place, n): texts with each hashed trigram; place -1 has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in pieces(batches):
            column = batch["text"].to_pylist()
            for start, end in blocks(column):
                total += (trigram_counts(column[start:end]) > 0).sum(axis=0)
            texts += len(column)
        places = np.arange(-1, DIMENSIONS)
        yield pa.record_batch([places, np.concatenate([[texts], total])], ["place", "n"])

    counted = docs.select("text").mapInArrow(count, "place long, n long")
    return counted.groupBy("place").agg(F.sum("n").alias("n"))


class Model:
    """Inverse document frequencies and centroids; one small object for all tasks."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, lowest: np.ndarray):
        self.idf, self.langs, self.centroids, self.lowest = idf, langs, centroids, lowest

    def predict(self, texts: list[str | None]) -> list[dict]:
        found: list[dict] = []
        for start, end in blocks(texts):
            counts = trigram_counts(texts[start:end])
            cosines = weighted(counts, self.idf) @ self.centroids.T
            for text, n, row in zip(texts[start:end], counts.sum(axis=1), cosines, strict=True):
                if not self.langs or not has_letter(text):
                    found.append({"lang_pred": "und", "score": 0.0, "rejected": True})
                    continue
                best = int(np.argmax(row))
                score = float(np.clip(row[best], 0, 1))
                far = bool(n >= MIN_TRIGRAMS and score < REJECT_SHARE * self.lowest[best])
                found.append({"lang_pred": self.langs[best], "score": score, "rejected": far})
        return found


def fit(docs: DataFrame) -> Model:
    """Learn from the text and lang of all rows with both.

    Document frequencies are summed over all rows. The centroids of a language come from one
    task that holds SAMPLE texts at most, the same ones in every run. The driver receives
    DIMENSIONS counts and CENTROIDS vectors per language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {row["place"]: row["n"] for row in document_frequencies(known).collect()}
    frequencies = np.array([counts.get(i, 0) for i in range(DIMENSIONS)])
    idf = np.log((1 + counts.get(-1, 0)) / (1 + frequencies)).astype(np.float32) + 1

    # First keys only, then the texts of the few chosen rows; equal rows count once.
    keyed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = keyed.select("lang", "key").distinct().withColumn("place", place)
    keys = written(keys.where(F.col("place") <= SAMPLE).drop("place"), "language-sample")
    chosen = keyed.join(keys, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])

    def cluster(table: pa.Table) -> pa.Table:
        texts = table.sort_by("key")["text"].to_pylist()
        counts = np.concatenate([trigram_counts(texts[a:b]) for a, b in blocks(texts)])
        vectors = weighted(counts, idf)[counts.sum(axis=1) >= MIN_TRIGRAMS]
        if not len(vectors):
            vectors = weighted(counts, idf)
        centroids = spherical_kmeans(vectors, CENTROIDS)
        cosines = vectors @ centroids.T
        own = np.argmax(cosines, axis=1)
        rows = [
            {
                "lang": table["lang"][0].as_py(),
                "centroid": c.astype(np.float32).tobytes(),
                "lowest": float(np.quantile(cosines[own == i, i], LOW_QUANTILE)) if (own == i).any() else 1.0,
            }
            for i, c in enumerate(centroids)
        ]
        layout = pa.schema([("lang", pa.string()), ("centroid", pa.binary()), ("lowest", pa.float64())])
        return pa.Table.from_pylist(rows, schema=layout)

    schema = "lang string, centroid binary, lowest double"
    rows = chosen.groupBy("lang").applyInArrow(cluster, schema).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["centroid"])))
    centroids = np.array([np.frombuffer(r["centroid"], np.float32) for r in rows])
    return Model(
        idf,
        [r["lang"] for r in rows],
        centroids.reshape(len(rows), DIMENSIONS),
        np.array([r["lowest"] for r in rows]),
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs`, plus lang_pred, score (cosine, 0 to 1) and rejected.

    A text that is null or has no letter gets `und`, score 0, and is rejected; so does every
    text if nothing was learned. Ties go to the first centroid in order. Predictions see the
    text only. Columns of `docs` with the new names are replaced.
    """
    fields = ("lang_pred", "score", "rejected")
    kept = docs.drop(*fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        for batch in pieces(batches):
            found = pa.RecordBatch.from_pylist(shared.value.predict(batch["text"].to_pylist()), schema=layout)
            yield pa.record_batch([*batch.columns, *found.columns], [*batch.schema.names, *fields])

    new = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    return kept.mapInArrow(label, T.StructType([*kept.schema, *new]))


def learning_rows(docs: DataFrame) -> DataFrame:
    """The three folds of four that may be learned from."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(learning_rows(docs))
    found = predict(docs.select("doc_id", "text"), model)
    held_out = remainder(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
