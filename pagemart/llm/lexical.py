"""Ranked lexical search by norm buckets.

A document is a sparse vector of impacts: what each of its terms would add to the score of an
item that has the term. An item is a vector of ones at its terms, so a score is an inner
product and items look for the largest ones.

Impact vectors are stored by falling length. For an item that has ten scores already, the tenth
is a threshold. By Cauchy-Schwarz no document of a bucket scores more than the longest vector of
the bucket times the length of the item, so buckets below the threshold are passed over whole.
Within a bucket the rarest terms of the item come first: as few of them are read as are needed
for the others alone, by Cauchy-Schwarz or by their largest coordinates in the bucket, to stay
below the threshold. Only documents with one of the terms read are candidates, and of those only
the ones whose exact part plus a bound of the rest reaches the threshold are scored, in 64-bit
integers.

The longest vectors of the corpus are searched first, on their own. The thresholds that they
give are lower bounds for all, so the second search, over the other vectors, starts with them,
and each task raises them by what it finds itself. Thresholds decide only what is skipped.

Items are searched in blocks, so the terms that tasks know are those of a block. The only data
on the driver are the items and terms of one block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import documents
from pagemart.sources.files import Scratch

TOP = 10
#: Items searched together, and bytes of their texts: what a task knows of the items.
ITEMS = 1000
ITEM_BYTES = 8 << 20
#: Buckets of length to each doubling.
STEPS = 4
#: Vectors, at least, that are searched first for the thresholds.
FIRST = 4096
#: Bounds are computed in floating point; they are raised by this share.
SLACK = 1e-9
#: Fixed by the contract: all bytes of terms stay, A-Z become small, others separate.
_TERM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_NO_ID = np.iinfo(np.int64).min


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8: letters and digits of ASCII and all beyond."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def weight(documents: int, having: int) -> int:
    """The weight of a term that so many of the documents have."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What terms that occur so often add to a score; `norm` is the m of their documents."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm))


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, places, counts) of documents with a term: all terms, and those known."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = known.value
        for batch in batches:
            rows, sizes, places, counts = [], [], [], []
            for row, text in enumerate(batch["text"]):
                found = terms(text.as_py())
                if found:
                    own = Counter(map(place_of.get, found))
                    own.pop(None, None)
                    rows.append(row)
                    sizes.append(len(found))
                    places.append(list(own))
                    counts.append(list(own.values()))
            yield pa.record_batch(
                [
                    batch["doc_id"].take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "places", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, n long, places array<int>, counts array<long>"
    )


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists of a column, and the length of each list."""
    column = batch[name]
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _impact_vectors(vectors: DataFrame, weights: np.ndarray, total: int, terms_in_all: int) -> DataFrame:
    """(doc_id, bucket, length, places, impacts) of documents with an impact, longest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes = _flat(batch, "places")
            counts, _ = _flat(batch, "counts")
            n = batch["n"].to_numpy().astype(np.int64)
            norm = 10 + (90 * n * total) // terms_in_all
            row = np.repeat(np.arange(batch.num_rows), sizes)
            found = impacts(shared.value[places], counts.astype(np.int64), norm[row])
            some = found > 0
            places, found, row = places[some], found[some], row[some]
            squares = np.bincount(row, found.astype(float) ** 2, batch.num_rows)
            kept = squares > 0
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows)[kept])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            length = np.sqrt(squares[kept])
            yield pa.record_batch(
                [
                    batch["doc_id"].filter(pa.array(kept)),
                    pa.array(np.floor(STEPS * np.log2(length)).astype(np.int32)),
                    pa.array(length),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int64())),
                ],
                ["doc_id", "bucket", "length", "places", "impacts"],
            )

    found = vectors.where(F.size("places") > 0).mapInArrow(
        measure, "doc_id long, bucket int, length double, places array<int>, impacts array<long>"
    )
    return found.sortWithinPartitions(F.desc("length"))


class Bucket:
    """Vectors of about one length, with the rows and impacts of each term."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: int):
        self.ids = batch["doc_id"].fill_null(_NO_ID).to_numpy()
        self.length = batch["length"].to_numpy()
        self.longest = float(self.length.max())
        self.places, sizes = _flat(batch, "places")
        self.impacts, _ = _flat(batch, "impacts")
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(self.places, kind="stable")
        self.rows, self.by_term = row[order], self.impacts[order].astype(float)
        self.cuts = np.searchsorted(self.places[order], np.arange(vocabulary + 1))
        self.largest = np.zeros(vocabulary)
        here = np.flatnonzero(np.diff(self.cuts))
        if len(here):
            self.largest[here] = np.maximum.reduceat(self.by_term, self.cuts[here])

    def read_terms(self, item: np.ndarray, threshold: int) -> int:
        """How many terms of the item to read for the others to stay below the threshold."""
        rest = np.arange(len(item), -1, -1)
        by_length = np.sqrt(rest) * self.longest
        tails = np.cumsum(self.largest[item][::-1])[::-1]
        bound = np.minimum(by_length, np.concatenate([tails, [0.0]]))
        return int(np.argmax(bound * (1 + SLACK) < threshold)) if threshold > 0 else len(item)

    def candidates(self, item: np.ndarray, read: int, threshold: int) -> np.ndarray:
        """Rows with one of the terms read whose bound reaches the threshold."""
        lists = [slice(self.cuts[t], self.cuts[t + 1]) for t in item[:read]]
        rows = np.concatenate([self.rows[s] for s in lists])
        values = np.concatenate([self.by_term[s] for s in lists])
        exact = np.bincount(rows, values, len(self.ids))
        squares = np.bincount(rows, values**2, len(self.ids))
        left = np.sqrt(np.maximum(self.length**2 * (1 + SLACK) - squares, 0.0) * (len(item) - read))
        bound = exact + np.minimum(left, self.largest[item[read:]].sum())
        return np.flatnonzero((exact > 0) & (bound * (1 + SLACK) >= threshold))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The exact score of each row; `wanted` is 1 at the terms of the item."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return np.add.reduceat(self.impacts[at] * wanted[self.places[at]], ends - sizes)


class Best:
    """The highest scores of one item so far, equal ones by id."""

    def __init__(self, threshold: int, top: int):
        self.threshold, self.top = threshold, top
        self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.threshold)
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        first = np.lexsort((ids, -scores))[: self.top]
        self.ids, self.scores = ids[first], scores[first]
        if len(first) == self.top:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def _search(vectors: DataFrame, items: list[np.ndarray], thresholds: list[int], size: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, thresholds))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch["bucket"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield batch.slice(a, b - a)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, thresholds = shared.value
        best = [Best(t, top) for t in thresholds]
        norms = np.sqrt([len(item) for item in items])
        wanted = np.zeros(size, np.int64)
        for piece in pieces(batches):
            limits = np.array([b.threshold for b in best])
            longest = float(piece["length"].to_numpy().max())
            alive = np.flatnonzero((norms > 0) & (norms * longest * (1 + SLACK) >= limits))
            if not len(alive):
                continue
            bucket = Bucket(piece, size)
            for i in alive:
                item, found = items[i], best[i]
                read = bucket.read_terms(item, found.threshold)
                rows = bucket.candidates(item, read, found.threshold) if read else ()
                if len(rows):
                    wanted[item] = 1
                    found.add(bucket.ids[rows], bucket.scores(rows, wanted))
                    wanted[item] = 0
        number = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best])
        scores = np.concatenate([b.scores for b in best])
        yield pa.record_batch(
            [
                pa.array(number, pa.int32()),
                pa.array(ids, pa.int64(), mask=ids == _NO_ID),
                pa.array(scores, pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return vectors.mapInArrow(search, "item int, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks, ranked from 1; tasks send at most `top` rows for an item."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, texts: list[str], top: int, scratch: Scratch) -> DataFrame | None:
    """(item, rank, doc_id, score) for the texts, numbered from 0."""
    each = [sorted(set(terms(text))) for text in texts]
    vocabulary = {term: place for place, term in enumerate(sorted(set().union(*each)))}
    if not vocabulary:
        return None
    vectors = scratch.table(_vectors(docs, vocabulary))
    total, in_all = vectors.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    # One row per term of the block.
    having = vectors.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    weights = np.zeros(len(vocabulary), np.int64)
    for place, n in having.collect():
        weights[place] = weight(total, n)
    # Rarest terms first; terms without weight or document add nothing.
    places = [np.array([vocabulary[t] for t in own], np.int64) for own in each]
    items = [p[np.lexsort((p, -weights[p]))] for p in places]
    items = [p[weights[p] > 0] for p in items]

    ordered = scratch.table(_impact_vectors(vectors, weights, total, in_all))
    sizes = sorted(ordered.groupBy("bucket").count().collect(), reverse=True)
    if not sizes:
        return None
    seen, border = 0, sizes[0][0]
    for border, count in sizes:
        seen += count
        if seen >= FIRST:
            break
    size = len(vocabulary)
    first = scratch.table(
        _ranked(_search(ordered.where(F.col("bucket") >= border), items, [0] * len(items), size, top), top)
    )
    thresholds = [0] * len(items)
    for row in first.where(F.col("rank") == top).collect():
        thresholds[row["item"]] = row["score"]
    # Vectors that are too short for every item need not be read.
    least = min((t / math.sqrt(len(p)) for t, p in zip(thresholds, items, strict=True) if len(p)), default=0)
    rest = ordered.where((F.col("bucket") < border) & (F.col("length") >= least * (1 - SLACK)))
    found = _search(rest, items, thresholds, size, top)
    return _ranked(found.unionByName(first.drop("rank")), top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the documents with the highest scores.

    Scores above 0 only; equal ones by id, null ids first. Every row of `docs` is a document of
    its own, repeated ones too. Rows of `items` that are equal in item_id and text are one item.
    Null and empty texts have no terms: such documents are never found and such items have no
    rows. Long texts are read whole. Further columns are ignored. An empty table of either kind
    gives no rows. Intermediate tables are removed; the result is a table of its own.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    results = Scratch(spark, "ranked")
    found = spark.createDataFrame([], T.StructType([schema[1], *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        with Scratch(spark, "search") as scratch:
            ranked = _search_block(docs, [row["text"] for row in own], top, scratch)
            if ranked is not None:
                names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(own)], schema)
                ranked = ranked.join(F.broadcast(names), "item").select(found.columns)
                found = found.unionByName(results.table(ranked))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
