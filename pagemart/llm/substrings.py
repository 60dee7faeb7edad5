"""Substring deduplication by seed and extend.

Every run of WINDOW words is a window, and a word goes if a window over it also starts in a
document with a smaller id.

Seeds: the words of a text are hashed in runs of GRAM. Of the runs inside a window the one with
the smallest hash, the rightmost of equals, is the window's anchor. Equal windows have the same
anchor at the same place, so documents that share a window meet when they are joined on anchors.
Neighbouring windows mostly have the same anchor; the stretch of all windows of one anchor is
its block, and about one word in eighteen is an anchor.

Extend: of the documents that meet on an anchor, the smallest is the hub. Blocks that are equal
as a whole are one class, whose first document counts; what stands in a class with an earlier
document is a repeat from end to end. The first block of any other class is laid against that
of the hub and extended to both sides of the anchor as far as the words agree. The matches
that reach WINDOW words are repeats, and matches of successive anchors join to maximal ones.

What remains are windows that the hub does not have at this anchor but another document may:
each is known by its anchor, its place and a hash of all its words, and goes if one of the
same kind stands in a smaller document. So a family of n copies, however they differ, costs
about n comparisons and no pair is listed. Anchors are grouped with partial aggregates and
joined with one row per anchor or class.

Documents are known by (doc_id, hash of the text). Words are compared by 64-bit hashes, blocks
and windows by two such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import documents, written
from pagemart.llm.hashing import RangeHashes, mixed, slices, word_hashes
from pagemart.sources.files import Scratch

#: Fixed by the contract.
WINDOW = 50
#: Words of a seed; a power of two.
GRAM = 16
SLICE_BYTES = 4 << 20
_FIRST_ID = -(1 << 63)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` words, composed from those of its halves."""
    reach = 1
    while reach < gram:
        words = mixed(words[:-reach] * np.uint64(0xA0761D6478BD642F) + words[reach:], reach)
        reach *= 2
    return words


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the smallest, the rightmost of equals."""

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] <= values[left], right, left)

    best, reach = np.arange(len(values)), 1
    while 2 * reach <= width:
        best = better(best[:-reach], best[reach:])
        reach *= 2
    rest = width - reach
    return better(best[: len(best) - rest], best[rest:]) if rest else best


def anchors(
    words: np.ndarray, counts: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place, first word, end) of the block of every anchor of some texts.

    `words` holds the words of all texts, `counts` how many each has; places count from the
    first word of the first text.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none.view(np.uint64), none, none, none
    grams = gram_hashes(words, gram)
    least = least_places(grams, window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(least))
    starts = starts[starts + window <= np.cumsum(counts)[text[starts]]]
    place = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    ends = starts[np.concatenate([at[1:] - 1, [len(starts) - 1]])] + window if len(at) else none
    first, place = starts[at], place[at]
    return text[first], grams[place], place, first, ends


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, tie, anchor, block, pos, first, end) of every anchor; `block` is its class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                part = batch.slice(a, b - a)
                words, counts = word_hashes(part["text"], fold=False)
                text, anchor, place, first, end = anchors(words, counts, window, gram)
                shape = (place - first).astype(np.uint64) * np.uint64(1 << 32)
                block = mixed(RangeHashes(words).of(first, end) + shape, 32)
                begins = (np.cumsum(counts) - counts)[text]
                yield pa.record_batch(
                    [
                        part["doc"].take(pa.array(text)),
                        part["tie"].take(pa.array(text)),
                        _signed(anchor),
                        _signed(block),
                        *[pa.array((x - begins).astype(np.int32)) for x in (place, first, end)],
                    ],
                    ["doc", "tie", "anchor", "block", "pos", "first", "end"],
                )

    schema = "doc long, tie long, anchor long, block long, pos int, first int, end int"
    return docs.mapInArrow(read, schema)


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, block, doc, hub, left, words) of the wanted blocks: the hashes of their words,
    `left` of them before the anchor."""
    asked = F.struct("anchor", "block", "is_hub", "pos", "first", "end")
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(asked).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE_BYTES):
                part = batch.slice(a, b - a)
                words, counts = word_hashes(part["text"], fold=False)
                asked = part["asked"]
                each = np.diff(asked.offsets.to_numpy())
                flat = asked.flatten()
                begins = np.repeat(np.cumsum(counts) - counts, each)
                first = flat.field("first").to_numpy().astype(np.int64)
                sizes = flat.field("end").to_numpy() - first
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins + first - (ends - sizes), sizes)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.record_batch(
                    [
                        flat.field("anchor"),
                        flat.field("block"),
                        part["doc"].take(pa.array(np.repeat(np.arange(len(each)), each))),
                        flat.field("is_hub"),
                        pa.array((flat.field("pos").to_numpy() - first).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, _signed(words[at])),
                    ],
                    ["anchor", "block", "doc", "is_hub", "left", "words"],
                )

    schema = "anchor long, block long, doc long, is_hub boolean, left int, words array<long>"
    return texts.join(lists, ["doc", "tie"]).select("doc", "text", "asked").mapInArrow(read, schema)


def extension(words: np.ndarray, left: int, other: np.ndarray, other_left: int) -> tuple[int, int]:
    """How many words agree before the anchor, and how many from its first word on."""
    before, after = min(left, other_left), min(len(words) - left, len(other) - other_left)
    differ = words[left - before : left] != other[other_left - before : other_left]
    after_differ = words[left : left + after] != other[other_left : other_left + after]
    last = np.flatnonzero(differ)
    first = np.flatnonzero(after_differ)
    return (before - 1 - int(last[-1]) if len(last) else before), (int(first[0]) if len(first) else after)


def _extended(contexts: DataFrame, window: int) -> DataFrame:
    """(anchor, block, doc, start, end, rest) of every block but the hubs: the match with the hub
    if it is long enough, else null, and (off, code) of the windows outside of it.

    Places count from the anchor.
    """
    hubs = contexts.where("is_hub").select(
        "anchor", F.col("left").alias("hub_left"), F.col("words").alias("hub_words")
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, hub_lefts = batch["left"].to_numpy(), batch["hub_left"].to_numpy()
            words, hub_words = batch["words"].flatten().to_numpy(), batch["hub_words"].flatten().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(np.diff(batch["words"].offsets.to_numpy()))])
            hub_cuts = np.concatenate([[0], np.cumsum(np.diff(batch["hub_words"].offsets.to_numpy()))])
            matches = []
            for row in range(batch.num_rows):
                own = words[cuts[row] : cuts[row + 1]]
                hub = hub_words[hub_cuts[row] : hub_cuts[row + 1]]
                matches.append(extension(own, int(lefts[row]), hub, int(hub_lefts[row])))
            before, after = np.array(matches, np.int64).reshape(-1, 2).T
            # All windows of the blocks, and which of them lie inside the match.
            sizes = np.diff(cuts) - window + 1
            row = np.repeat(np.arange(batch.num_rows), sizes)
            within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            off = within - lefts[row]
            left_out = (off < -before[row]) | (off + window > after[row])
            begins = cuts[:-1][row[left_out]] + within[left_out]
            codes = RangeHashes(words.view(np.uint64)).of(begins, begins + window)
            rests = np.bincount(row[left_out], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rests)]).astype(np.int32))
            short = before + after < window
            rest = pa.StructArray.from_arrays(
                [pa.array(off[left_out].astype(np.int32)), _signed(codes)], ["off", "code"]
            )
            yield pa.record_batch(
                [
                    *[batch[c] for c in ("anchor", "block", "doc")],
                    pa.array((-before).astype(np.int32), mask=short),
                    pa.array(after.astype(np.int32), mask=short),
                    pa.ListArray.from_arrays(offsets, rest),
                ],
                ["anchor", "block", "doc", "start", "end", "rest"],
            )

    schema = "anchor long, block long, doc long, start int, end int, rest array<struct<off: int, code: long>>"
    return contexts.where("NOT is_hub").join(hubs, "anchor").drop("is_hub").mapInArrow(extend, schema)


def _class_repeats(extended: DataFrame, window: int) -> DataFrame:
    """(anchor, block, start, end): what of a block stands in a smaller document, from the anchor."""
    matched = extended.where("start IS NOT NULL").select("anchor", "block", "start", "end")
    windows = extended.select("anchor", "block", "doc", F.explode("rest").alias("rest"))
    windows = windows.select("anchor", "block", "doc", "rest.off", "rest.code")
    kind = ["anchor", "off", "code"]
    firsts = windows.groupBy(*kind).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    firsts = firsts.where("least < most").select(*kind, "least")
    others = windows.join(firsts, kind).where("least < doc")
    others = others.select("anchor", "block", F.col("off").alias("start"), (F.col("off") + window).alias("end"))
    return matched.unionByName(others)


def _spans(docs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """(doc, tie, start, end): stretches of words that go, in pieces that overlap."""
    seeds = scratch.table(_seeds(docs, window, gram))
    hubs = seeds.groupBy("anchor").agg(F.min("doc").alias("hub"), F.max("doc").alias("most"))
    hubs = hubs.where("hub < most").select("anchor", "hub")
    shared = scratch.table(seeds.join(hubs, "anchor"))
    at = F.min(F.struct("doc", "tie", "pos", "first", "end")).alias("at")
    classes = shared.groupBy("anchor", "block").agg(at, F.first("hub").alias("hub"))
    classes = scratch.table(classes)

    # Only anchors with a class that begins beyond the hub's document need a closer look.
    is_open = F.col("at.doc") > F.col("hub")
    looked_at = classes.groupBy("anchor").agg(
        F.max(is_open).alias("any_open"), F.min(F.struct("at", "block")).alias("hub_class")
    )
    looked_at = looked_at.where("any_open").select("anchor", F.col("hub_class.block").alias("hub_block"))
    wanted = classes.join(looked_at, "anchor")
    wanted = wanted.select("anchor", "block", (F.col("block") == F.col("hub_block")).alias("is_hub"), "at.*")
    texts = docs.groupBy("doc", "tie").agg(F.first("text").alias("text"))
    contexts = scratch.table(_contexts(texts, wanted))
    extended = scratch.table(_extended(contexts, window))
    repeats = scratch.table(_class_repeats(extended, window))

    first_of = classes.select("anchor", "block", F.col("at.doc").alias("first_doc"))
    marked = shared.where("doc > hub").join(first_of, ["anchor", "block"])
    whole = marked.where("first_doc < doc").select("doc", "tie", F.col("first").alias("start"), "end")
    opened = marked.where("first_doc = doc").select("anchor", "block", "doc", "tie", "pos")
    parts = opened.join(repeats, ["anchor", "block"]).select(
        "doc", "tie", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end")
    )
    return whole.unionByName(parts)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The maximal stretches of overlapping or touching ones."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` plus `n_words`, `n_removed`, `kept` (the words left, joined by one space) and
    `removed` (start and end of each maximal repeat, in words).

    Ids are integers; a null id counts as smaller than all others. Rows with one id never remove
    from each other, and equal rows stay equal rows. A null or empty text has no words and keeps
    none; texts under `window` words keep all. Long texts are read whole. Further columns stay as
    they are; those with one of the new names are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept", "removed")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("doc")
    tie = F.xxhash64("text").alias("tie")
    with Scratch(docs.sparkSession, "substrings") as scratch:
        keyed = docs.select(doc_id, tie, "text").where(F.col("text").isNotNull())
        spans = _spans(keyed, window, gram, scratch)
        # A row that is repeated gives its stretches again; the set holds each once.
        lists = spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        lists = written(lists, "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, texts, removed = [], [], [], []
            for text, spans in zip(batch["row"].field("text"), batch["spans"], strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                pairs = spans.as_py() or []
                stretches = merged([p["start"] for p in pairs], [p["end"] for p in pairs])
                left, end = [], 0
                for start, stop in stretches:
                    left += words[end:start]
                    end = stop
                left += words[end:]
                counts.append(len(words))
                gone.append(len(words) - len(left))
                texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                removed.append([{"start": a, "end": b} for a, b in stretches])
            yield pa.record_batch(
                [
                    batch["row"],
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["row", "n_words", "n_removed", "kept", "removed"],
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id, tie)
    rows = rows.join(lists, ["doc", "tie"], "left").select("row", "spans")
    new = "n_words long, n_removed long, kept string, removed array<struct<start: int, end: int>>"
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(new)])
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    return rows.mapInArrow(cut, schema).select(*names, "n_words", "n_removed", "kept", "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
        F.size("removed").cast("long").alias("n_repeats"),
    )
