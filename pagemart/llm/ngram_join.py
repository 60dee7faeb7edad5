"""N-gram Jaccard join by parity sketches, and the groups of documents it links.

A document's set is its distinct shingles. Two sets with a Jaccard index of at least 3/4 and
sizes s and t differ in at most (s + t) / 7 elements. Hashing deals the elements into parts;
the parity sketch of a part is the XOR of its elements' codes, so an element in which two sets
differ changes one part, and sets that differ in d elements agree in all parts but d.

Pigeonhole: order the parts of each set by one common order; if all but d of them agree, two
sets agree in one of their first d + 1 parts. The order puts parts with many elements first,
counting only elements that are not frequent in the corpus, and empty parts last: what
documents agree in by chance or by a shared passage is then hardly ever among the keys. The
frequencies steer the order only, which is the same for all documents, so no link depends on
them. Sets are joined within bands of sizes (powers of two); a set that may have a larger
partner in the next band has keys there as well.

Equal sets are one class from the start. Candidates are pairs of classes with an equal key,
filtered by size and by the Hamming distance of parity sketches (a lower bound of the number of
differing elements) of two to four bits per element, and verified on whole sets. In each
group of classes with one key, only as many candidates are verified as would connect the
group; what they leave unconnected is tried again without the pairs that were refuted, until
no candidate is open between two components. A group of n near copies so costs about n pairs,
and the components are those of all links.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import WORD, documents, written
from pagemart.llm.components import components
from pagemart.llm.hashing import mixed, word_hashes
from pagemart.plans.lookup import lookup_join

WIDTH = 5
#: Fixed by the contract: linked if 100 * intersection >= 75 * union.
PERCENT = 75
#: Shingle counts are kept in so many counters, by hash.
COUNTERS = 16_384
COUNTER_SLICES = 16
#: Sketches have a power of two of 64-bit words, so many at least.
SKETCH_WORDS = 8
#: Sets of one or two elements can only be linked to equal ones.
SMALLEST = 3
#: About so many keys meet in one task.
KEYS_PER_SHARD = 1_500_000
#: About so many members of groups meet in one task.
MEMBERS_PER_TASK = 300_000
#: Texts whose keys are dealt out together.
SLICE_WORDS = 1_000_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Fewer words than the width are one shingle; no words are none.
    """
    words, counts = word_hashes(texts)
    grams = words.copy()
    for n in range(1, width):
        tail = len(words) - n
        if tail > 0:
            grams[:tail] = mixed(grams[:tail] * np.uint64(0xA0761D6478BD642F) + words[n:], n)
    begin = 0
    for count in counts:
        end = begin + count
        if count >= width:
            yield np.unique(grams[begin : end - width + 1])
        elif count:
            short = words[begin : begin + 1]
            for n in range(1, count):
                short = mixed(short * np.uint64(0xA0761D6478BD642F) + words[begin + n], n)
            yield mixed(short, 100 + int(count))
        else:
            yield np.zeros(0, np.uint64)
        begin = end


def set_class(shingles: np.ndarray) -> int:
    """A number that equal sets share (as a signed 64-bit number)."""
    code = mixed(shingles, 17).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([code], np.uint64), 18).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch: each element flips one bit of two to four times as many bits.

    A sketch of half the length is the XOR of its halves, so sketches of any length compare.
    """
    bits = max(64 * SKETCH_WORDS, 4 << (len(shingles).bit_length() - 1)) if len(shingles) else 64 * SKETCH_WORDS
    place = mixed(shingles, 19) & np.uint64(bits - 1)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def counter(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles, 20) % np.uint64(COUNTERS)).astype(np.int64)


def part_keys(shingles: np.ndarray, band: int, frequent: np.ndarray) -> np.ndarray:
    """The keys of a set in a band: its first parts by the common order.

    The band holds sets of 2**band to 2**(band + 1) - 1 elements and has 2**band parts. Two
    linked sets of the band differ in at most a third of either one's elements.
    """
    parts = 1 << band
    count = len(shingles) // 3 + 1
    code = mixed(shingles, 21)
    part = (code % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    parity = np.bitwise_xor.reduceat(mixed(shingles, 22)[order], starts)
    rare = np.add.reduceat(~frequent[counter(shingles)][order], starts, dtype=np.int64)
    sizes = np.diff(np.concatenate([starts, [len(shingles)]]))
    numbers = ordered[starts]
    keys = _key(parity, numbers, sizes, rare, band)
    # Few parts decide, so whole sorting keys are cheap: rare elements, all elements, hash.
    first = np.lexsort((keys, -sizes, -rare))[:count]
    found = keys[first]
    if len(found) < count:
        # Too few elements or too unevenly spread: empty parts follow, in the order of hashes.
        empty = np.setdiff1d(np.arange(parts), numbers)
        none = np.zeros(len(empty), np.int64)
        keys = np.sort(_key(none.astype(np.uint64), empty, none, none, band))
        found = np.concatenate([found, keys[: count - len(found)]])
    return found


def _key(parity: np.ndarray, part: np.ndarray, sizes: np.ndarray, rare: np.ndarray, band: int) -> np.ndarray:
    place = part.astype(np.uint64) * np.uint64(64) + np.uint64(band)
    shape = sizes.astype(np.uint64) * np.uint64(1 << 32) + rare.astype(np.uint64)
    return mixed(parity ^ mixed(place, 23) ^ mixed(shape, 24), 25)


def bands(size: int) -> list[int]:
    """The bands in which a set of this size has keys."""
    if size < SMALLEST:
        return []
    own = size.bit_length() - 1
    largest_partner = 100 * size // PERCENT
    return [own, own + 1] if largest_partner >= 1 << (own + 1) else [own]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, cls, sketch) per document; rows with a part hold counters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            rows, seen = [], []
            for shingles in shingle_sets(batch["text"], width):
                seen.append(counter(shingles))
                if len(shingles):
                    rows.append((len(shingles), set_class(shingles), sketch(shingles).tolist()))
                else:
                    rows.append((0, None, None))
            if seen:
                counts += np.bincount(np.concatenate(seen), minlength=COUNTERS)
            n, cls, bits = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [
                    pa.array(np.full(len(rows), -1), pa.int32()),
                    batch["doc_id"],
                    batch["text_key"],
                    pa.array(n, pa.int64()),
                    pa.array(cls, pa.int64()),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                names,
            )
        parts = counts.reshape(COUNTER_SLICES, -1)
        none = pa.nulls(COUNTER_SLICES, pa.int64())
        yield pa.record_batch(
            [
                pa.array(range(COUNTER_SLICES), pa.int32()),
                pa.nulls(COUNTER_SLICES, ids),
                none,
                none,
                none,
                pa.array(parts.tolist(), pa.list_(pa.int64())),
            ],
            names,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["part", "doc_id", "text_key", "n", "cls", "numbers"]
    field = docs.schema["doc_id"]
    ids = to_arrow_type(field.dataType)
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            field,
            *T.StructType.fromDDL("text_key long, n long, cls long, numbers array<long>"),
        ]
    )
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return written(keyed.mapInArrow(read, schema), "shingle-sets")


def _frequent(sets: DataFrame) -> np.ndarray:
    """Which counters stand far above the mean: COUNTERS numbers come to the driver."""
    each = sets.where("part >= 0").select("part", F.posexplode("numbers").alias("place", "n"))
    rows = each.groupBy("part", "place").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(COUNTERS)
    size = COUNTERS // COUNTER_SLICES
    for row in rows:
        counts[row["part"] * size + row["place"]] = row["n"]
    return counts > counts.mean() + 8 * np.sqrt(counts.mean()) + 32


def _candidates(docs: DataFrame, frequent: np.ndarray, shards: int, width: int) -> DataFrame:
    """Groups of classes with an equal key: (members array<long>), each group once per shard."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        own = Slice(shards)
        for batch in batches:
            for shingles in shingle_sets(batch["text"], width):
                cls = set_class(shingles) if len(shingles) >= SMALLEST else None
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                keys = [part_keys(shingles, band, shared.value) for band in bands(len(shingles))]
                own.add(cls, np.concatenate(keys), len(shingles))
                if own.is_full():
                    yield own.dealt()
                    own = Slice(shards)
        if own.classes:
            yield own.dealt()

    def match(table: pa.Table) -> pa.Table:
        keys, classes = gathered(table.to_pylist())
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[new], classes[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        groups = {
            classes[s : s + n].tobytes() for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True)
        }
        lists = [np.frombuffer(g, np.int64) for g in groups]
        return pa.table({"members": pa.array(lists, pa.list_(pa.int64()))})

    schema = "shard int, high binary, low binary, owners binary, classes binary"
    dealt = docs.select("text").mapInArrow(deal, schema)
    return dealt.groupBy("shard").applyInArrow(match, "members array<long>")


class Slice:
    """Keys of some documents, dealt out to shards by the upper bits of the key.

    A shard gets the 48 bits below those that chose it, and the place of the owner in the list
    of the classes that have a key there: at most eight bytes a key, however many shards. With so many keys to a shard, equal bits of
    different keys are rare, and cost a candidate when they happen.
    """

    def __init__(self, shards: int):
        self.shards = shards
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.classes: list[int] = []
        self.held = 0

    def add(self, cls: int, keys: np.ndarray, size: int) -> None:
        self.keys.append(keys)
        self.owners.append(np.full(len(keys), len(self.classes), np.uint16))
        self.classes.append(cls)
        self.held += size

    def is_full(self) -> bool:
        return self.held > SLICE_WORDS or len(self.classes) == 1 << 16

    def dealt(self) -> pa.RecordBatch:
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        # The shard is the whole part of key * shards / 2**64, the rest its 48 upper bits.
        upper = (keys >> np.uint64(32)) * np.uint64(self.shards)
        whole = upper + (((keys & np.uint64(0xFFFFFFFF)) * np.uint64(self.shards)) >> np.uint64(32))
        shard = (whole >> np.uint64(32)).astype(np.int64)
        rest = ((keys * np.uint64(self.shards)) >> np.uint64(16)).astype(np.uint64)
        order = np.lexsort((rest, shard))
        shard, rest, owners = shard[order], rest[order], owners[order]
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        classes = np.array(self.classes, np.int64)
        rows = []
        for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                # Only the classes that own one of these keys.
                present, owner = np.unique(owners[a:b], return_inverse=True)
                rows.append(
                    (
                        number,
                        (rest[a:b] >> np.uint64(16)).astype(np.uint32).tobytes(),
                        (rest[a:b] & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
                        owner.astype(np.uint16).tobytes(),
                        classes[present].tobytes(),
                    )
                )
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]]
        return pa.record_batch(arrays, ["shard", "high", "low", "owners", "classes"])


def gathered(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The keys (48 bits) and classes of the dealt rows of one shard."""
    keys, classes = [], []
    for row in rows:
        high = np.frombuffer(row["high"], np.uint32).astype(np.uint64)
        keys.append((high << np.uint64(16)) | np.frombuffer(row["low"], np.uint16))
        owned = np.frombuffer(row["classes"], np.int64)
        classes.append(owned[np.frombuffer(row["owners"], np.uint16)])
    return np.concatenate(keys), np.concatenate(classes)


class Sketches:
    """The sketches of one group, folded to each of the lengths that occur."""

    def __init__(self, sketches: list[np.ndarray]):
        self.words = np.array([len(s) for s in sketches])
        self.at = {
            words: np.array([folded(s, words) if len(s) >= words else np.zeros(words, np.int64) for s in sketches])
            for words in set(self.words.tolist())
        }

    def flips(self, own: int, others: np.ndarray) -> np.ndarray:
        """The Hamming distance of one sketch and others, each at the shorter of both lengths."""
        words = np.minimum(self.words[own], self.words[others])
        found = np.zeros(len(others), np.int64)
        for length in set(words.tolist()):
            here = words == length
            differing = self.at[length][others[here]] ^ self.at[length][own]
            found[here] = np.bitwise_count(differing.view(np.uint64)).sum(axis=1, dtype=np.int64)
        return found


def near_pairs(
    classes: np.ndarray,
    labels: np.ndarray,
    sizes: np.ndarray,
    sketches: Sketches,
    refuted: set[tuple[int, int]],
    tries: int = 1,
) -> list[tuple[int, int]]:
    """Pairs that could be links and would connect the labels of one group as far as possible.

    `classes` is sorted. From the first label outwards, what has been reached is held against
    what has not: a pair counts if sizes and sketches leave it open and it is not refuted. Each
    label is reached by `tries` pairs at most, so there are fewer pairs than that per label.
    """
    found = []
    waiting = np.arange(len(classes))
    while len(waiting):
        first = labels[waiting[0]]
        front = deque(waiting[labels[waiting] == first])
        waiting = waiting[labels[waiting] != first]
        count: Counter = Counter()
        while front and len(waiting):
            own = front.popleft()
            both = sizes[own] + sizes[waiting]
            small = np.minimum(sizes[own], sizes[waiting]) * 100
            fits = small >= np.maximum(sizes[own], sizes[waiting]) * PERCENT
            fits &= sketches.flips(own, waiting) <= both * (100 - PERCENT) // (100 + PERCENT)
            done = []
            for other in waiting[fits]:
                label = labels[other]
                pair = (int(min(classes[own], classes[other])), int(max(classes[own], classes[other])))
                if count[label] >= tries or label == labels[own] or pair in refuted:
                    continue
                found.append(pair)
                count[label] += 1
                if count[label] == 1:
                    front += waiting[labels[waiting] == label].tolist()
                if count[label] == tries:
                    done.append(label)
            if done:
                waiting = waiting[~np.isin(labels[waiting], done)]
        waiting = waiting[~np.isin(labels[waiting], list(count))]
    return found


def _members(groups: DataFrame) -> DataFrame:
    """(group, cls) of every member of every group."""
    each = groups.select(F.xxhash64("members").alias("group"), F.explode("members").alias("cls"))
    return each.distinct()


def _open_pairs(
    members: DataFrame, classes: DataFrame, labels: DataFrame | None, refuted: DataFrame | None, tries: int
) -> DataFrame:
    """(group, a, b, n_a, n_b): pairs to verify next, from groups with several labels."""
    each = members
    if labels is None:
        each = each.withColumn("label", F.col("cls"))
    else:
        each = each.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left")
        each = each.withColumn("label", F.coalesce("label", "cls"))
        several = each.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y"))
        each = each.join(several.where("x < y").select("group"), "group", "left_semi")
    shards = max(1, -(-members.count() // MEMBERS_PER_TASK))
    shard = F.pmod("group", F.lit(shards)).cast("int")
    dealt = written(each.withColumn("shard", shard), "open-members")
    # Sketches and refuted partners go to a shard once, however many groups a class is in.
    known = dealt.select("shard", "cls").distinct().join(classes.select("cls", "n", "numbers"), "cls")
    if refuted is not None:
        partners = refuted.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("bad"))
        known = known.join(partners, "cls", "left")
    else:
        known = known.withColumn("bad", F.lit(None).cast("array<bigint>"))

    known = known.select(
        F.col("shard").alias("of"), F.col("cls").alias("own"), "n", "numbers", "bad"
    )

    def connect(groups: pa.Table, known: pa.Table) -> pa.Table:
        groups = groups.sort_by([("group", "ascending"), ("cls", "ascending")])
        known = known.sort_by("own")
        every = known["own"].to_numpy()
        size = known["n"].to_numpy()
        numbers = known["numbers"].combine_chunks()
        cuts, flat = numbers.offsets.to_numpy(), numbers.values.to_numpy()
        bad = known["bad"].to_pylist()
        group, cls, label = (groups[c].to_numpy() for c in ("group", "cls", "label"))
        place = np.searchsorted(every, cls)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        pairs: list[tuple[int, int, int, int, int]] = []
        for start, end in zip(starts, [*starts[1:], len(group)], strict=True):
            at = place[start:end]
            sketches = Sketches([flat[cuts[i] : cuts[i + 1]] for i in at])
            no = {(int(every[i]), b) for i in at for b in bad[i] or ()}
            near = near_pairs(cls[start:end], label[start:end], size[at], sketches, no, tries)
            own = dict(zip(cls[start:end].tolist(), size[at].tolist(), strict=True))
            pairs += [(int(group[start]), a, b, own[a], own[b]) for a, b in near]
        columns = [pa.array([p[i] for p in pairs], pa.int64()) for i in range(5)]
        return pa.table(columns, ["group", "a", "b", "n_a", "n_b"])

    schema = "group long, a long, b long, n_a long, n_b long"
    return dealt.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(connect, schema)


def _whole_sets(needed: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the needed classes, from one row of each: its text is the set."""
    rows = needed.join(classes.select("cls", "row"), "cls").select("row.*").toDF("_id", "_key")
    texts = docs.withColumn("_text_key", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    chosen = texts.join(rows, same, "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_class(s), s.view(np.int64)) for s in shingle_sets(batch["text"], width)]
            cls, sets = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch(
                [pa.array(cls, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"]
            )

    sets = chosen.select("text").mapInArrow(read, "cls long, shingles array<long>")
    return sets.dropDuplicates(["cls"])


def _linked_pairs(
    near: DataFrame, classes: DataFrame, docs: DataFrame, width: int, known: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(a, b, linked) for every pair, and the sets read so far.

    Texts are read again only for classes whose set is not known yet.
    """
    needed = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    if known is not None:
        needed = needed.join(known.select("cls"), "cls", "left_anti")
    needed = written(needed, "needed-classes")
    sets = known
    if known is None or not needed.isEmpty():
        found = written(_whole_sets(needed, classes, docs, width), "shingles")
        sets = found if known is None else known.unionByName(found)
    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    linked = F.col("shared") * 100 >= union * PERCENT
    return both.select("a", "b", linked.alias("linked")), sets


def _components(groups: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, label) of all classes in links.

    Rounds of pairs that would connect the groups, each verified, until no group has an open
    pair between two labels. A group without one never has one again and is left behind; in
    what remains, each round tries eight times as many pairs per label.
    """
    members = written(_members(groups), "group-members")
    nothing = docs.sparkSession.createDataFrame([], "node long, label long")
    labels = refuted = sets = links = None
    tries = 1
    while True:
        found = written(_open_pairs(members, classes, labels, refuted, tries), "open-pairs")
        near = written(found.drop("group").distinct(), "near-pairs")
        if near.isEmpty():
            return nothing if labels is None else labels
        verdicts, sets = _linked_pairs(near, classes, docs, width, sets)
        verdicts = written(verdicts, "verdicts")
        new, bad = verdicts.where("linked").select("a", "b"), verdicts.where("NOT linked").select("a", "b")
        refuted = bad if refuted is None else refuted.unionByName(bad)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        open_groups = found.select("group").distinct()
        members = written(members.join(open_groups, "group", "left_semi"), "group-members")
        tries *= 8


def linked(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, n, label, component_id) of every row.

    `label` is the same for all rows that links connect, and null for an empty set; `text_key`
    is a hash of the text. The rest is as in `link_documents`.
    """
    docs = docs.select("doc_id", "text")
    sets = _sets(docs, width)
    rows = sets.where("part < 0").drop("part")
    first = rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"),
        F.min(F.struct("doc_id", "text_key")).alias("row"),
        F.min("n").alias("n"),
        F.first("numbers").alias("numbers"),
    )
    classes = written(first, "classes")
    words = classes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(words * 0.5) // KEYS_PER_SHARD))
    groups = written(_candidates(docs, _frequent(sets), shards, width), "groups").distinct()
    labels = _components(groups, classes, docs, width)
    labelled = classes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left")
    labelled = labelled.select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = written(labelled.join(smallest, "label").drop("doc_id"), "components")
    found = lookup_join(rows.select("doc_id", "text_key", "n", "cls"), by_class, "cls", max_rows=0)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_key", "n", "label", own.alias("component_id"))


def link_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    The component is the smallest doc_id that links reach, itself included. A null text, or
    one without words, has an empty set and is linked with nothing; its component is its own
    doc_id. Rows with equal texts are linked, repeated rows too. A null doc_id is no candidate
    for the smallest. Further columns are ignored; an empty table gives no rows.
    """
    found = linked(docs, width)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with one row of each group of linked rows: the first by (doc_id, text hash).

    Rows without words, null texts among them, are linked with nothing and all stay. Of equal
    rows one stays; texts are read whole. Further columns stay as they are, whatever their
    names. An empty table gives no rows.
    """
    found = linked(docs, width).where("n > 0")
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    first = written(first.select("row.*").toDF("first_id", "first_key"), "survivors")
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.where(~wordless).select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    same = keyed["id"].eqNullSafe(F.col("first_id")) & (keyed["key"] == F.col("first_key"))
    kept = keyed.join(first, same, "left_semi")
    # A row may be repeated as a whole: its copies have equal keys.
    again = Window.partitionBy("id", "key").orderBy(F.lit(0))
    kept = kept.withColumn("nth", F.row_number().over(again)).where("nth = 1")
    return kept.select("row.*").unionByName(docs.where(wordless))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))
