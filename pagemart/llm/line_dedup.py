"""Line deduplication by an exact set-similarity join of token sets.

A line's set is its distinct words. Two lines match if the Jaccard index of their sets is at
least 4/5. A line goes if an earlier line of the corpus matches it, kept or not, where lines
are ordered by document and then by place.

Words are ordered by rarity. A word that one of two sets lacks parts at most two pairs of words
that follow each other in the order, one word put in parts one. So two matching sets share a
pair among the first few pairs of each (see `n_pairs`). Pairs of rare words are far more telling
than words: their groups hardly grow with the corpus. The sizes of the sets (length filter) and
64 parity bits, whose Hamming distance is at most the number of words in which two sets differ,
rule out most of what is left, and the prefixes of two sets (see `prefixes_agree`) nearly all of
the rest; what remains is verified on whole sets. Equal sets are one class
from the start, so copies, however many, are never paired.

Pairs are counted in ROUNDS parts, and only those of two classes or more go on. Where there are
just two, the count itself tells which. A class goes as a whole if an earlier class matches it, so
one match is all that need be known. Of larger groups, first each class is held against an early
class of each pair that more than HEAVY classes have; members of a family of near copies are
settled by that. Only the others are held against all classes that share a pair. All candidates
are verified together. Settled classes whose candidates were all refuted are sought again against
all, so no match is lost.

Everything is a column expression. Rarity comes from word counts over the whole corpus, kept
in COUNTERS counters by hash. They decide only the order, which is the same for all lines, so
their size costs time but no match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemart.llm.common import SPACES, WORD, Tables, documents, let, written
from pagemart.plans.lookup import is_small

PERCENT = 80
COUNTERS = 1 << 16
#: Steps of rarity to each doubling of a count.
STEPS = 2
#: Parts of the word pairs that are counted one after the other, to bound the shuffle.
ROUNDS = 3
#: A word pair is heavy if more classes have it.
HEAVY = 32
#: So many word pairs, or texts to read again, may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SET = ("cls", "size", "odd")


def line_words(line: Column) -> Column:
    """The words of a line and, where spaces meet or end it, empty ones."""
    # Most lines have only blanks; to split at a blank is cheaper than by a pattern.
    other = reduce(Column.__or__, [line.contains(c) for c in "\t\r\x0b\x0c"])
    return F.when(other, F.split(line, SPACES)).otherwise(F.split(line, " "))


def word_hashes(line: Column) -> Column:
    """A 64-bit hash of each distinct word of a line."""
    hashes = F.array_distinct(F.transform(line_words(line), lambda w: F.xxhash64(w)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def rarity_levels(docs: DataFrame) -> list[int]:
    """The level of each counter, higher for more frequent words.

    The driver receives COUNTERS counts, whatever the size of the corpus.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    each = lines.select(F.explode(line_words(F.col("line"))).alias("word"))
    slot = F.xxhash64("word").bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    counts = each.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    level = F.floor(F.log2("n") * STEPS).cast("int")
    levels = [0] * COUNTERS
    for row in counts.select("slot", level.alias("level")).collect():
        levels[row["slot"]] = row["level"]
    return levels


def token_codes(line: Column, levels: list[int]) -> Column:
    """The distinct words of a line as numbers, the rarest first: level, then hash."""
    # Constant folding makes this one array in the plan.
    table = F.split(F.lit(",".join(str(level << 56) for level in levels)), ",").cast("array<bigint>")

    def code(hash: Column) -> Column:
        # Never null, which the type tells only this way; arrays without nulls are sorted faster.
        level = F.coalesce(F.get(table, hash.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")), F.lit(0).cast("long"))
        return level.bitwiseOR(F.shiftrightunsigned(hash, 8))

    return F.sort_array(F.transform(word_hashes(line), code))


def parity(codes: Column) -> Column:
    """64 parity bits, one of which each code flips."""

    def flip(bits: Column, code: Column) -> Column:
        # Of the number of places, shiftleft takes the last six bits.
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(code)))

    def place(code: Column) -> Column:
        return code.bitwiseAND(F.lit(63)).cast("int")

    return F.aggregate(codes, F.lit(0).cast("long"), flip)


def n_pairs(size: Column) -> Column:
    """How many of its first pairs a set of so many words is found by; 0 if only equal sets match it.

    For PERCENT = 80. Let a matching set lack k of the words, at most size / 5, and have m further
    ones. The union is at most 5/4 of what is shared, so m <= (size - 5 * k) / 4. Pairs lost are
    2 * k + m at most, and that grows with k. The first pair left is the first one left in the
    other set too.
    """
    lost = F.floor((size + 3 * F.floor(size / 5)) / 4).cast("int")
    return F.when(size < 4, 0).otherwise(lost + 1)


def _ceil_share(total: Column, numerator: int, denominator: int) -> Column:
    return F.floor((total * numerator + (denominator - 1)) / denominator).cast("int")


def line_sets(docs: DataFrame, levels: list[int]) -> DataFrame:
    """(doc_id, tie, no, size, cls, odd, prefix) of every line.

    `tie` tells rows with equal doc_ids apart, `cls` is the same for equal sets, `prefix` has
    the words, as short numbers, whose pairs of neighbours a set is found by. Lines without words
    have the size 0.
    """
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("tie"),
        F.posexplode(F.split("text", "\n")).alias("no", "line"),
    )
    sets = lines.select("doc_id", "tie", "no", token_codes(F.col("line"), levels).alias("codes"))
    size = F.size("codes")
    found = sets.select(
        "doc_id",
        "tie",
        "no",
        size.alias("size"),
        F.xxhash64("codes").alias("cls"),
        parity(F.col("codes")).alias("odd"),
        F.transform(F.slice("codes", 1, n_pairs(size) + 1), lambda c: F.hash(c)).alias("prefix"),
    )
    return found


def line_classes(lines: DataFrame) -> DataFrame:
    """(cls, first, n, size, odd, prefix): each set once, with the place of its first line."""
    return lines.groupBy("cls").agg(
        F.min(F.struct("doc_id", "tie", "no")).alias("first"),
        F.count("*").alias("n"),
        F.first("size").alias("size"),
        F.first("odd").alias("odd"),
        F.first("prefix").alias("prefix"),
    )


def _needed() -> Column:
    """How many words two sets of size_a and size_b words share at least if they match."""
    return _ceil_share(F.col("size_a") + F.col("size_b"), PERCENT, 100 + PERCENT)


def _could_match() -> Column:
    """Whether sizes and parity bits leave a pair (a, b) open."""
    lengths = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * PERCENT
    differing = F.col("size_a") + F.col("size_b") - 2 * _needed()
    near = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= differing
    return (F.col("cls_a") != F.col("cls_b")) & lengths & near


def _pair_rows(classes: DataFrame, part: int) -> DataFrame:
    """A row per class and pair of neighbours in its prefix, for one part of the pairs.

    `pair` is both words as one number, `at` the document of the class's first line.
    """
    at = F.coalesce(F.col("first.doc_id").cast("long"), F.lit(-(1 << 63))).alias("at")
    rows = classes.where(n_pairs(F.col("size")) > 0)
    rows = rows.select(*_SET, at, "prefix", F.posexplode("prefix").alias("i", "one"))
    # Other parts go before their second word is looked up.
    rows = rows.where((F.pmod("one", F.lit(ROUNDS)) == part) & (F.col("i") < F.size("prefix") - 1))
    upper = F.call_function("shiftleft", F.col("one").cast("long"), F.lit(32))
    following = F.get("prefix", F.col("i") + 1).cast("long")
    pair = upper.bitwiseOR(following.bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.select(pair.alias("pair"), *_SET, "at")


def shared_pairs(classes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Where two classes share a word pair alone, and where more do.

    The first is (a, b), one row per such pair; the second (pair, n, cls, size, odd, at), a row
    per class and pair that n > 2 rows have.
    """
    twos, members = [], []
    for part in range(ROUNDS):
        # Aggregates of plain numbers; a pair of one class goes no further.
        ends = (F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b"))
        shared = tables.table(_pair_rows(classes, part).groupBy("pair").agg(*ends).where("a <> b"))
        twos.append(shared.where("n = 2").select("a", "b"))
        more = shared.where("n > 2").select("pair", "n")
        if is_small(more, BROADCAST_ROWS):
            more = F.broadcast(more)
        members.append(tables.table(_pair_rows(classes, part).join(more, "pair").select("pair", "n", *_SET, "at")))
    return reduce(DataFrame.unionByName, twos), reduce(DataFrame.unionByName, members)


def _hub_candidates(members: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """(a, b): b may match a, an early class of a word pair that more than HEAVY classes have."""
    heavy = members.where(F.col("n") > HEAVY)
    # Aggregates of plain numbers, which need no sort.
    hubs = heavy.groupBy("pair").agg(*[F.min_by(c, "at").alias(f"{c}_a") for c in _SET])
    found = _side(heavy, "b").join(hubs, "pair").where(_could_match())
    found = tables.table(found.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct())
    return _in_order(found, classes)


def _in_order(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of which a is the earlier; `pairs` is a table."""
    small = is_small(pairs, BROADCAST_ROWS)
    for side in "ab":
        of = classes.select(F.col("cls").alias(side), F.col("first").alias(f"first_{side}"))
        pairs = (F.broadcast(pairs) if small else pairs).join(of, side)
    return pairs.where(F.col("first_a") < F.col("first_b")).select("a", "b")


def _open(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits leave open."""
    for side in "ab":
        of = classes.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in _SET])
        pairs = pairs.join(of, side)
    return pairs.where(_could_match()).select("a", "b")


def _side(members: DataFrame, side: str) -> DataFrame:
    return members.select("pair", *[F.col(c).alias(f"{c}_{side}") for c in _SET])


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b), a < b: classes of both sides that share a word pair and may match, each two once."""
    both = left.join(right, "pair").where(_could_match())
    return both.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def prefixes_agree() -> Column:
    """Whether the prefixes of a pair (a, b) leave it open.

    Of two prefixes let the one of a end no later in the order of words. Its words that b has are
    then in the prefix of b; those that b lacks are size_a less the shared words at most. Equal
    short numbers count once on both sides (`own`), so they rule out no match.
    """

    def least(side: str) -> Column:
        return F.col(f"own_{side}") - (F.col(f"size_{side}") - _needed())

    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return shared >= F.least(least("a"), least("b"))


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _agreeing(pairs: DataFrame, classes: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) that the prefixes leave open; a prefix is a fraction of a set."""
    own = F.size(F.array_distinct("prefix")).alias("own")
    of = tables.table(_classes_of(pairs).join(classes.select("cls", "size", own, "prefix"), "cls"))
    for side in "ab":
        pairs = pairs.join(of.toDF(side, *[f"{c}_{side}" for c in ("size", "own", "prefix")]), side)
    return tables.table(pairs.where(prefixes_agree()).select("a", "b"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """(cls) that match an earlier class in one of the pairs (a, b), whichever of them is earlier.

    Pairs whose prefixes differ too much go first, before any set is made. The sets come from the
    texts of the first lines; texts without such lines are not split, and not shuffled either
    where the places of the lines can be broadcast.
    """
    pairs = _agreeing(pairs, classes, tables)
    places = _classes_of(pairs).join(classes.select("cls", "first.*"), "cls")
    places = places.select(F.struct("doc_id", "tie").alias("key"), "cls", "no")
    places = tables.table(places.groupBy("key").agg(F.collect_list(F.struct("cls", "no")).alias("wanted")))
    if is_small(places, BROADCAST_ROWS):
        places = F.broadcast(places)
    texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("key"), "text")
    found = texts.join(places, "key").select("key", F.split("text", "\n").alias("lines"), "wanted")
    found = found.select(
        "key",
        F.explode(
            F.transform(
                "wanted",
                lambda w: F.struct(w["cls"].alias("cls"), w["no"].alias("no"), F.get("lines", w["no"]).alias("line")),
            )
        ).alias("of"),
    )
    first = F.struct("key.doc_id", "key.tie", "of.no").alias("first")
    sets = found.select("of.cls", first, word_hashes(F.col("of.line")).alias("words"))
    # Rows that are equal give their lines once each.
    sets = sets.groupBy("cls").agg(F.first("first").alias("first"), F.first("words").alias("words"))
    sets = tables.table(sets)
    both = pairs.join(sets.toDF("a", "first_a", "words_a"), "a").join(sets.toDF("b", "first_b", "words_b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    total = F.size("words_a") + F.size("words_b")
    match = let(shared, lambda k: k * 100 >= (total - k) * PERCENT)
    later = F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a"))
    return both.where(match).select(later.alias("cls")).distinct()


def repeated_classes(classes: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """(cls) of the classes that match an earlier one; see above for the steps."""
    twos, members = shared_pairs(classes, tables)
    by_hub = tables.table(_hub_candidates(members, classes, tables))
    settled = tables.table(by_hub.select(F.col("b").alias("cls")).distinct())
    everyone = _side(members, "a")
    few = is_small(settled, BROADCAST_ROWS)
    open_ones = _side(members.join(F.broadcast(settled) if few else settled, "cls", "left_anti"), "b")
    ordered = by_hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _open(twos.distinct(), classes).unionByName(_candidates(open_ones, everyone)).unionByName(ordered)
    pairs = tables.table(found.distinct())
    repeated = tables.table(_verified(pairs, classes, docs, tables))

    # A refuted hub may have kept a class from being held against all others.
    refuted = tables.table(settled.join(repeated, "cls", "left_anti"))
    if refuted.isEmpty():
        return repeated
    again = tables.table(members.join(F.broadcast(refuted) if few else refuted, "cls"))
    # Only pairs that these classes have are worth a shuffle of the others.
    asked = tables.table(again.select("pair").distinct())
    others = everyone.join(F.broadcast(asked) if is_small(asked, BROADCAST_ROWS) else asked, "pair", "left_semi")
    again = _candidates(_side(again, "b"), others)
    again = tables.table(again.join(pairs, ["a", "b"], "left_anti"))
    return repeated.unionByName(_verified(again, classes, docs, tables))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, removed): per document that loses any, the numbers (from 0) of its lines to go.

    Documents are ordered by (doc_id, hash of the text), null ids first; rows that are equal
    in both are one document and get one row here. Lines without words always stay. Further
    columns are ignored. The tables it takes are removed; the result is a table of its own.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    with Tables(docs.sparkSession, "lines") as tables:
        with Tables(docs.sparkSession, "line-sets") as wide:
            sets = wide.table(line_sets(docs, rarity_levels(docs))).where("size > 0")
            classes = tables.table(line_classes(sets))
            lines = tables.table(sets.select("doc_id", "tie", "no", "cls"))
        repeated = tables.table(repeated_classes(classes, docs, tables))
        # All lines of a repeated class go, and all but the first of any other.
        whole = repeated.withColumn("whole", F.lit(True))
        touched = classes.select("cls", "first", "n").join(whole, "cls", "left").where("n > 1 OR whole")
        each = lines.select("doc_id", "tie", "no", "cls").join(touched, "cls")
        each = each.where(F.col("whole") | (F.struct("doc_id", "tie", "no") > F.col("first")))
        gone = each.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("no")).alias("removed"))
        return written(gone, "repeated-lines")


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` without repeated lines, plus `n_token_lines` and `n_removed`.

    A text that loses nothing stays as it is, a null one too. Equal rows stay equal rows. Long
    texts and lines are read whole. An empty table gives no rows. Columns of `docs` with the new
    names are replaced; all others stay as they are, whatever their names.
    """
    docs = docs.drop("n_token_lines", "n_removed")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_tie"),
    )
    found = repeated_lines(docs)
    # Measured, as an estimate from files would have whole texts shuffled at far smaller sizes.
    if is_small(found, BROADCAST_ROWS):
        found = F.broadcast(found)
    same = rows["_id"].eqNullSafe(found["doc_id"]) & (rows["_tie"] == found["tie"])
    both = rows.join(found, same, "left")
    lines = F.split("row.text", "\n")

    def without(all_lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(all_lines) - 1)
        stay = F.array_except(numbers, F.col("removed"))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    text = F.when(F.size("removed") > 0, let(lines, without)).otherwise(F.col("row.text"))
    counted = F.size(F.filter(lines, lambda line: line.rlike(WORD)))
    return both.select(
        *[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns],
        F.coalesce(counted, F.lit(0)).cast("long").alias("n_token_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_token_lines", "n_removed", "text")
