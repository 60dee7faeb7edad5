"""Document fingerprints by winnowing.

Tokens are hashed; hashes of k-grams are composed from those of their halves, so a k-gram
costs no more than a pair (k is a power of two). Of every window of w successive k-grams the
smallest hash is kept, the rightmost of equals, with its place. Two texts that share a run of
w + k - 1 tokens therefore share a mark; runs shorter than k tokens never match.

Tokens are words. Of a longer run without spaces every MAX_TOKEN successive characters are a
token, from each character on, so texts without spaces share marks at any offset. Everything
is an array expression within one row.

The edited text of a document ends with the beginning of the next document's. Documents come
to their neighbours by one sort in ranges of doc_id: a range takes in a copy of the first row
of the next one, and no task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from pagemart.llm.common import documents, let, tail, written

GRAM = 4
WINDOW = 8
#: Characters of a token at most; a power of two.
MAX_TOKEN = 16
TOKEN = rf"[^\x20\x09-\x0D]{{1,{MAX_TOKEN}}}"
LONG_RUN = rf"[^\x20\x09-\x0D]{{{MAX_TOKEN + 1}}}"
#: Ranges of doc_id at most; the driver gets their borders and no more.
MAX_RANGES = 100_000
ROWS_PER_RANGE = 2000


def _composed(values: Column, length: int, step) -> Column:
    """`step` folded over each `length` successive values (a power of two), by doubling.

    Places whose run would reach beyond the end hold what is left of it.
    """

    def doubled(values: Column, reach: int) -> Column:
        return let(values, lambda v: F.zip_with(v, tail(v, reach + 1), step))

    reach = 1
    while reach < length:
        values = doubled(values, reach)
        reach *= 2
    return values


def _every_piece(run: Column) -> Column:
    """A hash of every MAX_TOKEN successive characters of a run that has so many."""
    chars = F.transform(F.split(run, ""), lambda c: F.xxhash64(c))
    pieces = _composed(chars, MAX_TOKEN, lambda a, b: F.xxhash64(a, b))
    return let(pieces, lambda p: F.slice(p, 1, F.size(p) - (MAX_TOKEN - 1)))


def token_hashes(text: Column, slide: bool = False) -> Column:
    """A 64-bit hash of every token.

    With `slide` a longer run has a token from each character on, so its tokens do not depend
    on where it begins; without, it is cut into pieces from its start.
    """
    text = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    if not slide:
        return hashes
    runs = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    each = F.transform(
        runs,
        lambda r: F.when(F.length(r) > MAX_TOKEN, _every_piece(r)).otherwise(F.array(F.xxhash64(r))),
    )
    return F.when(text.rlike(LONG_RUN), F.flatten(each)).otherwise(hashes)


def gram_hashes(text: Column, gram: int = GRAM, slide: bool = False) -> Column:
    """A 64-bit hash of every run of `gram` tokens; of all tokens if there are fewer."""
    hashes = token_hashes(text, slide)
    grams = _composed(hashes, gram, lambda a, b: F.xxhash64(a, b))

    def whole(found: Column) -> Column:
        count = F.greatest(F.size(found) - (gram - 1), F.lit(1))
        return F.slice(found, 1, F.least(F.size(found), count))

    return let(grams, whole)


def marks(grams: Column, window: int = WINDOW) -> Column:
    """The kept hashes with their places (from 0), by place: array<struct<hash, place>>.

    A hash is packed with its place into one number: rounded down to a multiple of the gram
    count, plus the distance to the end. The smallest number of a window then is the smallest
    hash, the rightmost of equals, and says where it is. A text with fewer grams than a window
    is one window.
    """

    def of(grams: Column) -> Column:
        count = F.size(grams).cast("long")
        packed = F.transform(
            grams,
            lambda h, i: F.shiftrightunsigned(h, 1)
            - F.pmod(F.shiftrightunsigned(h, 1), count)
            + (count - 1 - i),
        )
        # least() skips nulls, so windows at the end are shorter; they are cut off.
        least = _composed(packed, window, lambda a, b: F.least(a, b))
        whole = F.greatest(count - (window - 1), F.lit(1)).cast("int")
        kept = let(least, lambda m: F.array_distinct(F.slice(m, 1, F.least(whole, F.size(m)))))
        places = F.sort_array(F.transform(kept, lambda p: count - 1 - F.pmod(p, count)))
        return F.transform(
            places,
            lambda p: F.struct(F.get(grams, p.cast("int")).alias("hash"), p.cast("int").alias("place")),
        )

    return let(grams, of)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW, slide: bool = False) -> Column:
    """The marks of a text: array<struct<hash, place>>; empty for a null or empty text."""
    return marks(gram_hashes(text, gram, slide), window)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of the hashes of two fingerprints; two empty ones are alike."""
    both = F.array(F.array_distinct(a["hash"]), F.array_distinct(b["hash"]))

    def of(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair[0], pair[1]))
        union = F.size(pair[0]) + F.size(pair[1]) - shared
        return F.when(union == 0, 1.0).otherwise(shared / union)

    return let(both, of)


def fingerprint(found: Column) -> Column:
    """A digest of marks and places: equal texts have equal ones."""
    parts = F.transform(found, lambda m: F.concat_ws(":", F.hex(m["hash"]), m["place"].cast("string")))
    return F.sha2(F.array_join(parts, ","), 256)


def range_number(value: Column, borders: list, kind: str) -> Column:
    """How many of the sorted borders are at or below the value; 0 for null.

    Found in two steps, a group of borders and then a place in it, so that the work grows with
    the square root of their number.
    """
    if not borders:
        return F.lit(0)
    size = math.isqrt(len(borders) - 1) + 1
    groups = [borders[i : i + size] for i in range(0, len(borders), size)]

    def lits(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")

    def below(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda b: b <= value))

    group = F.greatest(below(lits([g[0] for g in groups])) - 1, F.lit(0))
    found = let(group, lambda g: g * size + below(F.get(F.array(*map(lits, groups)), g)))
    return F.when(value.isNull(), 0).otherwise(found)


def in_order(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """`docs` in ranges of doc_id, and the window in which lead() finds the next row.

    The order is (doc_id, hash of the text), null ids first; equal rows follow each other. The
    first row of each range also stands at the end of the range before it, and that of the
    first range at the end of the last, as a guest (`_guest` 1) that the caller removes.
    """
    count = docs.count()
    ranges = min(MAX_RANGES, max(1, count // ROWS_PER_RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    borders = []
    if shares:
        found = docs.agg(F.percentile_approx("doc_id", shares, 10 * MAX_RANGES)).first()[0]
        borders = sorted(set(found or []))
    number = range_number(F.col("doc_id"), borders, docs.schema["doc_id"].dataType.simpleString())
    rows = docs.withColumns({"_tie": F.xxhash64("text"), "_range": number})

    # One row per range, MAX_RANGES at most.
    firsts = rows.groupBy("_range").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    by_range = Window.orderBy("_range")
    last_range = F.max("_range").over(Window.partitionBy())
    before = F.coalesce(F.lag("_range").over(by_range), last_range)
    firsts = firsts.select(F.col("_range").alias("_of"), "_first", before.alias("_before"))
    firsts = written(firsts, "range-firsts")
    is_first = (
        (F.col("_range") == F.col("_of"))
        & F.col("doc_id").eqNullSafe(F.col("_first.doc_id"))
        & (F.col("_tie") == F.col("_first._tie"))
    )
    guests = rows.join(F.broadcast(firsts), is_first).dropDuplicates(["_of"])
    guests = guests.withColumn("_range", F.col("_before")).select(*rows.columns, F.lit(1).alias("_guest"))
    both = rows.withColumn("_guest", F.lit(0)).unionByName(guests)
    return both, Window.partitionBy("_range").orderBy("_guest", "doc_id", "_tie")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter (rounded down) replaced by as many first characters
    of the next document, or all of them. A null text counts as empty; two empty fingerprints
    are alike. Repeated rows are each other's next. Further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows, place = in_order(docs.select("doc_id", text))
    rows = rows.withColumn("next_text", F.lead("text").over(place))
    length = F.length("text")
    quarter = F.floor(length / 4).cast("int")
    rows = rows.select(
        "doc_id",
        "_range",
        "_guest",
        "_tie",
        length.cast("long").alias("n_chars"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), length - quarter),
            F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter),
        ).alias("edited"),
        winnow(F.col("text"), gram, window, slide=True).alias("found"),
    )
    rows = rows.withColumn("next_found", F.lead("found").over(place)).where("_guest = 0")
    rows = rows.withColumn("edited_found", winnow(F.col("edited"), gram, window, slide=True))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "found",
        "edited_found",
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("found").cast("long").alias("n_marks"),
    )
