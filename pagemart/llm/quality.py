"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms per document, one of character classes and one of the language's commonest
words, are held against the language's own histograms over the whole corpus by the
Jensen-Shannon distance (base 2, so 0 to 1). Short documents have ragged histograms: below a
minimum length a distance does not count.

Everything is a column expression. The corpus is read twice: once to count the words of each
language, aggregated before the shuffle, and once for the counts and histograms of every
document, which need no shuffle. Class references and verdicts come from those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemart.llm.common import documents, let, tail, words, written
from pagemart.plans.lookup import is_small

#: Commonest words of a language that get a bin of their own; all others share one.
COMMON_WORDS = 32
#: A language needs so many words for a reference of its own.
MIN_REFERENCE_WORDS = 2000
#: Shorter documents are not held against the references.
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.5
#: A text without any of the common words lies at a distance that depends on how much they
#: cover in its language. The word limit is at most this share of that distance, for texts
#: in which so many common words are expected that their lack cannot be chance.
MAX_WORD_SHARE, MIN_EXPECTED = 0.95, 10

#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def window_hashes(hashes: Column, width: int = 3) -> Column:
    """A 64-bit hash of every window of `width` words, from the hashes of the words."""

    def of(hashes: Column) -> Column:
        found = hashes
        for step in range(2, width + 1):
            found = F.zip_with(found, tail(hashes, step), lambda a, b: F.xxhash64(a, b))
        return F.slice(found, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))

    return let(hashes, of)


def covered_by_repeats(windows: Column, width: int = 3) -> Column:
    """How many words lie in windows of `width` words that occur more than once.

    Each window hash is packed with its place into one number (hash rounded down to a multiple
    of the window count, plus the place), so that sorting plain numbers brings equal windows
    together; linear but for the sort.
    """

    def of(hashes: Column) -> Column:
        count = F.size(hashes).cast("long")
        packed = F.transform(
            hashes,
            lambda h, i: F.shiftrightunsigned(h, 1) - F.pmod(F.shiftrightunsigned(h, 1), count) + i,
        )

        def repeated(ordered: Column) -> Column:
            pairs = F.zip_with(
                ordered,
                tail(ordered, 2),
                lambda a, b: F.when(
                    a - a % count == b - b % count, F.array(a % count, b % count)
                ),
            )
            return F.flatten(F.filter(pairs, F.isnotnull))

        places = F.sort_array(F.array_distinct(let(F.sort_array(packed), repeated)))
        # least() skips the null after the last place, which so adds a whole window.
        steps = let(
            places, lambda p: F.zip_with(p, tail(p, 2), lambda a, b: F.least(F.lit(width), b - a))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    none_repeats = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none_repeats, F.lit(0).cast("long")).otherwise(let(windows, of))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def character_classes(text: Column, word_chars: Column) -> Column:
    """Counts of white space, capitals, digits, punctuation, other marks, non-ASCII small
    letters and the rest (ASCII small letters)."""
    found = [
        F.length(text) - word_chars,
        F.regexp_count(text, F.lit(r"\p{Lu}")),
        F.regexp_count(text, F.lit(r"\p{N}")),
        F.regexp_count(text, F.lit(r"[.,;:!?'\x22()-]")),
        F.regexp_count(text, F.lit(r"[#$%&*+/<=>@\[\\\]^_`{|}~]")),
        F.regexp_count(text, F.lit(r"[[^\x00-\x7F]&&[^\p{Lu}\p{N}]]")),
    ]
    none = F.lit(0).cast("long")

    def with_rest(counts: Column) -> Column:
        known = F.aggregate(counts, none, lambda total, c: total + c)
        return F.concat(counts, F.array(F.greatest(F.length(text) - known, none)))

    return let(F.array(*[c.cast("long") for c in found]), with_rest)


def word_bins(hashes: Column, common: Column) -> Column:
    """Counts of the words not in `common`, then of each of its COMMON_WORDS places.

    One tight loop over plain numbers per place, instead of a search for every word.
    """
    found = [
        F.size(hashes) - F.size(F.array_remove(hashes, F.get(common, F.lit(i))))
        for i in range(COMMON_WORDS)
    ]
    counts = F.array(*[F.coalesce(n, F.lit(0)).cast("long") for n in found])
    return let(counts, lambda c: F.concat(F.array(F.size(hashes) - _total(c)), c))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, c: total + c)


def _entropy(shares: Column) -> Column:
    terms = F.transform(shares, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return let(total, lambda n: F.transform(counts, lambda c: F.when(n > 0, c / n).otherwise(0.0)))


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """The distance (square root of the divergence in bits) of two histograms of equal bins."""
    both = F.array(_shares(counts), _shares(reference))

    def distance(pair: Column) -> Column:
        p, q = F.element_at(pair, 1), F.element_at(pair, 2)
        middle = F.zip_with(p, q, lambda a, b: (a + b) / 2)
        divergence = _entropy(middle) - (_entropy(p) + _entropy(q)) / 2
        return F.sqrt(F.greatest(divergence, F.lit(0.0)))

    return let(both, distance)


def without_common(bins: Column) -> tuple[Column, Column]:
    """(distance of a text without common words from a reference, share of common words in it)."""
    none = F.transform(bins, lambda _, i: F.when(i == 0, 1).otherwise(0).cast("long"))
    return jensen_shannon(none, bins), 1 - F.get(_shares(bins), F.lit(0))


def _split(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "lang", text.alias("text"), words(F.col("text")).alias("words"))
    return split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def common_words(docs: DataFrame) -> DataFrame:
    """Per language, and pooled with `pooled` true: (ref_lang, pooled, common, bins).

    `common` holds the hashes of the commonest words (ties by hash), `bins` the counts of all
    others and of each of them. Languages with few words have no row.
    """
    per_word = (
        _split(docs)
        .select("lang", F.explode("hashes").alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    per_word = written(per_word, "word-counts")

    def commonest(counts: DataFrame) -> DataFrame:
        # Spark applies row_number <= n before the shuffle as well: few rows per task remain.
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top = counts.withColumn("place", place).where(F.col("place") <= COMMON_WORDS)
        chosen = top.groupBy("lang").agg(
            F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top")
        )
        total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        counted = F.transform("top", lambda w: w["n"])
        return chosen.join(total, "lang").select(
            F.col("lang").alias("ref_lang"),
            "total",
            F.transform("top", lambda w: w["word"]).alias("common"),
            F.concat(F.array(F.col("total") - _total(counted)), counted).alias("bins"),
        )

    own = commonest(per_word.where(F.col("lang").isNotNull()))
    own = own.where(F.col("total") >= MIN_REFERENCE_WORDS)
    pooled = per_word.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(""))
    both = own.withColumn("pooled", F.lit(False)).unionByName(
        commonest(pooled).withColumn("pooled", F.lit(True))
    )
    return written(both.drop("total"), "common-words")


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """The counts and the two histograms of every document, as a table without texts.

    `ref_lang` is the language whose reference applies, null for the pooled one.
    """
    own = common.where(~F.col("pooled")).select("ref_lang", "common")
    pooled = common.where("pooled").select(F.col("common").alias("pooled_common"))
    # A row of some hundred bytes per language. Beyond the bounds of a broadcast it is a join by
    # language, of which Spark splits the frequent ones.
    own = F.broadcast(own) if is_small(own) else own
    found = (
        _split(docs)
        .join(own, F.col("lang") == F.col("ref_lang"), "left")
        .join(F.broadcast(pooled), F.lit(True), "left")
        .withColumns(
            {
                "common": F.coalesce("common", "pooled_common"),
                "windows": window_hashes(F.col("hashes")),
                "word_chars": F.length(F.array_join("words", "")).cast("long"),
            }
        )
    )
    return found.select(
        "doc_id",
        "ref_lang",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        covered_by_repeats(F.col("windows")).alias("n_repeat_words"),
        character_classes(F.col("text"), F.col("word_chars")).alias("own_classes"),
        word_bins(F.col("hashes"), F.col("common")).alias("own_bins"),
    )


def quality(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Counts, base verdict and verdict of every document.

    `max_word_distance` holds where a text without common words lies beyond it; elsewhere the
    limit is a share of that text's distance.
    A null or empty text has no words and fails the base rules. A null or rare `lang` is held
    against the pooled reference. Repeated rows each get their own equal row; a null doc_id is
    allowed, further columns are ignored, an empty table gives no rows.
    """
    common = common_words(docs)
    found = written(features(docs, common), "quality-features")
    classes = [F.sum(F.col("own_classes")[i]).alias(f"c{i}") for i in range(7)]
    sums = found.groupBy("ref_lang").agg(*classes)
    whole = [F.sum(f"c{i}").alias(f"c{i}") for i in range(7)]
    everything = sums.agg(*whole).withColumn("ref_lang", F.lit(None).cast("string"))
    # One row per language with a reference, and one for all documents together.
    sums = sums.where(F.col("ref_lang").isNotNull()).unionByName(everything)
    class_refs = sums.select(
        F.col("ref_lang").alias("class_lang"), F.array(*[f"c{i}" for i in range(7)]).alias("classes")
    )
    empty_distance, coverage = without_common(F.col("bins"))
    word_refs = common.select(
        F.when(~F.col("pooled"), F.col("ref_lang")).alias("word_lang"),
        "bins",
        F.least(F.lit(float(max_word_distance)), MAX_WORD_SHARE * empty_distance).alias("word_limit"),
        coverage.alias("coverage"),
    )
    found = found.join(F.broadcast(class_refs), F.col("ref_lang").eqNullSafe(F.col("class_lang")), "left")
    found = found.join(F.broadcast(word_refs), F.col("ref_lang").eqNullSafe(F.col("word_lang")), "left")
    # A reference with fewer words than places leaves the last bins of the document empty.
    own_bins = F.slice("own_bins", 1, F.size("bins"))
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    )
    measured = found.withColumns(
        {
            "base_failed": failed,
            "class_distance": F.when(
                F.col("n_chars") >= MIN_CHARS, jensen_shannon(F.col("own_classes"), F.col("classes"))
            ),
            "word_distance": F.when(
                F.col("n_words") >= MIN_WORDS, jensen_shannon(own_bins, F.col("bins"))
            ),
        }
    )
    word_limit = F.when(
        F.col("n_words") * F.col("coverage") >= MIN_EXPECTED, F.col("word_limit")
    ).otherwise(max_word_distance)
    near = F.coalesce(F.col("class_distance") <= max_class_distance, F.lit(True)) & F.coalesce(
        F.col("word_distance") <= word_limit, F.lit(True)
    )
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        F.round("class_distance", 9).alias("class_distance"),
        F.round("word_distance", 9).alias("word_distance"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
