"""Documents to a tokenised training corpus, in stages that each write their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemart.llm import language, line_dedup, mixing, ngram_join, pieces
from pagemart.llm.common import documents, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null lang becomes the language found.

    Learns from the labelled documents themselves. Texts that are null, have no letter or lie
    too far from every centroid go. Equal rows are judged alike; an empty table stays empty.
    """
    found = language.predict(docs, language.fit(docs))
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return found.where(~F.col("rejected")).select([lang if c == "lang" else c for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; those that lose every line go.

    Null and empty texts lose nothing and stay. Equal rows are one document and stay equal rows.
    """
    found = line_dedup.deduplicated(docs)
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_token_lines"))
    size = F.length("text").cast("long").alias("n_chars")
    return found.where(left).select([size if c == "n_chars" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links connect.

    Documents without words, nulls among them, are linked with nothing and stay; of equal rows
    one stays. An empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources as often as the weight of the source asks.

    A repeated document is a row again, equal rows each by itself. A null source is a source.
    Documents without words belong to no pass and go. An empty table stays empty.
    """
    return mixing.mixed_documents(docs, keep_all=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, scores, round_trip) of every document.

    A null or empty text has no pieces; repeated rows are encoded each. Of equally good ways the
    first by ids leads. An empty table stays empty.
    """
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    ids = F.col("ways")[0]["ids"]
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size(ids).cast("long").alias("n_pieces"),
        ids.alias("ids"),
        F.transform("ways", lambda w: F.round(w["score"], 6)).alias("scores"),
        "round_trip",
    )


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The stages cluster, hash and search in ways SQL cannot express; tests compare each with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each on the written table of the one before."""
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
