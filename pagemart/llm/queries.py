"""The queries of the subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pagemart.llm import (
    backoff,
    language,
    lexical,
    line_dedup,
    mixing,
    ngram_join,
    oracle,
    pieces,
    pii,
    quality,
    sharding,
    substrings,
    whitening,
    winnowing,
)

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_winnowing": winnowing.query,
    "op3_ngram_join": ngram_join.query,
    "op4_line_dedup": line_dedup.query,
    "op5_backoff_lm": backoff.query,
    "op6_language_id": language.query,
    "op7_mixing": mixing.query,
    "op8_pii": pii.query,
    "op9_sharding": sharding.query,
    "op10_sentencepiece": pieces.query,
    "op11_whitening": whitening.query,
    "op12_substring_dedup": substrings.query,
    "op13_lexical_search": lexical.query,
}

ORACLES: dict[str, str] = {
    "op3_ngram_join": oracle.NGRAM_JOIN,
    "op4_line_dedup": oracle.LINE_DEDUP,
    "op12_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op13_lexical_search": oracle.LEXICAL_SEARCH,
}
