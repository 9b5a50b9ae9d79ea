"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import chat, embeddings, html, license, minhash, mixing, pieces, quality, search, sharding, spelling, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_html_extraction": html.op3_html_extraction,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_minhash": minhash.op9_minhash,
    "op10_license_scan": license.op10_license_scan,
    "op11_spelling": spelling.op11_spelling,
    "op12_substrings": substrings.op12_substrings,
    "op13_search": search.op13_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op7_embedding_dedup": embeddings.ORACLE_SQL,
    "op9_minhash": minhash.ORACLE_SQL,
    "op12_substrings": substrings.ORACLE_SQL,
    "op13_search": search.ORACLE_SQL,
}
