"""The registered queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import (chat, decontaminate, exact, jaccard, langid, linededup, merkle, packing, pseudonyms, quality, repair,
                          substrings, webarchive)
from slotwise.llm.common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "label")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webarchive.archive_round_trip(table(spark, sf_dir, "pages")).drop("uri", "record_id", "refers_to_id", "payload")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's own control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(rows.unionByName(probe))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a key for tests, as everyone can read it here."""
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), key="key of the registered query")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048).drop("ids")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("spans", "text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


_QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_warc": op2_warc,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle": op11_merkle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": webarchive.SQL,
        "op3_chat_formatting": chat.SQL,
        "op6_line_dedup": linededup.SQL,
        "op7_decontamination": decontaminate.SQL,
        "op9_exact_dedup": exact.SQL,
        "op11_merkle": merkle.SQL,
        "op12_conversation_repair": repair.SQL,
    }
