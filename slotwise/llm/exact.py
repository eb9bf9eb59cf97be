"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import ascii_lower


def exact_dedup(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Three stages, each grouping by the whole text and not only its digest:
    partial aggregation keeps one row per text and map task; the groups of a
    digest and salt are merged; the winners of the salts are merged. A text that
    a third of all rows share thus reaches the last stage as ``salts`` rows.
    Rows then look their group up by digest, which carries no text; a digest that
    held two texts would stop the query instead of joining them.

    The row with the largest id stays. Null ids lose to any other; a group of
    null ids only has a null keep_id and keeps those rows. Rows that repeat the
    winning id and text are the same document and are all ``kept``; group_size
    counts rows. An empty table gives an empty result; other columns are ignored.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("content")).withColumn(
        "text_sha256", F.sha2("content", 256))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("text_sha256", "content", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = merged.groupBy("text_sha256", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = winners.groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"),
    ).select(
        "text_sha256", "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("one digest, two texts")).cast("long")).alias("group_size"))
    return base.select("doc_id", "text_sha256").join(by_digest, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one per id and text."""
    kept = exact_dedup(docs, **options).filter("kept").select("doc_id", "text_sha256").dropDuplicates()
    digest = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]) & (digest == kept["text_sha256"]), "left_semi")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
