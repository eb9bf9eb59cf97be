"""Benchmark decontamination by windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import FILE_ROWS, ascii_lower, fresh
from slotwise.session import cut

#: A word in a text of either case. Java's regex looks single characters of a class up in
#: a table but tries ranges one by one at every character, which took over ten times as long.
_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"

#: A hash set of test windows is broadcast up to this many; beyond it, hashes are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def _windows(df: DataFrame, m: int, *keep: str) -> DataFrame:
    """A row per window of m words: ``keep``, its place (from 0), hash and words."""
    places = F.when(F.size("words") >= m, F.sequence(F.lit(0), F.size("words") - m)).otherwise(F.array().cast("array<int>"))
    window = F.slice("words", F.col("pos") + 1, F.lit(m))
    return df.select(*keep, "words", F.explode(places).alias("pos")).select(
        *keep, "words", "pos", F.xxhash64(window).alias("hash"), window.alias("window"))


def test_windows(benchmark: DataFrame, length: int) -> tuple[DataFrame, list[int]]:
    """Distinct windows of all items (hash, m, window, item_ids), written once, and their lengths.

    An item of fewer than ``length`` words, but not none, is one window.
    """
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sizes = words.groupBy(F.least(F.size("words"), F.lit(length)).alias("m")).agg(F.sum(F.size("words")).alias("n")).orderBy("m").collect()
    lengths, most = [r["m"] for r in sizes], sum(r["n"] for r in sizes)  # at most ``length`` numbers; no more windows than words
    parts = None
    for m in lengths:
        own = F.size("words") >= length if m == length else F.size("words") == m
        part = _windows(words.filter(own), m, "item_id").select("item_id", "hash", F.lit(m).alias("m"), "window")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return None, []
    found = parts.groupBy("hash", "m", "window").agg(F.collect_set("item_id").alias("item_ids"))
    return cut(found.coalesce(most // FILE_ROWS + 1)), lengths


def window_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10,
                broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame | None:
    """Occurrences of test windows: doc_id, text_hash, pos, m, item_ids; None without any window.

    Every window of a document is hashed and looked up in the broadcast set, and
    every hit is compared word by word.
    """
    windows, lengths = test_windows(benchmark, length)
    if windows is None:
        return None
    windows = windows.select(F.col("hash").alias("key"), F.col("m").alias("size"), "window", "item_ids")
    if windows.count() <= broadcast_windows:
        windows = F.broadcast(windows)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    windows = windows.withColumnRenamed("window", "test_window")
    hits = None
    for m in lengths:
        at = _windows(base, m, "doc_id", "text_hash")
        # Not written as an equality, which would make the words a join key and build them for every row.
        here = F.coalesce("window", F.array().cast("array<string>"))  # never null; a bare column would be tested for it first
        verified = (here <= F.col("test_window")) & (here >= F.col("test_window"))
        same = (F.col("hash") == F.col("key")) & (F.col("size") == m) & verified
        part = at.join(windows, same).select("doc_id", "text_hash", "pos", F.lit(m).alias("m"), "item_ids")
        hits = part if hits is None else hits.unionByName(part)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_hash.

    ``spans`` are the maximal hit runs (first word, words). Null and empty texts
    have no words and no hits, and so has any text when the benchmark is empty.
    Repeated rows each get the same result; rows of one doc_id with different
    texts are judged on their own text. A null doc_id is an id like any other.
    Test items without id hit words but are not listed.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(
        F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    hits = window_hits(docs, benchmark, length, broadcast_windows)
    if hits is None:
        rows = rows.withColumns({
            "runs": F.expr("array(struct(cast(0 as int) first, cast(0 as int) n))").cast("array<struct<first:int,n:int>>"),
            "items": F.array().cast("array<string>")}).withColumn("runs", F.slice("runs", 1, 0))
    else:
        none = F.array().cast("array<struct<first:int,n:int>>")
        run = lambda first, n: F.struct(first.alias("first"), n.alias("n"))
        found = hits.groupBy("doc_id", "text_hash").agg(
            F.sort_array(F.collect_set(F.struct("pos", "m"))).alias("at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("item_ids", lambda i: i.cast("string")))))).alias("items"))
        # Open run and finished ones; positions come in order.
        start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("end"), none.alias("done"))
        merged = F.aggregate("at", start, lambda a, x: F.when(
            (x["pos"] <= a["end"]) & (a["first"] >= 0),
            F.struct(a["first"].alias("first"), F.greatest(a["end"], x["pos"] + x["m"]).alias("end"), a["done"].alias("done")),
        ).otherwise(F.struct(
            x["pos"].alias("first"), (x["pos"] + x["m"]).alias("end"),
            F.when(a["first"] < 0, a["done"]).otherwise(
                F.concat(a["done"], F.array(run(a["first"], a["end"] - a["first"])))).alias("done"))),
            lambda a: F.concat(a["done"], F.array(run(a["first"], a["end"] - a["first"]))))
        found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_text"), merged.alias("runs"), "items")
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_text")), "left")
    n_hit = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"]), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.col("runs").alias("spans"), "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a test window, with all columns."""
    hits = window_hits(docs, benchmark, length)
    if hits is None:
        return docs
    bad = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["hit_id"]) & (F.xxhash64(docs["text"]) == bad["hit_text"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` with every hit run of words cut out of its text, and what stands between those words."""
    runs = fresh(docs, "hit_runs")
    spans = contamination(docs.select("doc_id", "text"), benchmark, length).filter("contaminated").select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_text"), F.col("spans").alias(runs)).dropDuplicates(["hit_id", "hit_text"])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["hit_id"]) & (F.xxhash64(docs["text"]) == spans["hit_text"]), "left").select(
        *[docs[c] for c in docs.columns], spans[runs])
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    gaps = F.split("text", _WORD, -1)  # one more than words
    def hit(i: Column) -> Column:
        return F.exists(runs, lambda s: (i >= s["first"]) & (i < s["first"] + s["n"]))
    kept = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(words, lambda w, i: F.when(
        hit(i), F.when(hit(i + 1), F.lit("")).otherwise(F.element_at(gaps, i + 2))).otherwise(
        F.concat(w, F.element_at(gaps, i + 2)))), ""))
    return joined.withColumn("text", F.when(F.col(runs).isNotNull(), kept).otherwise(F.col("text"))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(p) WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM i),
t AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win FROM d, m, unnest(generate_series(1, len(w) - m + 1)) AS u(p)),
h AS (SELECT DISTINCT t.doc_id, t.p, t.m, i.item_id FROM t JOIN i ON t.m = i.m AND t.win = i.win),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, m FROM h), unnest(generate_series(p, p + m - 1)) AS u(q) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
