"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import SPACES, fresh, stored
from slotwise.llm.cuckoo import CuckooFilter
from slotwise.session import sized

_KEY = ["k1", "k2"]
_REFS = "k1 long, k2 long, doc_id long"


def line_key(line: str, min_chars: int) -> bytes | None:
    """16 bytes for a line of at least ``min_chars`` once stripped, else None."""
    line = line.strip(SPACES)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (key, doc_id) of the lines of ``docs``; rows without id have none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                own = {line_key(x, min_chars) for x in text.split("\n")} - {None}
                keys += own
                ids += [doc_id] * len(own)
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"k1": pair[:, 0], "k2": pair[:, 1], "doc_id": np.array(ids, np.int64)})

    long = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
    return long.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, _REFS).distinct()


class _Layers:
    """A table of which little is written when little changes: of the rows with one key the newest layer's counts.

    Layers are stored tables; a row that is ``dead`` takes the key out. A layer
    that is not at most half of the one before is merged with it, so there are few
    layers, and a row is written again only as often as the table doubles.
    """

    def __init__(self, spark: SparkSession, keys: list[str], schema: str):
        self.keys, self.empty = keys, spark.createDataFrame([], f"{schema}, dead boolean")
        self.layers: list[tuple[DataFrame, int]] = []
        self.written = 0

    def put(self, rows: DataFrame, what: str, most: int | None = None) -> DataFrame:
        """Adds ``rows``, ``most`` of them, as the newest layer and returns them as stored."""
        if "dead" not in rows.columns:
            rows = rows.withColumn("dead", F.lit(False))
        rows = stored(rows.select(*self.empty.columns), what, most=most)
        n = rows.count()
        self.written += n
        if n:
            self.layers.append((rows, n))
        while len(self.layers) > 1 and self.layers[-2][1] < 2 * self.layers[-1][1]:
            merged = self._newest([x for x, _ in self.layers[-2:]])
            if len(self.layers) == 2:  # nothing older to take out
                merged = merged.filter("NOT dead")
            merged = stored(merged, what)
            n = merged.count()
            self.written += n
            self.layers[-2:] = [(merged, n)] if n else []
        return rows

    def view(self, only: DataFrame | None = None) -> DataFrame:
        """The rows that count; with ``only``, those that have a row in it by its columns, which are key columns."""
        layers = [x for x, _ in self.layers] or [self.empty]
        if only is not None:
            layers = [x.join(only, only.columns, "left_semi").select(*self.empty.columns) for x in layers]
        return self._newest(layers).filter("NOT dead").drop("dead")

    def _newest(self, layers: list[DataFrame]) -> DataFrame:
        if len(layers) == 1:
            return layers[0]
        rows = layers[0].withColumn("at", F.lit(0))
        for i, layer in enumerate(layers[1:], 1):
            rows = rows.unionByName(layer.withColumn("at", F.lit(i)))
        values = [c for c in self.empty.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "at").alias("newest"))
        return newest.select(*self.keys, "newest.*")


class LineIndex:
    """Which keys are in which documents, and which are repeated.

    ``refs`` has a row per key and document, ``counts`` the number of documents
    and the largest id per key (``n``, ``largest``), ``filters`` a cuckoo filter
    per shard over the keys in at least ``min_docs`` documents. All three are
    layered tables in the shared folder. ``insert`` and ``delete`` read the index
    but write only what concerns keys of the given documents, and move the keys
    that cross ``min_docs`` into or out of the filters of their shards. Shards
    double when they hold more than ``shard_rows`` references on average, and halve
    at an eighth of that, down to ``shards``. Deleting what was inserted gives the
    counts from before.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, shards: int = 8, shard_rows: int = 500_000):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.least, self.shards, self.shard_rows, self.size = shards, shards, shard_rows, 0
        self._refs = _Layers(spark, [*_KEY, "doc_id"], _REFS)
        self._counts = _Layers(spark, _KEY, "k1 long, k2 long, n long, largest long")
        self._filters = _Layers(spark, ["shard"], "shard int, data binary")

    @property
    def refs(self) -> DataFrame:
        return self._refs.view()

    @property
    def counts(self) -> DataFrame:
        return self._counts.view()

    @property
    def filters(self) -> DataFrame:
        return self._filters.view()

    @property
    def written(self) -> int:
        """Rows of references and counts written so far."""
        return self._refs.written + self._counts.written

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")

    def _counted(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))

    def insert(self, docs: DataFrame) -> None:
        """Documents whose id is in the index already add the lines they lack."""
        new = references(docs, self.min_chars)
        if self._refs.layers:
            new = stored(new, "line-new")
            new = new.join(self._refs.view(new), [*_KEY, "doc_id"], "left_anti")
        new = self._refs.put(new, "line-refs")
        most = new.count()
        self.size += most
        old, added = self._old(new, most), self._counted(new)
        now = added if old is None else old.unionByName(added).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
        self._changed(old, self._counts.put(now, "line-counts", most))

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents whose ``doc_id`` is in ``ids``."""
        if not self._refs.layers:
            return
        ids = ids.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()
        gone = self._refs.put(self._refs.view(ids).withColumn("dead", F.lit(True)), "line-gone")
        most = gone.count()
        self.size -= most
        touched, old = gone.select(*_KEY).distinct(), self._old(gone, most)
        left = touched.join(self._counted(self._refs.view(touched)), _KEY, "left").withColumn("dead", F.col("n").isNull())
        self._changed(old, self._counts.put(left, "line-counts", most))

    def _old(self, refs: DataFrame, most: int) -> DataFrame | None:
        """The counts, before they change, of the keys of ``refs``, which has ``most`` rows; None for an index without any."""
        return stored(self._counts.view(refs.select(*_KEY).distinct()), "line-old", most=most) if self._counts.layers else None

    def _changed(self, old: DataFrame | None, now: DataFrame) -> None:
        """Brings the filters to the counts: ``old`` and ``now`` are those of the keys that changed."""
        shards = self.shards
        while self.size > self.shards * self.shard_rows:
            self.shards *= 2
        while self.shards >= 2 * self.least and 8 * self.size < self.shards * self.shard_rows:
            self.shards //= 2
        if old is None or shards != self.shards:
            self._filters = _Layers(self.spark, ["shard"], "shard int, data binary")
            self._filters.put(self._built(self._repeated()), "line-filters")
            return
        was, now = (x.filter(F.col("n") >= self.min_docs).select(*_KEY) for x in (old, now.filter("NOT dead")))
        moves = now.join(was, _KEY, "left_anti").withColumn("add", F.lit(True)).unionByName(
            was.join(now, _KEY, "left_anti").withColumn("add", F.lit(False)))
        moves = stored(moves.select(self._shard(), "k1", "add"), "line-moves")

        def update(key: tuple, filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            held = CuckooFilter.load(filters["data"][0]) if len(filters) else CuckooFilter.for_keys(np.array([], np.int64))
            held.remove(keys["k1"][~keys["add"].astype(bool)].to_numpy(np.int64))
            room = held.add(keys["k1"][keys["add"].astype(bool)].to_numpy(np.int64))
            return pd.DataFrame({"shard": [key[0]], "data": [held.dump() if room else None]})

        touched = self._filters.view(moves.select("shard").distinct())
        after = stored(touched.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard int, data binary"), "line-updated")
        full = after.filter(F.col("data").isNull()).select("shard")
        again = self._built(self._repeated().withColumn("shard", self._shard()).join(full, "shard", "left_semi"))
        self._filters.put(after.filter(F.col("data").isNotNull()).unionByName(again), "line-filters")

    def _repeated(self) -> DataFrame:
        return self.counts.filter(F.col("n") >= self.min_docs)

    def _built(self, repeated: DataFrame) -> DataFrame:
        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "data": [CuckooFilter.for_keys(keys["k1"].to_numpy(np.int64)).dump()]})

        return repeated.select(self._shard(), "k1").groupBy("shard").applyInPandas(build, "shard int, data binary")

    def drops(self, group_rows: int = 65_536) -> DataFrame:
        """(doc_id, keys): the line keys that each document loses.

        References meet their shard's filter in groups of a shard and a salt of
        the document. A shard has as many salts as its references, a line of a
        third of all documents among them, need for groups of about ``group_rows``;
        only what the filter lets through goes to the join with the exact counts.
        """
        def probe(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(rows):
                return rows[["k1", "k2", "doc_id"]].iloc[:0]
            return rows[CuckooFilter.load(filters["data"].iloc[0]).has(rows["k1"].to_numpy(np.int64))][["k1", "k2", "doc_id"]]

        salts = F.ceil(F.sum("n") / group_rows).cast("long").alias("salts")
        spread = sized(self.counts.groupBy(self._shard()).agg(salts).coalesce(self.shards // 100 + 1))
        salted = self.refs.withColumn("shard", self._shard()).join(spread, "shard").select(
            *_KEY, "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"))
        filters = self.filters.join(spread, "shard").select(
            "shard", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        through = salted.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(probe, _REFS)
        return through.join(self._repeated(), _KEY).filter(F.col("doc_id") != F.col("largest")).groupBy("doc_id").agg(
            F.collect_list(F.struct(*_KEY)).alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its text cleaned, and n_lines, n_dropped (new columns replace old ones of the name)."""
        own, lost = fresh(docs, "own_id"), fresh(docs, "lost_keys")
        drops = self.drops().select(F.col("doc_id").alias(own), F.col("keys").alias(lost))
        joined = docs.drop("n_lines", "n_dropped").join(drops, F.col("doc_id") == F.col(own), "left").drop(own)
        names, min_chars = docs.drop("n_lines", "n_dropped").columns, self.min_chars
        kept = joined.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # other columns pass through untouched
                texts, lines, dropped = [], [], []
                for text, keys in zip(batch.column("text").to_pylist(), batch.column(lost).to_pylist()):
                    have = ("" if text is None else text).split("\n")
                    lines.append(len(have))
                    if keys is None:
                        texts.append(text)
                        dropped.append(0)
                        continue
                    gone = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys}
                    stay = [x for x in have if line_key(x, min_chars) not in gone]
                    texts.append("\n".join(stay))
                    dropped.append(len(have) - len(stay))
                new = {"text": pa.array(texts, batch.schema.field("text").type)}
                columns = [new[c] if c in new else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        return joined.mapInArrow(run, kept)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with repeated lines cut, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased. Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose all their lines except in the largest doc_id
    holding it. A null text is one empty line and stays null. Rows of one doc_id
    are one document; a row without id keeps its lines and counts for none. Rows
    that repeat lose the same lines, other columns pass through (but for the two
    new names), and an empty table gives no rows.
    """
    index = LineIndex(docs.sparkSession, min_chars, min_docs)
    index.insert(docs)
    return index.apply(docs)


def line_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    cleaned = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, pos)),
r AS (SELECT k, max(doc_id) AS largest FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, r.k IS NOT NULL AND doc_id <> largest AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
