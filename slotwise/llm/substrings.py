"""Removal of byte strings that occur more than once, by suffix arrays over shards of context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored
from slotwise.llm.suffixes import Suffixes

_GRAM = 64  # bytes of an anchor
_PLACE_BITS = 28
_PART = 1 << 26  # windows of a text handled at once
_DOC = ["doc_id", "text_hash"]


def _byte_marks() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(3):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x


_MARKS = _byte_marks()


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``_GRAM`` bytes from every place on, from halves."""
    h, k = _MARKS[data], 1
    with np.errstate(over="ignore"):
        while k < _GRAM:
            right = h[k:]
            h = (h[:-k] * np.uint64(0x9E3779B97F4A7C15)) ^ ((right << np.uint64(31)) | (right >> np.uint64(33)))
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            k *= 2
    return h


def contexts(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, bytes) of the contexts that the windows of ``length`` bytes fall into.

    A window's anchor is the gram with the smallest hash in it, the leftmost of
    equals; neighbouring windows with one anchor form a context. Equal windows
    have equal anchors at equal places, so they are in contexts of one hash.
    """
    whole = np.frombuffer(data, np.uint8)
    wide = length - _GRAM + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for start in range(0, len(whole) - length + 1, _PART):
        part = whole[start:start + _PART + length - 1]
        h = _grams(part)
        n = len(part) - length + 1
        least, k = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while k * 2 <= wide:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < wide:
            least = np.minimum(least[:n], least[wide - k:wide - k + n])
        anchor = (least[:n] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(first, n)) + length - 1
        yield h[anchor[first]], first + start, size


def _texts(docs: DataFrame) -> DataFrame:
    """Ids are text on their way through pandas, which has no exact numbers beside missing ones."""
    return docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("text_hash"), "text")


def _with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _context_rows(docs: DataFrame, length: int) -> DataFrame:
    """A row per context: document, anchor, digest of its bytes, place and bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                for anchor, first, size in contexts(data, length):
                    digests = b"".join(hashlib.blake2b(data[a:a + n], digest_size=8).digest()
                                       for a, n in zip(first.tolist(), size.tolist()))
                    out.append(pd.DataFrame({
                        "doc_id": [doc_id] * len(first), "text_hash": np.int64(text_hash),
                        "anchor": anchor.view(np.int64), "digest": np.frombuffer(digests, "<i8"), "first": first, "size": size}))
            if out:
                yield pd.concat(out, ignore_index=True)

    long = _texts(docs).filter(F.octet_length("text") >= length)
    return _with_ids(long.mapInPandas(run, "doc_id string, text_hash long, anchor long, digest long, first long, size int"))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for the joins; null where there is none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield batch.drop(columns="text").assign(packed=data)

    return _with_ids(_texts(docs).mapInPandas(run, "doc_id string, text_hash long, packed binary"))


def _join_documents(rows: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    other = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    same = rows["text_hash"].eqNullSafe(other["_hash"]) & rows["doc_id"].eqNullSafe(other["_id"])
    return rows.join(other, same, how).drop("_id", "_hash")


def _window_runs(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of window starts in the contexts that also start at another place of the same contexts."""
    found = Suffixes(rows["data"].tolist())
    starts = np.flatnonzero(found.repeated(length))
    if not len(starts):
        return pd.DataFrame({"anchor": [], "digest": [], "at": [], "n": []}).astype("int64")
    cut = np.concatenate([[True], np.diff(starts) > 1]) | (found.place[starts] == 0)
    begin = starts[cut]
    n = np.diff(np.append(np.flatnonzero(cut), len(starts)))
    who = found.owner[begin]
    return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[who], "digest": rows["digest"].to_numpy()[who],
                         "at": found.place[begin], "n": n})


_RUNS = "anchor long, digest long, at long, n long"


def _hot_runs(rows: DataFrame, length: int) -> DataFrame:
    """The same for contexts of anchors too frequent for a shard: windows are counted by 128-bit digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, digest, data in zip(batch["anchor"], batch["digest"], batch["data"]):
                n = len(data) - length + 1
                w = b"".join(hashlib.blake2b(data[i:i + length], digest_size=16).digest() for i in range(n))
                pair = np.frombuffer(w, "<i8").reshape(-1, 2)
                yield pd.DataFrame({"w1": pair[:, 0], "w2": pair[:, 1], "anchor": anchor, "digest": digest, "at": np.arange(n)})

    windows = stored(rows.mapInPandas(run, "w1 long, w2 long, anchor long, digest long, at long"), "hot-windows", "zstd")
    again = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return windows.join(again, ["w1", "w2"]).select("anchor", "digest", "at", F.lit(1).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, length: int = 200, shard_bytes: int = 1 << 18, hot_contexts: int = 4000) -> DataFrame:
    """(doc_id, text_hash, places): runs (at, n) of window starts whose ``length`` bytes start elsewhere too.

    1. Texts are cut into contexts by content (``contexts``). Counting contexts by
       anchor leaves those whose anchor occurs more than once; of a context that
       occurs more than once as a whole, all windows are repeated.
    2. Of anchors with different contexts, one copy of each context goes to a
       shard, dealt by anchor, so all places of a string that is in doubt meet in
       one suffix array. Shards hold about ``shard_bytes``.
    3. Anchors with more than ``hot_contexts`` different contexts are not put into
       one shard; digests of their windows are counted across all tasks instead.
    """
    spark = docs.sparkSession
    every = stored(_context_rows(docs, length), "contexts", "zstd")
    seen = every.groupBy("anchor").agg(
        F.count("*").alias("c"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("c > 1")
    # Written, so that the join has exchanges of its own and can split a frequent anchor.
    again = stored(seen.select(F.col("anchor").alias("_anchor"), (F.col("low") != F.col("high")).alias("mixed")), "anchors", "zstd")
    rows = stored(every.join(again, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "repeated-contexts", "zstd")

    place = F.struct("doc_id", "text_hash", "first", "size")
    kinds = stored(rows.filter("mixed").groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(place).alias("p")), "kinds", "zstd")
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("k"))
    hot = per_anchor.filter(F.col("k") > hot_contexts).select("anchor").withColumn("hot", F.lit(True))
    marked = kinds.join(hot, "anchor", "left").select("anchor", "digest", "p", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = marked.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("anchor", "digest", "p.first", "p.size", "hot")).alias("places"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for packed, places in zip(batch["packed"], batch["places"]):
                data = unpack.decompress(packed)
                for p in places:
                    out.append((p["anchor"], p["digest"], p["hot"], data[p["first"]:p["first"] + p["size"]]))
                    held += p["size"]
                if held > 16 << 20:
                    yield pd.DataFrame(out, columns=["anchor", "digest", "hot", "data"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["anchor", "digest", "hot", "data"])

    # Repeated rows are one document here; what they share is repeated as a whole already.
    once = _join_documents(_packed(docs), wanted, "inner").dropDuplicates(_DOC).select("packed", "places")
    pieces = stored(once.mapInPandas(cut_out, "anchor long, digest long, hot boolean, data binary"), "pieces", "zstd")
    total = pieces.filter("not hot").agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))

    def shard_runs(rows: pd.DataFrame) -> pd.DataFrame:
        return _window_runs(rows, length)

    runs = pieces.filter("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy(
        "shard").applyInPandas(shard_runs, _RUNS)
    if marked.filter("hot").limit(1).count():
        runs = runs.unionByName(_hot_runs(pieces.filter("hot").select("anchor", "digest", "data"), length))
    whole = kinds.filter("c > 1").select("anchor", "digest", F.lit(0).cast("long").alias("at"),
                                         (F.col("p.size") - length + 1).cast("long").alias("n"))
    partly = stored(runs.join(kinds.filter("c > 1"), ["anchor", "digest"], "left_anti").select("anchor", "digest", "at", "n")
                    .unionByName(whole), "runs", "zstd")
    plain = rows.filter("not mixed").select(*_DOC, F.col("first").alias("at"), (F.col("size") - length + 1).cast("long").alias("n"))
    mixed = rows.filter("mixed").select(*_DOC, "anchor", "digest", "first").join(partly, ["anchor", "digest"]).select(
        *_DOC, (F.col("first") + F.col("at")).alias("at"), "n")
    return plain.unionByName(mixed).groupBy(*_DOC).agg(F.collect_set(F.struct("at", "n")).alias("places"))


def remove_repeats(docs: DataFrame, length: int = 200, **options: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are UTF-8 bytes; every byte covered by a string of ``length`` bytes that
    also starts anywhere else, in this or another document, goes. Strings are
    judged on the input. n_spans are the maximal removed runs. Null and empty
    texts have no bytes. Repeated rows are documents of their own, so they empty
    each other if long enough. Null ids are ids like any other.
    """
    spans = repeated_spans(docs, length, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, places in zip(batch["packed"], batch["places"]):
                data = b"" if packed is None else unpack.decompress(packed)
                if places is None or not len(places):
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data))
                    continue
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, [p["at"] for p in places], 1)
                np.add.at(change, [p["at"] + p["n"] + length - 1 for p in places], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edges = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                out.append((len(data), len(data) - len(kept), edges, hashlib.sha256(kept).hexdigest(), kept))
            made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), made], axis=1)

    joined = _join_documents(_packed(docs), spans, "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    return _with_ids(joined.mapInPandas(
        run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
