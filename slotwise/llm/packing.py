"""Packing of tokenized documents into sequences: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored
from slotwise.llm.tokens import BytePairs

_TOKENS = "doc_id string, part int, before long, doc_tokens long, ids binary"
_PIECES = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary")


def tokenize(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Per document: its ids and end mark, its map partition and the tokens before it there."""
    load = BytePairs(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = load.encode("" if text is None else text)
                ids.append(end_id)
                out.append((doc_id, part, before, len(ids), load.pack(ids)))
                before += len(ids)
            yield pd.DataFrame(out, columns=["doc_id", "part", "before", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").cast("string"), "text").mapInPandas(run, _TOKENS)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens: ``_PIECES``.

    First pass: each map partition tokenizes its documents, numbers their tokens,
    and writes ids to the shared folder. The totals of the partitions, one row
    each, are summed up to the partition; that and the place within it give each
    document its global offset. Second pass: windows of ``length`` are cut at
    fixed offsets, so a piece knows its sequence without any exchange of tokens,
    and a document over a boundary gives one row on either side. Only the last
    sequence of the table can be short.

    A null text is empty and gives the end mark alone. Null and repeated ids are
    packed as documents of their own. An empty table gives no rows.
    """
    load = BytePairs(tokenizer)
    tokens = stored(tokenize(docs, end_id, tokenizer), "tokens", "zstd")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([row["n"] for row in totals], dtype=np.int64)
    base = {row["part"]: int(end - row["n"]) for row, end in zip(totals, ends)}
    starts = docs.sparkSession.createDataFrame(list(base.items()) or [(-1, 0)], "part int, base long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, first, total, packed in zip(batch["doc_id"], batch["first"], batch["doc_tokens"], batch["ids"]):
                ids = load.unpack(packed)
                at = 0
                while at < total:
                    sequence, offset = divmod(first + at, length)
                    n = min(length - offset, total - at)
                    piece = ids[at:at + n].tobytes()
                    out.append((doc_id, at, n, zlib.crc32(piece), total, sequence, offset, piece))
                    at += n
            yield pd.DataFrame(out, columns=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = tokens.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("first"), "doc_tokens", "ids")
    return placed.mapInPandas(run, _PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 32-bit), n_tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens")
