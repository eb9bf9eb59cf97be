"""Text columns of ``;``-separated files, in the order of files and rows.

A row's number comes from where its split begins, not from a count of the rows
before it: ``_slot`` numbers the bytes of all files in path order in steps that no
two splits share, and the row's place in its task follows in the low bits. So one
scan reads any number of files, and no row waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.session import cut, sized

# monotonically_increasing_id counts a task's rows in its low 33 bits; the other 30 are for slots.
_ROW_BITS, _SLOT_BITS = 33, 29
_FORMAT = {"sep": ";", "quote": '"', "escape": '"', "nullValue": ""}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All fields as text, by the header."""
    reader = spark.read.options(**_FORMAT).option("header", True).option("inferSchema", False).option("encoding", "UTF-8")
    return reader.option("enforceSchema", False).option("multiLine", multi_line).csv(path)


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(file, first slot) of every file in path order, and the bytes of a slot."""
    # Only names and lengths are asked for, so no file is opened.
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
    files = cut(files)
    total = files.agg(F.sum("_size")).first()[0] or 0
    width = 1 << max(0, int(total).bit_length() - _SLOT_BITS)
    # One row a file, so one task numbers them.
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    slots = F.floor(F.col("_size") / width) + 1
    return files.select("_file", F.coalesce(F.sum(slots).over(before), F.lit(0)).cast("long").alias("_first")), width


def _number(slot: Column, row: Column) -> Column:
    return slot * F.lit(1 << _ROW_BITS) + row


def _placed(rows: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``_slot``, that of their split; files of one number a file are attached as a lookup."""
    at = F.col("_first") + F.floor(F.col("_block") / width)
    return rows.join(sized(files), "_file").withColumn("_slot", at.cast("long")).drop("_first")


def text_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The columns of the files as text, and ``row_seq``, which follows files by path and the rows of each.

    Files need the same header; another one is an error. With ``multi_line``
    quoted values may hold line breaks; files are split all the same.
    """
    if multi_line:
        return _quoted_rows(spark, path)
    table = read_csv(spark, path)
    names = table.columns
    rows = table.select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    placed = _placed(rows, *_files(spark, path))
    row = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.select(_number(F.col("_slot"), row).alias("row_seq"), *[F.col(f"`{c}`") for c in names])


# --- quoted line breaks ---------------------------------------------------------------


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether the end of ``line`` is inside quotes, if its beginning is or is not.

    A quote opens a value only as its first character; a doubled one stands for
    itself; after a closing one the value ends at the next separator.
    """
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if not quoted:
            if not line.startswith('"', at):
                at = line.find(";", at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        quoted = False
        at = line.find(";", at) + 1
        if not at:
            return False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], dict]]:
    """(whether and which split begins, its lines so far in this batch, first row) in reading order."""
    for batch in batches:
        slots = batch.column("_slot").to_numpy()
        edges = [0, *(i for i in range(1, len(slots)) if slots[i] != slots[i - 1]), len(slots)]
        lines = batch.column("value").to_pylist()
        more = {c: batch.column(c) for c in batch.schema.names if c not in ("_slot", "value")}
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield int(slots[a]), lines[a:b], {c: v[a].as_py() for c, v in more.items()}


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, how it ends if it begins outside and inside quotes."""
    last, states, facts = None, [False, True], {}

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_file": [facts["_file"]], "_slot": [last], "plain": [states[0]], "quoted": [states[1]]})

    for slot, lines, first in _splits(batches):
        if slot != last:
            if last is not None:
                yield row()
            last, states, facts = slot, [False, True], first
        for line in lines:
            if '"' in line:
                states = [ends_quoted(line, s) for s in states]
    if last is not None:
        yield row()


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins; a row a split."""
    splits = splits.sort_values("_slot")
    quoted, starts = False, []
    for plain, inside in zip(splits["plain"], splits["quoted"]):
        starts.append(quoted)
        quoted = inside if quoted else plain
    return pd.DataFrame({"_slot": splits["_slot"].to_numpy(), "begins": starts})


_RECORDS = "_file string, _slot long, _row long, kind int, record string"
#: A whole record; lines that go on with one of an earlier split; the beginning of one that goes on.
_WHOLE, _REST, _BEGUN = 0, 1, 2


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        out.clear()
        return batch

    last, facts, held, at, row, quoted, rest = None, {}, [], 0, 0, False, False

    def close() -> None:
        if held:
            out.append((facts["_file"], last, at, _REST if rest else _BEGUN, "\n".join(held)))

    for slot, lines, first in _splits(batches):
        if slot != last:
            close()
            last, facts, held, row, quoted = slot, first, [], 0, first["begins"]
            at, rest = 0, quoted
        for line in lines:
            was, quoted = quoted, ends_quoted(line, quoted)
            if not was and not rest:
                at = row
            row += 1
            if quoted or was:
                held.append(line)
                if not quoted:
                    out.append((facts["_file"], slot, at, _REST if rest else _WHOLE, "\n".join(held)))
                    held, rest = [], False
            elif line:
                out.append((facts["_file"], slot, at, _WHOLE, line))
        if len(out) >= 4096:
            yield flush()
    close()
    yield flush()


def _quoted_rows(spark: SparkSession, path: str) -> DataFrame:
    """Two passes over the lines of split files.

    The first runs every split's lines through the quoting rules from both states
    it can begin in; composed in file order, the ends tell how each begins. The
    second puts lines together; what crosses an edge, a record or two a split, is
    joined afterwards.
    """
    names = read_csv(spark, path, True).columns
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"))
    files, width = _files(spark, path)
    lines = _placed(lines, files, width).select("value", "_file", "_slot")
    ends = lines.mapInArrow(_ends, "_file string, _slot long, plain boolean, quoted boolean")
    starts = cut(ends.groupBy("_file").applyInPandas(_starts, "_slot long, begins boolean"))
    records = lines.join(sized(starts), "_slot").select("value", "_file", "_slot", "begins").mapInArrow(_records, _RECORDS)
    # Of a split at most the lines up to its first whole record and from its last one on.
    parts = cut(records.where(F.col("kind") != _WHOLE))
    order = Window.partitionBy("_file").orderBy("_slot", "kind")
    parts = parts.withColumn("begun", F.sum((F.col("kind") == _BEGUN).cast("int")).over(order))
    texts = F.array_sort(F.collect_list(F.struct("_slot", "kind", "_row", "record")))
    joined = parts.groupBy("_file", "begun").agg(texts.alias("parts")).select(
        "_file", F.col("parts")[0]["_slot"].alias("_slot"), F.col("parts")[0]["_row"].alias("_row"),
        F.array_join("parts.record", "\n").alias("record"))
    every = records.where(F.col("kind") == _WHOLE).select("_file", "_slot", "_row", "record").unionByName(joined)

    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    # The settings of a value are those of a file; a record is read by itself.
    parsed = every.select("_file", "_slot", "_row", F.from_csv("record", F.lit(fields), {**_FORMAT, "multiLine": "true"}).alias("r"))
    # The first line of a file is its header, unless it is empty.
    is_header = (F.col("_row") == 0) & F.col("_first_slot")
    header = F.array(*[F.lit(c) for c in names])
    found = F.array(*[F.coalesce(F.col(f"r.c{i}"), F.lit(f"_c{i}")) for i in range(len(names))])
    checked = F.when(is_header & (found != header), F.raise_error(F.lit("a file has another header")).cast("boolean")).otherwise(~is_header)
    begins = files.select(F.col("_first").alias("_slot"), F.lit(True).alias("_first_slot"))
    rows = parsed.join(sized(begins), "_slot", "left").withColumn("_first_slot", F.coalesce("_first_slot", F.lit(False))).where(checked)
    return rows.select(_number(F.col("_slot"), F.col("_row")).alias("row_seq"), *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
