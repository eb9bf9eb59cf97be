"""Reader of the two ``;``-separated log files.

Every field is read as text, so no inference pass runs over the data and a file
of any size is split over tasks. Types are applied in one ``select``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.schema import CANCELLED_COLUMNS, COMPLETED_COLUMNS, FLAG_PREFIXES, YES
from slotwise.sources.records import read_csv, text_rows

# Fixed value: shape of a stamp, year to milliseconds with a decimal comma.
_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}$"


def parse_ts(column: Column) -> Column:
    """Zone-less timestamp of a stamp with milliseconds; null for anything else."""
    return F.when(column.rlike(_STAMP), _stamp(column))


def parse_ts_mixed(column: Column, *formats: str) -> Column:
    """Zone-less timestamp of any ISO form, then of each given pattern in turn."""
    tries = [_stamp(column)]
    tries += [F.try_to_timestamp(column, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def parse_date(column: Column) -> Column:
    return parse_ts(column).cast("date")


def yes_flag(column: Column) -> Column:
    return column == F.lit(YES)


def bit_flag(column: Column) -> Column:
    """0/1 text to boolean; text that is no number gives null."""
    return column.try_cast("tinyint").cast("boolean")


def _stamp(column: Column) -> Column:
    return F.replace(column, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")


def flag_name(header: str) -> str | None:
    """Column name of a flag header, or None if the header is no flag."""
    text = header.strip()
    for prefix, short in FLAG_PREFIXES.items():
        if text.startswith(prefix):
            # The three letters that have an ASCII stand-in.
            rest = text[len(prefix):].lower()
            for letter, plain in (("æ", "e"), ("ø", "o"), ("å", "a")):
                rest = rest.replace(letter, plain)
            return short + "_".join(re.findall("[a-z0-9]+", rest))
    return None


def rename_columns(df: DataFrame, mapping: dict[str, str], flags: bool = False) -> DataFrame:
    """Rename by position, so headers with dots or blanks need no quoting.

    A header of ``mapping`` that the file lacks is an error, and so are two
    headers that end up with one name.
    """
    missing = [header for header in mapping if header not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the log: {missing}")
    names = []
    for header in df.columns:
        name = mapping.get(header)
        if name is None and flags:
            name = flag_name(header)
        names.append(name or header)
    twice = sorted(name for name, n in Counter(names).items() if n > 1)
    if twice:
        raise ValueError(f"several columns are named {twice}")
    return df.toDF(*names)


def read_completed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Completed operations, one row per procedure, with ``row_seq`` in file order.

    ``row_seq`` follows the rows of a file, however it is split. Any number of
    files is one scan; they follow each other in the order of their paths, whatever
    their sizes, and need the same header. With ``multi_line`` quoted values may
    hold line breaks, at the price of two passes over the lines.
    """
    rows = text_rows(spark, path, multi_line)
    text = rename_columns(rows.drop("row_seq"), COMPLETED_COLUMNS, flags=True).columns
    rows = rows.toDF("row_seq", *text)

    def typed(name: str) -> Column:
        column = F.col(f"`{name}`")
        if name.startswith("ts_"):
            column = parse_ts(column)
        elif name == "date":
            column = parse_date(column)
        elif name == "is_acute":
            column = yes_flag(column)
        elif name == "patient_age":
            column = column.try_cast("int")
        elif name in ("delay_minutes", "overtime_minutes"):
            column = column.try_cast("double")
        elif name.startswith(tuple(FLAG_PREFIXES.values())):
            column = bit_flag(column)
        return column.alias(name)

    return rows.select("row_seq", *[typed(name) for name in text])


def read_cancelled(spark: SparkSession, path: str) -> DataFrame:
    """Cancelled operations."""
    text = rename_columns(read_csv(spark, path), CANCELLED_COLUMNS)
    return text.withColumns(
        {
            "scheduled_datetime": parse_ts(F.col("scheduled_datetime")),
            "expected_duration_min": F.col("expected_duration_min").try_cast("double"),
            **{
                name: yes_flag(F.col(name))
                for name in (
                    "cancelled_after_program_planned",
                    "cancelled_on_day_of_surgery",
                    "is_rebooked",
                )
            },
        }
    )
