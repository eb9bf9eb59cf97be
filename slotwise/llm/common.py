"""Text rules, tables in the shared folder, and reading of the given tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The word class of the queries, as UTF-8 ranges.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context, as ``--py-files`` does."""
    context = spark.sparkContext
    if getattr(context, "_slotwise_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="slotwise-"), "slotwise-code"), "zip",
                                 package.parent, package.name)
    context.addPyFile(packed)
    context._slotwise_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        cut(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: A task that writes rows of a few numbers gets so many of them, where there are not enough for all tasks; of texts so many.
FILE_ROWS, FILE_TEXTS = 10_000, 2_000


def stored(df: DataFrame, what: str, codec: str = "lz4", most: int | None = None, task_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    For tables that are read twice: a lost executor costs no recomputation of
    what stands before, and the files are compressed, unlike a checkpoint's.
    ``most`` bounds the rows, ``task_rows`` of which make a task: a small table is
    written by few tasks, since a file costs more than its rows, and Hadoop without
    its native library starts processes for each; a large one as it is dealt.
    """
    if most is not None:
        df = df.coalesce(most // task_rows + 1)
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
