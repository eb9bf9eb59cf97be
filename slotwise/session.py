"""Session settings and lineage cutting."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "slotwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were measured with."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Recording the Python call site of every column costs more than small queries.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# A lookup of at most this many rows is broadcast, some tens of megabytes.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once and counted; marked for broadcast only if it is small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A folder
    of our own is used only where none is named and the master is local.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="slotwise-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


# Of rows that a learner reads again and again a task gets so many at most, 100 to 200 MB as vectors.
TASK_ROWS = 100_000


def dealt(df: DataFrame, task_rows: int = TASK_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` written once, and dealt evenly in whole rounds of all cores where tasks are too large.

    Adaptive execution joins partitions by their compressed size, which can leave
    tasks of millions of rows, or one task more than there are cores. Rows stay
    where they are unless a task would get more than ``task_rows`` of them, or all
    are more than ``rows``: what learners draw at random goes by partition.
    """
    df = cut(df)
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    if n <= (task_rows * df.rdd.getNumPartitions() if rows is None else rows):
        return df
    return cut(df.repartition(math.ceil(n / (task_rows * cores)) * cores))
