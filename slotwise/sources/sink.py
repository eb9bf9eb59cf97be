"""Result tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), replace: str = "all") -> None:
    """Write ``df``; ``replace`` says what of an earlier result goes.

    ``all``: everything. ``partitions``: only partitions that ``df`` has rows of;
    files of the others are left as they are. Those rows are written to a staging
    folder and moved when all tasks are done, so a failed write changes nothing and
    the same write can be repeated. ``df`` must not read the partitions it replaces.
    """
    if replace not in ("all", "partitions"):
        raise ValueError(f"replace {replace!r}")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace == "all" else "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    elif replace == "partitions":
        raise ValueError("name the columns of the partitions to replace")
    writer.parquet(path)
