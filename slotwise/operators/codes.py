"""Mean codes of text columns that do not leak the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.session import cut

from .joins import attach

#: Parts of the training rows; the code of a row is learned from the other parts.
FOLDS = 5
#: So many rows of the overall mean are added to every value's own.
SHRINK = 10.0


def fold_of(key: str, folds: int = FOLDS) -> Column:
    """A row's part, by a checksum of its key, so that all rows of a case share it."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int")


def value_sums(train: DataFrame, columns: Sequence[str], target: str, key: str, folds: int = FOLDS) -> DataFrame:
    """Per column and value: sum and count of the target, over all rows and per fold.

    One aggregate for all columns; a value that many rows share is reduced before
    the shuffle. Null values are summed too, as a value of their own. Rows whose
    key is null are in no fold.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    rows = train.where(F.col(target).isNotNull()).select(
        pairs.alias("pair"), fold_of(key, folds).alias("fold"), F.col(target).cast("double").alias("y"))
    inside = [F.when(F.col("fold") == k, F.col("y")) for k in range(folds)]
    return rows.groupBy("pair.column", "pair.value").agg(
        F.sum("y").alias("total"), F.count("*").alias("n"),
        F.array(*[F.coalesce(F.sum(y), F.lit(0.0)) for y in inside]).alias("fold_total"),
        F.array(*[F.count(y) for y in inside]).alias("fold_n"),
    )


def mean_coded(
    train: DataFrame,
    test: DataFrame,
    columns: Mapping[str, str],
    target: str,
    key: str = "case_id",
    folds: int = FOLDS,
    shrink: float = SHRINK,
) -> tuple[DataFrame, DataFrame]:
    """Both parts with a number for each of ``columns`` (text column -> name of its code).

    The code of a value is the mean of ``target`` over the training rows that have
    it, drawn to the overall mean as by ``shrink`` more rows. A training row is
    coded from the other folds' rows alone, so its own target never reaches its
    code: a text that occurs once says nothing, as it will for unseen rows. Null
    and unseen values have the overall mean, and so does a value seen in one fold
    only, on that fold. Without training rows codes are null.
    """
    sums = cut(value_sums(train, list(columns), target, key, folds))
    one = sums.where(F.col("column") == next(iter(columns)))
    mean = one.agg(F.try_divide(F.sum("total"), F.sum("n"))).first()[0]
    overall = F.lit(mean).cast("double")
    out = []
    for rows, own in ((train, True), (test, False)):
        for column, code in columns.items():
            known = sums.where((F.col("column") == column) & F.col("value").isNotNull()).select(
                F.col("value").alias("_value"), F.struct("total", "n", "fold_total", "fold_n").alias("_sums"))
            total, n = F.col("_sums.total"), F.col("_sums.n")
            if own:
                fold = fold_of(key, folds)
                total = total - F.coalesce(F.get(F.col("_sums.fold_total"), fold), F.lit(0.0))
                n = n - F.coalesce(F.get(F.col("_sums.fold_n"), fold), F.lit(0))
            value = F.when(n > 0, (total + overall * shrink) / (n + shrink))
            marked = rows.withColumn("_value", F.col(column).cast("string"))
            rows = attach(marked, known, ["_value"]).withColumn(code, F.coalesce(value, overall)).drop("_value", "_sums")
        out.append(rows)
    return out[0], out[1]
