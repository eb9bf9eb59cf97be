"""Staff and equipment flags packed as bits, for logs with hundreds of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.schema import FLAG_PREFIXES

_WORD = 64


def packed(columns: Sequence[str]) -> Column:
    """64 flags a word, the first in the lowest bit; null counts as not set."""
    def word(names: Sequence[str]) -> Column:
        bits = [F.when(F.col(c), F.lit((1 << k) - (1 << _WORD if k == _WORD - 1 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
                for k, c in enumerate(names)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.array(*[word(columns[i:i + _WORD]) for i in range(0, len(columns), _WORD)]).cast("array<long>")


def pack_flags(log: DataFrame) -> DataFrame:
    """``log`` with ``staff_flags`` and ``resource_flags`` instead of a column a flag.

    The names stand in the metadata of the new columns, which Parquet files keep.
    Counts, models and :func:`unpack_flags` read them from there.
    """
    new, old = [], []
    for prefix in FLAG_PREFIXES.values():
        names = flag_columns(log, prefix)
        if names:
            new.append(packed(names).alias(f"{prefix}flags", metadata={"flags": names}))
            old += names
    return log.select(*[c for c in log.columns if c not in old], *new)


def flag_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c, t in df.dtypes if c.startswith(prefix) and t == "boolean"]


def packed_names(df: DataFrame, prefix: str) -> list[str]:
    """Names of the packed flags, none if the flags are columns."""
    name = f"{prefix}flags"
    return list(df.schema[name].metadata.get("flags", [])) if name in df.columns else []


def set_bits(words: Column) -> Column:
    return F.coalesce(F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w)), F.lit(0)).cast("long")


def _bit(words: Column, k: int) -> Column:
    return F.getbit(words[k // _WORD], F.lit(k % _WORD)) == 1


def unpack_flags(log: DataFrame) -> DataFrame:
    """A column a flag again; flags that were null are false."""
    for prefix in FLAG_PREFIXES.values():
        names = packed_names(log, prefix)
        log = log.withColumns({c: _bit(F.col(f"{prefix}flags"), k) for k, c in enumerate(names)}).drop(f"{prefix}flags")
    return log


def flag_vector(df: DataFrame) -> tuple[Column, int]:
    """One ML vector of all flags, packed or not, and its length."""
    values = []
    for prefix in FLAG_PREFIXES.values():
        names = packed_names(df, prefix)
        if names:
            values.append(F.flatten(F.transform(f"{prefix}flags", lambda w: F.transform(
                F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda k: F.getbit(w, k).cast("double")))))
            values[-1] = F.slice(values[-1], 1, len(names))
        columns = flag_columns(df, prefix)
        if columns:
            values.append(F.array(*[F.coalesce(F.col(c), F.lit(False)).cast("double") for c in columns]))
    length = sum(len(packed_names(df, p)) + len(flag_columns(df, p)) for p in FLAG_PREFIXES.values())
    return array_to_vector(F.concat(*values) if values else F.array().cast("array<double>")), length
