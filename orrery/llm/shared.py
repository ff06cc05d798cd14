"""Intermediate tables, and rows told apart, for the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.tables import drop, new_path, scratch, shared_folder
from orrery.tables import stored as checkpointed

__all__ = ["MAX_BROADCAST_KEYS", "ROW", "checkpointed", "drop", "new_path", "row_hash", "scratch", "shared_folder", "sized", "without_rows"]

#: Keys of 8 bytes in a broadcast set; beyond, the join is a shuffled one.
MAX_BROADCAST_KEYS = 2_000_000


def sized(small: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """``small`` with a broadcast hint if it has ``limit`` rows at most."""
    return F.broadcast(small) if small.count() <= limit else small


#: Columns that tell rows apart.
ROW = ("__row_1", "__row_2")


def row_hash(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns' values; null is a value of its own."""
    values = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(k), *values) for k in range(len(ROW))]


def without_rows(docs: DataFrame, rejected: DataFrame, *columns: str) -> DataFrame:
    """``docs`` less the rows whose ``row_hash`` of ``columns`` is in ``rejected``."""
    named = docs.withColumns(dict(zip(ROW, row_hash(*columns), strict=True)))
    return named.join(sized(rejected.select(*ROW).distinct()), list(ROW), "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
