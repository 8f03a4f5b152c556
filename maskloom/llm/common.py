"""What the operators share: names that clash with no column, and Python workers that give memory back."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64 bits of all columns: rows that differ in any are told apart, but for chance."""
    parts = [named(f.name).cast("string") if _has_map(f.dataType) else named(f.name) for f in df.schema]
    return F.xxhash64(F.lit(seed), *[x for p in parts for x in (p, p.isNull())])


def give_back() -> None:
    """Hand the memory that this process has freed to the system: workers live on between stages, and each keeps what it once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
