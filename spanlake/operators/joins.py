"""Joins whose small side is checked before it is broadcast, and joins that are never broadcast.

Spark's own estimate of a side that comes from a Python function, an explode or a
checkpoint can be far too small, so neither form leaves the choice to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _bytes(field: T.StructField) -> Column:
    """About what a value takes in memory."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 32
    return F.lit(8)


def fits(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> bool:
    """Is df within both bounds?  Reads no more than most_rows + 1 rows of it."""
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    rows, held = df.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= most_rows and held <= most_bytes


def join_large(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by shuffle and merge; AQE splits what is skewed."""
    return a.join(b.hint("merge"), on, how)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """Join; the small side is broadcast only after its rows and bytes were held against their bounds, else merged.

    The small side is read once for the check and once for the join: pass one that is cheap to read.
    """
    return big.join(F.broadcast(small), on, how) if fits(small, most_rows, most_bytes) else join_large(big, small, on, how)
