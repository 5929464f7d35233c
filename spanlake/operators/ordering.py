"""Seeded shuffle and ordering keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_UNSIGNED = 0xFFFFFFFF


def xorshift(state: Column) -> Column:
    """Next 32-bit state; the middle step shifts with the sign, as in signed 32-bit arithmetic."""
    a = state.bitwiseXOR(F.shiftleft(state, 13)).bitwiseAND(F.lit(_UNSIGNED))
    signed = F.when(a >= 2**31, a - 2**32).otherwise(a)
    b = a.bitwiseXOR(F.shiftright(signed, 17).bitwiseAND(F.lit(_UNSIGNED)))
    return b.bitwiseXOR(F.shiftleft(b, 5)).bitwiseAND(F.lit(_UNSIGNED))


def seeded_shuffle(items: Column, seed: int) -> Column:
    """Fisher-Yates from the end with draws state / (2**32 - 1); items is an array."""
    first = F.struct(F.lit(seed & _UNSIGNED).cast("long").alias("s"), items.alias("a"))

    def step(state: Column, i: Column) -> Column:
        s = xorshift(state["s"])
        j = F.least(F.floor(s / F.lit(float(_UNSIGNED)) * (i + 1)).cast("int"), i)
        a = state["a"]
        swapped = F.transform(a, lambda x, k: F.when(k == i, F.get(a, j)).when(k == j, F.get(a, i)).otherwise(x))
        return F.struct(s.alias("s"), swapped.alias("a"))

    places = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, first, step, lambda s: s["a"])


def locale_key(name: Column) -> Column:
    """For sorting names as a reader would: accents and case aside."""
    return F.collate(name, "UNICODE_CI_AI")


def rank_in(value: Column, order: list[str]) -> Column:
    """Place in a fixed order; values outside it come last."""
    at = F.array_position(F.array(*(F.lit(o) for o in order)), value)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with each row's place, from 1, in the order of all rows.

    Rows are range-partitioned and sorted there; a place is the rows of the earlier
    partitions plus the place within the own one, so no task holds more than its range.
    """
    from spanlake.session import checkpointed

    held = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + inside).cast("bigint")).drop("_part", "_before")
