"""Pruning of overlapping passages per owner and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.functions.text import containment, normal, word_set


def spread(df: DataFrame, owner: str, category: str, quote: str, out: str = "spread") -> DataFrame:
    """df with the number of categories under which the owner's normalised quote occurs."""
    topics = df.groupBy(owner, normal(F.col(quote)).alias("_n")).agg(F.countDistinct(category).alias(out))
    return df.withColumn("_n", normal(F.col(quote))).join(topics, [owner, "_n"], "left").drop("_n")


def pruned(df: DataFrame, owner: str, category: str, quote: str, official: Column, position: str, cap: int = 2, above: float = 0.7) -> DataFrame:
    """(owner, category, position, kept_no): the passages that stay.

    Per owner, passages come in the order spread, official first, longest, position.
    Within a category one is skipped if its text or first 60 characters were kept,
    the cap is reached, or it shares more than ``above`` of the smaller word set
    with a kept one.  The greedy choice takes one round for each of the cap places:
    the best passage left of each (owner, category) by aggregation, then a join
    that drops what clashes with it; no group is gathered in one task.
    """
    from spanlake.operators.joins import join_small
    from spanlake.session import checkpointed

    spark = df.sparkSession
    item = F.struct(
        "spread", F.when(official, 0).otherwise(1).alias("o"), (-F.length(quote)).alias("l"), F.col(position).alias("p"),
        F.xxhash64(normal(F.col(quote))).alias("n"), F.xxhash64(F.substring(normal(F.col(quote)), 1, 60)).alias("open"), F.transform(word_set(F.col(quote)), lambda w: F.xxhash64(w)).alias("w"),
    )
    left = checkpointed(spread(df, owner, category, quote).select(owner, category, item.alias("x")), spark)
    kept = None
    for no in range(cap):
        best = checkpointed(left.groupBy(owner, category).agg(F.min("x").alias("k")), spark)
        mine = best.select(owner, category, F.col("k.p").alias(position), F.lit(no).alias("kept_no"))
        kept = mine if kept is None else kept.unionByName(mine)
        if no + 1 < cap:
            clash = (F.col("x.n") == F.col("k.n")) | (F.col("x.open") == F.col("k.open")) | (F.coalesce(containment(F.col("x.w"), F.col("k.w")), F.lit(0.0)) > above)
            left = join_small(left, best, [owner, category]).where(~clash).drop("k")
    return kept


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest(df: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """One row per key, the last loaded; ties go to the smallest of the tie columns."""
    return first_by(df, keys, [F.col(at).desc(), *ties])


def larger(stored: DataFrame, fetched: DataFrame, key: str, text_col: str) -> DataFrame:
    """Keep-larger upsert: of the two sides the row with more text; the stored one on a tie."""
    both = stored.select(key, text_col, F.lit(0).alias("_new")).unionByName(fetched.select(key, text_col, F.lit(1).alias("_new")))
    return first_by(both, [key], [F.length(text_col).desc(), "_new"]).drop("_new")
