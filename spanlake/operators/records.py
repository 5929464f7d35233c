"""Overlays, routing and review joins on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fill_nulls(df: DataFrame, extra: DataFrame, key: str, column: str) -> DataFrame:
    """column from extra only where it is null."""
    e = extra.select(key, F.col(column).alias("_extra"))
    return df.join(e, key, "left").withColumn(column, F.coalesce(column, "_extra")).drop("_extra")


def overwrite(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """column from new wherever new has the key with a value."""
    n = new.select(key, F.col(column).alias("_new"))
    return df.join(n, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def append_new(df: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """extra's rows whose keys df lacks, after df's."""
    return df.unionByName(extra.join(df.select(*keys).distinct(), keys, "left_anti").select(*df.columns))


def unknown_keys(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def set_defaults(present: Column, extra: Column) -> Column:
    """A map with extra's entries for keys that present lacks; either may be null."""
    none = F.create_map().cast("map<string,string>")
    have, more = F.coalesce(present, none), F.coalesce(extra, none)
    return F.map_concat(have, F.map_filter(more, lambda k, _: ~F.map_contains_key(have, k)))


def overlaid(parsed: Column, reviewed: Column) -> Column:
    """reviewed's value per key where it has one."""
    return F.map_zip_with(parsed, reviewed, lambda _, a, b: F.coalesce(b, a))


def hinted(categories: Column, hints: dict[str, list[str]]) -> Column:
    """Issues hinted at by the categories, in order, without repeats."""
    table = F.create_map(*(x for k, v in hints.items() for x in (F.lit(k), F.array(*(F.lit(i) for i in v)))))
    each = F.transform(categories, lambda c: F.coalesce(table[c], F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def normal_decision(x: Column) -> Column:
    """for, against, absent or n/a in one spelling; null if it is none of them."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("for", "against", "absent", "n/a"), low)


def ballot_maps(ballots: DataFrame) -> DataFrame:
    """(vote_id, members): one decision per member; of several the one recorded last, then the first in the alphabet."""
    last = F.max_by("decision", F.struct("recorded_at", F.col("decision")))
    one = ballots.withColumn("decision", normal_decision(F.col("decision"))).where("decision is not null and member_id is not null").groupBy("vote_id", "member_id").agg(last.alias("decision"))
    return one.groupBy("vote_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member_id", "decision")))).alias("members"))


def disposition(no_motion: Column, unknown_name: Column, missing_member: Column) -> Column:
    """Where a row goes, the first reason that holds."""
    return F.when(no_motion, "no_motion").when(unknown_name, "unknown_name").when(missing_member, "missing_member").otherwise("vote")


def resolve_one(df: DataFrame, people: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """id_col by keys only where exactly one person has them; null otherwise."""
    single = people.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(id_col).alias(id_col)).where("_n = 1").drop("_n")
    return df.join(single, keys, "left")


def snapshot_emptied(before: DataFrame, after: DataFrame, owner: str) -> DataFrame:
    """(owner, had): owners with rows before and none after."""
    had = before.groupBy(owner).agg(F.count("*").alias("had"))
    return had.join(after.select(owner).distinct(), owner, "left_anti")
