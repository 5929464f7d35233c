"""Integrity checks: each gives a DataFrame of problems; publishing asserts that it is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.operators.joins import join_large
from spanlake.operators.spans import verified


class CheckFailed(Exception):
    """A check found problems."""


class AmbiguousName(CheckFailed):
    """Several people have a name that should be one's."""


class Blocked(CheckFailed):
    """A source may not be read."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, n, expected) where the group sizes and expected differ, in either direction."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n"))
    both = got.join(expected, keys, "full")
    return both.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("expected", F.coalesce("expected", F.lit(0))).where("n <> expected")


def unverified_spans(spans: DataFrame, sources: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Spans whose source is missing or does not hold the quote at its place; reason says which."""
    joined = join_large(spans, sources.select(key, F.col(text_col).alias("_text")), key, "left")
    good = verified(F.col("_text"), F.col("quote"), F.col("char_start"), F.col("char_end"))
    reason = F.when(F.col("_text").isNull(), "no source").when(F.trim("quote") == "", "empty").when(~good, "not at its place")
    return joined.withColumn("reason", reason).where("reason is not null").drop("_text")


def unknown_values(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(known)).groupBy(column).agg(F.count("*").alias("n"))


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, missing_in): keys that only one side has."""
    both = a.select(key, F.lit(1).alias("_a")).distinct().join(b.select(key, F.lit(1).alias("_b")).distinct(), key, "full")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "first").otherwise("second").alias("missing_in"))


def below_floor(df: DataFrame, least: int) -> DataFrame:
    """(n, least) if df has fewer rows than least, else no row."""
    return df.agg(F.count("*").alias("n")).withColumn("least", F.lit(least)).where("n < least")


def flags(**named: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))


def summary_problems(summary: Column, surnames: Column, most: int = 220) -> Column:
    """Placeholders, over-long summaries and surnames that stand as words or possessives."""
    words = F.transform(F.split(F.lower(summary), "[ \\t\\n]+"), lambda w: F.regexp_replace(w, "['’]s$", ""))
    return flags(placeholder=F.contains(F.lower(summary), F.lit("todo")) | (F.trim(summary) == ""), too_long=F.length(summary) > most, names_a_person=F.arrays_overlap(words, F.transform(surnames, F.lower)))


def assert_none(problems: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first few problems; at most ``show`` rows reach the driver."""
    found = problems.limit(show).collect()
    if found:
        raise CheckFailed(f"{what}: " + "; ".join(str(r.asDict()) for r in found))


def assert_unambiguous(people: DataFrame, keys: list[str]) -> None:
    """Raise if several people share the keys."""
    found = duplicate_keys(people, keys).limit(5).collect()
    if found:
        raise AmbiguousName("; ".join(str(r.asDict()) for r in found))
