"""Keyword tagging of sentences against a small taxonomy.

A tagger is any function from (DataFrame, text column) to (the key columns,
category); keyword_tagger is the default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

Tagger = Callable[[DataFrame, str], DataFrame]

# A taxonomy over the project's data (category: keywords) and its flashpoints (id: phrases).
TAXONOMY: dict[str, tuple[str, ...]] = {
    "homes": ("housing", "renters", "tenant", "laneway homes", "co-op housing", "rent registry"),
    "getting-around": ("bus", "bike", "ferry", "night bus", "curb lanes", "bike network", "road resurfacing"),
    "safety": ("fire hall", "crossing", "emergency cache", "street lighting", "noise bylaw"),
    "budget": ("budget", "levy", "tax", "reserve fund", "tax deferral plan", "budget workbook"),
    "care": ("child care", "nurses", "seniors", "youth hostel", "seniors' centre", "child care spaces"),
    "shore-and-parks": ("trees", "creek", "shoreline setback", "off-leash park", "community garden", "hillside trails"),
    "learning": ("library", "school", "arts hall", "library branch", "tool library", "school walkways"),
}
FLASHPOINTS: dict[str, tuple[str, ...]] = {"arena": ("ice arena", "arena"), "shore-path": ("shoreline setback",), "pump-station": ("pump station",), "tunnel": ("tunnel",), "merger": ("merger", "merge the")}


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that occur in the lower-case text, also inside longer words."""
    low = F.lower(text)
    return F.filter(F.array(*(F.lit(k) for k in keywords)), lambda k: F.contains(low, k))


def keyword_rule(text: Column, keywords: tuple[str, ...]) -> Column:
    """At least two keywords, or one of several words."""
    hits = keyword_hits(text, keywords)
    return (F.size(hits) >= 2) | F.exists(hits, lambda k: F.contains(k, F.lit(" ")))


def categories_of(text: Column, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY) -> Column:
    return F.array_compact(F.array(*(F.when(keyword_rule(text, words), F.lit(c)) for c, words in taxonomy.items())))


def flashpoints_in(text: Column, flashpoints: dict[str, tuple[str, ...]] = FLASHPOINTS) -> Column:
    low = F.lower(text)

    def any_of(phrases: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(low, F.lit(p.lower()))
        return out

    return F.array_compact(F.array(*(F.when(any_of(p), F.lit(f)) for f, p in flashpoints.items())))


def keyword_tagger(df: DataFrame, text_col: str, taxonomy: dict[str, tuple[str, ...]] = TAXONOMY) -> DataFrame:
    """df's rows, once for each category; rows without one are left out."""
    return df.withColumn("category", F.explode(categories_of(F.col(text_col), taxonomy)))


def incremental(df: DataFrame, cache: DataFrame, key: str, tag: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose key is in the cache take its tags; only the others are tagged.  cache and tag give the same columns."""
    known = df.select(key).distinct().join(cache, key)
    return known.unionByName(tag(df.join(cache.select(key).distinct(), key, "left_anti")).select(*known.columns))
