"""Whose voice a passage is, reviewed exclusions, and checks of reviewed votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.functions.text import collapse
from spanlake.operators.checks import summary_problems
from spanlake.operators.joins import join_small

# Quotation marks that open praise; how a narrator knows a person; what is said of a person by name; how people introduce themselves.
OPENING_MARKS = ('"', "“", "«")
KNOWS = tuple(f"{i} {v}" for i in ("i", "i've", "i have") for v in ("known", "met", "worked with", "watched", "served with", "first met", "come to know"))
SAID_OF = ("has", "have", "is", "was", "continues", "lead", "leads", "led", "bring", "brings", "believe", "believes", "will", "serve", "serves", "served", "leadership", "record", "vision")
INTRODUCES = ("my name is", "i am", "i'm")


def _spoken(x: Column) -> Column:
    """Lower-case words and apostrophes between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("’"), F.lit("'")), r"[^\p{L}\p{N}']+", " ")), F.lit(" "))


def _said(text: Column, *words: Column | str) -> Column:
    parts = [F.lit(w) if isinstance(w, str) else w for w in words]
    return F.contains(text, F.concat(F.lit(" "), F.concat_ws(" ", *parts), F.lit(" ")))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def other_voice(quote: Column, name: Column) -> Column:
    """Does somebody else speak of the person: praise that opens with a quotation mark, or one who knows them, who names them and is not them introducing themselves?"""
    text, given = _spoken(quote), F.lower(F.substring_index(F.trim(name), " ", 1))
    praise = F.substring(collapse(quote), 1, 1).isin(*OPENING_MARKS)
    knows = _any(_said(text, k) for k in KNOWS)
    own = _any(_said(text, i, given) for i in INTRODUCES)
    subject = _any(_said(text, given, w) | _said(text, F.concat(given, F.lit("'s")), w) for w in SAID_OF) & (F.length(given) > 2)
    named = _said(text, F.trim(_spoken(name))) | subject
    return F.coalesce((praise | knows) & named & ~own, F.lit(False))


def excluded(passages: DataFrame, exclusions: DataFrame, owner: str, quote: str) -> DataFrame:
    """passages with excluded_by: the longest reviewed beginning (owner, starts_with) that the quote of its owner has, else null.

    Beginnings are met by owner and their own length: each quote is cut to the lengths
    that its owner's beginnings have, so the join is by equality.
    """
    wanted = exclusions.select(owner, "starts_with").where("starts_with <> ''").distinct()
    lengths = wanted.groupBy(owner).agg(F.collect_set(F.length("starts_with")).alias("_lengths"))
    cut = join_small(passages, lengths, [owner]).select(owner, quote, F.explode("_lengths").alias("_n")).distinct()
    cut = cut.withColumn("starts_with", F.substring(collapse(F.col(quote)), F.lit(1), F.col("_n"))).where(F.length("starts_with") == F.col("_n"))
    hit = join_small(cut, wanted, [owner, "starts_with"]).groupBy(owner, quote).agg(F.max_by("starts_with", F.length("starts_with")).alias("excluded_by"))
    return join_small(passages, hit, [owner, quote], "left")


def stale(passages: DataFrame, exclusions: DataFrame, owner: str, quote: str) -> DataFrame:
    """Reviewed beginnings that no passage of their owner has."""
    used = passages.select(owner, collapse(F.col(quote)).alias("_q")).distinct()
    wanted = exclusions.select(owner, "starts_with").distinct()
    lengths = wanted.groupBy(owner).agg(F.collect_set(F.length("starts_with")).alias("_lengths"))
    cut = join_small(used, lengths, [owner]).select(owner, F.explode(F.transform("_lengths", lambda n: F.substring("_q", F.lit(1), n))).alias("starts_with")).distinct()
    return wanted.join(cut, [owner, "starts_with"], "left_anti")


def review_problems(reviews: DataFrame, votes: DataFrame, members: DataFrame, issues: list[str], decisions: tuple[str, ...] = ("for", "against", "absent", "n/a")) -> DataFrame:
    """(vote_id, problem) of every rule that a review breaks.

    reviews: vote_id, status, issues, summary, votes (corrections by surname).  Approved
    ones must be of a vote that exists, with known issues, a summary that keeps its rules
    and corrections of known members and decisions; each vote has one review.
    """
    surnames = F.array_sort(F.collect_set("surname"))
    people = members.groupBy("municipality").agg(surnames.alias("surnames"))
    known = votes.select("vote_id", "municipality").join(F.broadcast(people), "municipality", "left")
    r = reviews.join(known, "vote_id", "left").withColumn("approved", F.col("status") == "approved")
    names = F.coalesce("surnames", F.array().cast("array<string>"))
    wrong = F.array_except(F.coalesce(F.map_keys("votes"), F.array().cast("array<string>")), names)
    values = F.array_except(F.coalesce(F.map_values("votes"), F.array().cast("array<string>")), F.array(*map(F.lit, decisions)))
    unknown = F.array_except(F.coalesce("issues", F.array().cast("array<string>")), F.array(*map(F.lit, issues)))
    found = F.array_compact(F.array(
        F.when(~F.col("status").isin("approved", "draft", "rejected"), "bad_status"), F.when(F.col("approved") & F.col("municipality").isNull(), "no_such_vote"),
        F.when(F.col("approved") & (F.coalesce(F.size("issues"), F.lit(0)) < 1), "no_issue"), F.when(F.col("approved") & (F.size(unknown) > 0), "unknown_issue"),
        F.when(F.col("approved") & F.col("municipality").isNotNull() & (F.size(wrong) > 0), "unknown_member"), F.when(F.col("approved") & (F.size(values) > 0), "unknown_decision"),
    ))
    text = F.when(F.col("approved"), summary_problems(F.coalesce("summary", F.lit("")), names)).otherwise(F.array().cast("array<string>"))
    each = r.select("vote_id", F.explode(F.concat(found, text)).alias("problem"))
    twice = reviews.groupBy("vote_id").agg(F.count("*").alias("n")).where("n > 1").select("vote_id", F.lit("reviewed_twice").alias("problem"))
    return each.unionByName(twice).distinct()
