"""Sentences by plain boundary rules, and spans cut from them with exact offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanlake.functions.text import word_count

_MARK = "\ue000"  # a private character as sentinel
_BREAK = r"([.!?][\"')\]]*[ \t\r\n\f\x0B]+)([A-Z0-9\"'(\[])"


def fragments(text: Column) -> Column:
    """array<struct<start, end>> of the fragments between boundaries, blanks trimmed, empties left out.

    A boundary is a terminator with closers and blanks before an opener, or a blank
    line.  Each is marked by one sentinel, the text is split there, and a fold over
    the pieces keeps the running offset.
    """
    marked = F.regexp_replace(F.regexp_replace(text, _BREAK, "$1" + _MARK + "$2"), r"(\n{2,})", "$1" + _MARK)
    pieces = F.split(marked, _MARK, -1)
    blank = r"[\s\x{00A0}]"

    def step(state: Column, piece: Column) -> Column:
        lead = F.length(piece) - F.length(F.regexp_replace(piece, "^" + blank + "+", ""))
        body = F.length(F.regexp_replace(F.regexp_replace(piece, blank + "+$", ""), "^" + blank + "+", ""))
        span = F.struct((state["at"] + lead).alias("start"), (state["at"] + lead + body).alias("end"))
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"),
            F.when(body > 0, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(pieces, begin, step, lambda s: s["out"])


def merged(spans: Column, least_chars: int = 25) -> Column:
    """Spans shorter than least_chars are folded into the one before; a short first one stays."""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(kept) > 0) & (s["end"] - s["start"] < least_chars), joined).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def sentence_rows(df: DataFrame, id_col: str, text_col: str, least_chars: int = 25) -> DataFrame:
    """(id_col, sent_id, char_start, char_end, text), sent_id from 0."""
    spans = df.select(id_col, F.col(text_col).alias("_t"), F.posexplode(merged(fragments(F.col(text_col)), least_chars)).alias("sent_id", "s"))
    piece = F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return spans.select(id_col, "sent_id", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), piece.alias("text"))


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last, length) of consecutive numbers; repeated numbers count once."""
    one = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return one.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length")).drop("_island")


def verified(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Is quote exactly the slice of text from start to end?"""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == quote), F.lit(False))


def standalone_line(text: Column, start: Column, end: Column) -> Column:
    """Only spaces and tabs stand between the span and the line's ends."""
    before = F.regexp_replace(F.substring(text, F.lit(1), start), r"[ \t]+$", "")
    after = F.regexp_replace(F.substring(text, end + 1, F.length(text)), r"^[ \t]+", "")
    return ((before == "") | before.endswith("\n")) & ((after == "") | after.startswith("\n"))


def long_enough(quote: Column, standalone: Column, least: int = 15, least_standalone: int = 8) -> Column:
    return word_count(quote) >= F.when(standalone, F.lit(least_standalone)).otherwise(F.lit(least))


def spans_of_choices(docs: DataFrame, sentences: DataFrame, choices: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, category, char_start, char_end, quote): runs of chosen sentences as exact slices.

    choices: id_col, category, sent_id.  Unknown sentence ids are ignored; runs below
    the word floor, or that do not match the text, are left out.  The text is
    attached last, so it is shuffled once.
    """
    chosen = choices.select(id_col, "category", "sent_id").distinct().join(sentences.select(id_col, "sent_id", "char_start", "char_end"), [id_col, "sent_id"])
    island = F.col("sent_id") - F.row_number().over(Window.partitionBy(id_col, "category").orderBy("sent_id"))
    cut = chosen.withColumn("_i", island).groupBy(id_col, "category", "_i").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("_i")
    text = F.col(text_col)
    quoted = cut.join(docs.select(id_col, text_col), id_col).withColumn("quote", F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    quoted = quoted.withColumn("_line", standalone_line(text, F.col("char_start"), F.col("char_end")))
    good = verified(text, F.col("quote"), F.col("char_start"), F.col("char_end")) & long_enough(F.col("quote"), F.col("_line"))
    return quoted.where(good).select(id_col, "category", "char_start", "char_end", "quote")
