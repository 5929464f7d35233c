"""Lines that one host repeats on many of its pages.

Each line of a host keeps the set of its documents as a compressed bitmap: bit
``id & 63`` of the 64-bit word ``id >> 6``, and only words with a bit are held.  Every
task makes the bitmaps of the lines it reads; those of lines that normalise alike,
in whatever variant they are written, are united by OR.  The exact cardinality, the
sum of the words' bit counts, is held against the threshold; the same is done for
the host's pages.  A line of a page is then deleted if its bit is set in a
surviving bitmap.

A word is at most 64 documents, so a line that a hot host repeats on every page is
spread over as many rows as the host has words, in the counting and in the lookup
alike; no row and no task holds a whole bitmap.  All steps are built-in expressions,
combined before each shuffle.

Null texts and urls without a host give no rows; rows delivered again count once
by id; blank lines are never cases.  Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanlake.llm.common import BLANKS, host_of, join_large, join_small
from spanlake.session import checkpointed

WORD = 6  # a bitmap's words have 2 ** WORD bits
_INLINE = BLANKS.replace(r"[\s", r"[ \t\r\x0B\f")  # all blanks but the line feed


def normal_line(line: Column) -> Column:
    """Blank runs become one space, ends trimmed, lower case, digit runs become one 0."""
    x = F.regexp_replace(line, BLANKS + "+", " ")
    return F.regexp_replace(F.lower(F.trim(x)), "[0-9]+", "0")


def normal_lines(text: Column) -> Column:
    """normal_line of each line of a text, by one pass over the text."""
    x = F.regexp_replace(F.lower(F.regexp_replace(text, _INLINE + "+", " ")), "[0-9]+", "0")
    return F.transform(F.split(x, "\n", -1), lambda line: F.trim(line))


def _pages(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    doc = F.col(id_col).cast("long")
    pages = df.select(doc.alias("doc"), F.xxhash64(host_of(F.col(url_col))).alias("host"), host_of(F.col(url_col)).alias("name"), F.col(text_col).alias("text"))
    return pages.where(F.col("name").isNotNull() & F.col("doc").isNotNull() & F.col("text").isNotNull()).drop("name")


def _word(doc: Column) -> Column:
    return F.shiftright(doc, WORD)


def _bits(doc: Column) -> Column:
    """The word that has the bit of doc, and those of the rows it is grouped with."""
    return F.bit_or(F.expr("shiftleft(1L, cast(doc & 63 as int))"))


def _lines(pages: DataFrame) -> DataFrame:
    lines = pages.select("doc", "host", F.posexplode(normal_lines(F.col("text"))).alias("at", "line")).where(F.col("line") != "")
    return lines.select("doc", "host", (F.col("at") + 1).alias("line_no"), F.xxhash64("line").alias("line"))


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(host, line, word, bits): the words of the united bitmaps of a line's variants."""
    return lines.groupBy("host", "line", _word(F.col("doc")).alias("word")).agg(_bits(F.col("doc")).alias("bits"))


def repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, least_docs: int = 5, least_share: float = 0.2) -> DataFrame:
    """(id_col, line_no) of lines on at least least_docs pages and least_share of the pages of their host."""
    spark = df.sparkSession
    pages = _pages(df, id_col, url_col, text_col)
    lines = checkpointed(_lines(pages), spark)  # normalised once, read twice
    bitmaps = checkpointed(line_bitmaps(lines), spark)
    many = F.sum(F.bit_count("bits"))
    on_host = pages.groupBy("host", _word(F.col("doc")).alias("word")).agg(_bits(F.col("doc")).alias("bits")).groupBy("host").agg(many.alias("pages"))
    docs = bitmaps.groupBy("host", "line").agg(many.alias("docs")).where(F.col("docs") >= least_docs)
    common = join_large(docs, on_host, "host").where(F.col("docs") >= F.col("pages") * F.lit(least_share)).select("host", "line")
    kept = checkpointed(join_small(bitmaps, checkpointed(common, spark), ["host", "line"]), spark)
    found = join_small(lines.withColumn("word", _word(F.col("doc"))), kept, ["host", "line", "word"]).where(F.getbit("bits", F.col("doc").bitwiseAND(63).cast("int")) == 1)
    return found.select(F.col("doc").alias(id_col), "line_no").distinct()


def without_repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, **how) -> DataFrame:
    """df with the repeated lines taken out of text_col; other columns and rows stay as they are."""
    gone = repeated_lines(df, id_col, url_col, text_col, **how).groupBy(id_col).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(F.col("_gone"), F.array().cast("array<int>")), i + 1))
    joined = join_large(df, gone, df[id_col].cast("long") == gone[id_col], "left").drop(gone[id_col])
    return joined.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))).drop("_gone")
