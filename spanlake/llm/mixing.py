"""A selection in which each source has its target share of the tokens.

Weighted fair queueing: each record of a source, in an order shuffled by a keyed
hash, gets a virtual finish time, the tokens of its source up to and with it over
the source's target share; its next use follows after one full pass of the
source.  By any moment of virtual time every source has given its share, up to
one record, so the selection is the global order by finish time, cut at the budget,
and is written in that order: read from its beginning, the mix is right at any point.

The global order is a range sort: each task sorts its range and sums the tokens in
it, one number per range carries the sums over, and the cut falls inside one range.
Running sums of a source are taken inside hash buckets of about ``bucket_rows``
records and carried over by the buckets' sums.  No source, slot or range is ever
gathered in one task.  Without a budget the largest one is taken that every source
can meet within its repeats.

Records of sources without a target, with null source or without tokens are left
out.  Ties in virtual time are broken by source, id and use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spanlake.llm.common import join_large, join_small


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: str) -> DataFrame:
    """Sum of value up to and with each row, in (bucket, order) order within keys; buckets are summed apart."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = join_large(df, sums, [*keys, bucket])
    return carried.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")


def _in_order(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df in the global order, with the sum of value up to and with each row."""
    from spanlake.session import checkpointed

    at = df.columns.index(value)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = full + np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            full = int(upto[-1]) if len(upto) else full
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(upto), part), pa.int32()), pa.array(upto, pa.int64())], [*batch.schema.names, "_part", out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    held = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, f"{fields}, _part int, `{out}` long"), df.sparkSession)
    at_start, starts = 0, []
    for part, total in sorted(tuple(r) for r in held.groupBy("_part").agg(F.max(out)).collect()):  # one row per range
        starts.append((part, at_start))
        at_start += total
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return held.join(F.broadcast(offsets), "_part").withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def mixed(sized: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens_col: str, budget: int | None = None, bucket_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """(id_col, source_col, copy_no, tokens_col, finish_time, tokens_upto) of the selection, in its order.

    targets: source, target_share, max_repeats (1 uses each record at most once).
    tokens_upto counts the tokens up to and with the record.
    sized should be cheap to read again (written or checkpointed).
    """
    goals = targets.select(F.col("source").alias(source_col), "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0")
    rows = join_small(sized.select(id_col, source_col, tokens_col).where(F.col(tokens_col) > 0), goals, [source_col])
    per_source = rows.groupBy(source_col).agg(F.sum(tokens_col).alias("_pass"), F.max(tokens_col).alias("_longest"), F.count("*").alias("_rows"), F.first("target_share").alias("_share"), F.first("max_repeats").alias("_most"))
    known = per_source.agg(F.min(F.col("_pass") * F.col("_most") / F.col("_share")).alias("b"), F.sum("_longest").alias("l")).first()
    feasible = int(known["b"] or 0)
    budget = feasible if budget is None else budget
    buckets = per_source.select(source_col, "_pass", F.ceil(F.col("_rows") / F.lit(float(bucket_rows))).alias("_buckets"))
    rows = join_small(rows, buckets, [source_col])
    rows = rows.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.col("_buckets")))
    rows = _running(rows, [source_col], ["_h", id_col], tokens_col, "_cum", "_bucket")
    uses = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    # the shares sum to one, so virtual time runs with the total; a source may be one record ahead
    finish = (F.col("_cum") + (F.col("copy_no") - 1) * F.col("_pass")) / F.col("target_share")
    uses = uses.select(id_col, source_col, "copy_no", tokens_col, finish.alias("finish_time"))
    shares = targets.where("target_share > 0").agg(F.sum("target_share")).first()[0] or 0.0
    if budget <= feasible and shares >= 1 - 1e-9:
        # at time t all sources together have given at least t less one record each: what lies further cannot be reached
        uses = uses.where(F.col("finish_time") <= F.lit(float(budget + (known["l"] or 0))))
    order = ["finish_time", source_col, id_col, "copy_no"]
    return _in_order(uses, order, tokens_col, "tokens_upto").where(F.col("tokens_upto") <= budget)


def reached_shares(selection: DataFrame, targets: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """(source, target_share, records, tokens, reached_share) for every target, 0 where nothing was selected."""
    got = selection.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("records"), F.sum(tokens_col).alias("tokens"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # over the targets, a short list
    both = targets.select("source", "target_share").join(got, "source", "left")
    return both.select(
        "source", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(total > 0, F.coalesce("tokens", F.lit(0)) / total).otherwise(0.0).alias("reached_share"),
    )


def selection_problems(selection: DataFrame, targets: DataFrame, id_col: str, source_col: str, tokens_col: str) -> DataFrame:
    """(source, off_share, over_repeats) of every selected source: is its share off by more than its longest record, and how many records are used too often or twice under one number?"""
    total = selection.agg(F.sum(tokens_col)).first()[0] or 0
    per = selection.groupBy(F.col(source_col).alias("source"), id_col).agg(F.count("*").alias("uses"), F.countDistinct("copy_no").alias("numbers"), F.sum(tokens_col).alias("tokens"), F.max(tokens_col).alias("longest"))
    both = per.join(F.broadcast(targets.select("source", "target_share", "max_repeats")), "source")
    wrong = F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") != F.col("numbers")))
    got = both.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("longest").alias("longest"), F.first("target_share").alias("share"), wrong.alias("over_repeats"))
    all_longest = got.agg(F.sum("longest")).first()[0] or 0
    off = F.abs(F.col("tokens") - F.col("share") * F.lit(total)) > F.col("longest") + F.col("share") * F.lit(all_longest)
    return got.select("source", off.cast("bigint").alias("off_share"), "over_repeats")
