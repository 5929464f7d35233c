"""The log rollups as Structured Streaming queries (an extension: the batch forms are in operators.weblog)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.functions.dates import local_day
from spanlake.operators.dedupe import first_by
from spanlake.operators.weblog import requests, views
from spanlake.sources.sinks import _files, current, point


def daily_stream(lines: DataFrame, late: str = "1 day", hours_behind: int = 7) -> DataFrame:
    """(day, views, networks_approx) per local day, as the batch form counts days; append mode once a day is past its watermark.

    Distinct networks are approximate here (a sketch as state) and exact in the batch form.
    """
    page_views = views(requests(lines)).withWatermark("at", late)
    day = F.window("at", "1 day", startTime=f"{hours_behind} hours")
    per = page_views.groupBy(day.alias("w")).agg(F.count("*").alias("views"), F.approx_count_distinct("net").alias("networks_approx"))
    return per.select(local_day(F.col("w.start"), hours_behind).alias("day"), "views", "networks_approx")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, began, ended, n): runs of a user's events without a longer gap."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(began, event_type, n, total): tumbling windows by type."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("began"), "event_type", "n", "total")


def upsert_batches(target: str):
    """A foreachBatch function that lays each batch beside the table as a delta; a batch costs what it holds.

    A batch that is run again replaces its own delta.  ``upserted`` reads the table,
    ``compacted`` folds the deltas into it.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/deltas/{epoch:020d}")

    return apply


def _state(spark: SparkSession, target: str) -> tuple[str | None, list[int]]:
    """(the folder of the compacted table, the epochs of the deltas that came after it)."""
    base = current(spark, f"{target}/base")
    upto = int(base.rsplit("-", 1)[1]) if base else -1
    fs, make = _files(spark, target)
    deltas = make(f"{target}/deltas")
    names = [s.getPath().getName() for s in fs.listStatus(deltas)] if fs.exists(deltas) else []
    return base, sorted(int(n) for n in names if int(n) > upto and fs.exists(make(f"{target}/deltas/{n}/_SUCCESS")))


def upserted(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    """The last row of each key by order; of rows that tie the one of the later batch."""
    base, epochs = _state(spark, target)
    parts = [spark.read.parquet(base).withColumn("_epoch", F.lit(-1).cast("long"))] if base else []
    parts += [spark.read.parquet(f"{target}/deltas/{e:020d}").withColumn("_epoch", F.lit(e).cast("long")) for e in epochs]
    if not parts:
        raise FileNotFoundError(f"no batch was written to {target}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return first_by(rows, [key], [F.col(order).desc(), F.desc("_epoch")]).drop("_epoch")


def compacted(spark: SparkSession, target: str, key: str, order: str) -> None:
    """Fold all deltas into a new version of the table, point to it, then remove them; readers see either state, never a part."""
    base, epochs = _state(spark, target)
    if not epochs:
        return
    version = f"v-{uuid.uuid4().hex}-{epochs[-1]}"
    upserted(spark, target, key, order).write.parquet(f"{target}/base/{version}")
    point(spark, f"{target}/base", version)
    fs, make = _files(spark, target)
    for e in epochs:
        fs.delete(make(f"{target}/deltas/{e:020d}"), True)
    if base:
        fs.delete(make(base), True)
