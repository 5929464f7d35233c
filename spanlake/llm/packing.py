"""Texts packed into containers of fixed capacity by vector best-fit.

An item has three sizes: tokens, one document, and attention cost (the square of
its tokens).  A container has a capacity for each: its tokens, a number of documents
in proportion to them, and a share of the attention cost of one text that fills it,
raised to that of the longest unsplit text so that none is split for it.  Items are
taken largest first; of the containers that can still hold an item under every
constraint the one with the highest weighted dot product of item and residual, or
the smallest weighted norm of what would remain, is chosen.  A text is split only if
it alone exceeds the token capacity: into full pieces and a rest.

Items are packed in blocks of about ``block_items`` by a hash of the id, each
block in one task; containers filled less than ``settled`` are opened again and
their items packed in a second round, in fewer blocks.

Texts without tokens are in no container.  Ids must be unique.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.common import join_large

FIELDS = "item_id long, piece_no int, token_start long, token_end long, bin int, fill double"


def vector_best_fit(size: np.ndarray, capacity: int, documents: int, attention: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> np.ndarray:
    """The bin of each item; no item may exceed a capacity on its own."""
    order = np.argsort(-size, kind="stable")
    demand = np.stack([size / capacity, np.full(len(size), 1.0 / documents), size.astype(float) ** 2 / attention], axis=1)
    weight = np.asarray(weights)
    room = np.zeros((1024, 3))
    number = np.zeros(1024, dtype=np.int64)  # the bin behind each open row
    live = bins = 0
    out = np.zeros(len(size), dtype=np.int64)
    least = demand.min(axis=0) if len(size) else demand
    slack = 1e-12
    for i in order.tolist():
        d = demand[i]
        open_ = room[:live]
        fits = np.flatnonzero((open_ >= d - slack).all(axis=1))
        if len(fits):
            left = open_[fits]
            if rule == "dot":
                best = fits[int(np.argmax((left * d * weight).sum(axis=1)))]
            else:
                best = fits[int(np.argmin((weight * (left - d) ** 2).sum(axis=1)))]
        else:
            if live == len(room):
                room, number = np.vstack((room, np.zeros_like(room))), np.concatenate((number, np.zeros_like(number)))
            best, live = live, live + 1
            room[best], number[best] = 1.0, bins
            bins += 1
        room[best] -= d
        out[i] = number[best]
        if (room[best] < least - slack).any():  # nothing fits any more: take the row out
            live -= 1
            room[best], number[best] = room[live], number[live]
    return out


def _items(sized: DataFrame, id_col: str, tokens_col: str, profiles: list[tuple[int, int]]) -> DataFrame:
    """Each text as pieces, for each profile; only texts above a capacity have several."""
    each = F.array(*(F.struct(F.lit(p).alias("profile_id"), F.lit(c).alias("capacity_tokens")) for p, c in profiles))
    both = sized.select(F.col(id_col).cast("long").alias("item_id"), F.col(tokens_col).alias("n")).where("n > 0").select("*", F.inline(each))
    pieces = both.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("capacity_tokens")).cast("int"))))
    start = F.col("piece_no") * F.col("capacity_tokens").cast("long")
    return pieces.select("profile_id", "capacity_tokens", "item_id", "piece_no", start.alias("token_start"), F.least(F.col("n"), start + F.col("capacity_tokens")).alias("token_end"))


def packed(
    sized: DataFrame, id_col: str, tokens_col: str, profiles: DataFrame, block_items: int = 8192, settled: float = 0.95, rule: str = "norm", documents_per_token: float = 1 / 32,
    attention_share: float = 0.25,
) -> DataFrame:
    """(profile_id, container_id, item_id, piece_no, token_start, token_end).

    profiles (profile_id, capacity_tokens) is a short list of settings; more than
    1,000 rows are refused.  The document capacity is documents_per_token times the token
    capacity, at least one.  The attention capacity is attention_share of the token
    capacity's square, or the square of the profile's longest piece where that is more.
    """
    from spanlake.session import checkpointed

    spark = sized.sparkSession
    settings = sorted((r["profile_id"], r["capacity_tokens"]) for r in profiles.select("profile_id", "capacity_tokens").limit(1001).collect())
    if not 0 < len(settings) <= 1000:
        raise ValueError("profiles must be a short list of settings")

    def pack(table: pa.Table) -> pa.Table:
        start, end = (np.asarray(table.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("token_start", "token_end"))
        ids, piece = (np.asarray(table.column(c).to_numpy(zero_copy_only=False), dtype=np.int64) for c in ("item_id", "piece_no"))
        order = np.lexsort((piece, ids))  # the result does not depend on the order of arrival
        size, capacity = (end - start)[order], table.column("capacity_tokens")[0].as_py()
        attention = max(attention_share * float(capacity) ** 2, float(table.column("longest")[0].as_py()) ** 2)
        bins = np.empty(len(order), dtype=np.int64)
        bins[order] = vector_best_fit(size, capacity, max(1, int(capacity * documents_per_token)), attention, rule)
        fill = np.bincount(bins, weights=end - start)[bins] / capacity
        out = {c: table.column(c) for c in ("profile_id", "capacity_tokens", "longest", "block", "item_id", "piece_no", "token_start", "token_end")}
        return pa.table(out | {"bin": pa.array(bins, pa.int64()), "fill": pa.array(fill, pa.float64())})

    schema = "profile_id int, capacity_tokens int, longest long, block int, item_id long, piece_no int, token_start long, token_end long, bin long, fill double"

    def one_round(items: DataFrame, salt: int) -> DataFrame:
        counts = items.groupBy("profile_id").agg(F.count("*").alias("items"))
        blocked = items.join(F.broadcast(counts), "profile_id")
        blocks = F.ceil(F.col("items") / F.lit(float(block_items)))
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64("item_id", "piece_no", F.lit(salt)), blocks).cast("int"))
        shaped = blocked.select(F.col("profile_id").cast("int"), F.col("capacity_tokens").cast("int"), F.col("longest").cast("long"), "block", "item_id", F.col("piece_no").cast("int"), F.col("token_start").cast("long"), F.col("token_end").cast("long"))
        return checkpointed(shaped.groupBy("profile_id", "block").applyInArrow(pack, schema), spark)

    columns = ["profile_id", "container_id", "item_id", "piece_no", "token_start", "token_end"]
    name = lambda r: F.concat_ws("-", F.lit(r), F.col("block"), F.col("bin")).alias("container_id")
    items = _items(sized, id_col, tokens_col, settings)
    longest = items.groupBy("profile_id").agg(F.max(F.col("token_end") - F.col("token_start")).alias("longest"))
    first = one_round(items.join(F.broadcast(longest), "profile_id"), 1)
    second = one_round(first.where(F.col("fill") < settled).drop("block", "bin", "fill"), 2)
    done = first.where(F.col("fill") >= settled).select("profile_id", name(1), *columns[2:])
    return done.unionByName(second.select("profile_id", name(2), *columns[2:]))


def containers(result: DataFrame, profiles: DataFrame, documents_per_token: float = 1 / 32, attention_share: float = 0.25) -> DataFrame:
    """(profile_id, container_id, tokens, documents, attention and the capacity of each) of every container."""
    n = F.col("token_end") - F.col("token_start")
    per = result.groupBy("profile_id", "container_id").agg(F.sum(n).alias("tokens"), F.count("*").alias("documents"), F.sum(n.cast("double") * n).alias("attention"), F.max(n).alias("longest"))
    longest = per.groupBy("profile_id").agg(F.max("longest").alias("longest"))
    room = profiles.select(F.col("profile_id").cast("int").alias("profile_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).join(longest, "profile_id")
    room = room.select(
        "profile_id", "capacity_tokens", F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * F.lit(documents_per_token))).alias("capacity_documents"),
        F.greatest(F.lit(attention_share) * F.pow("capacity_tokens", F.lit(2.0)), F.pow("longest", F.lit(2.0))).alias("capacity_attention"),
    )
    return per.drop("longest").join(F.broadcast(room), "profile_id")


def fill_report(result: DataFrame, profiles: DataFrame, **how) -> DataFrame:
    """Per profile: containers, tokens, the share of each capacity used, and in how many containers one more document, or its attention, would not fit."""
    share = lambda x: F.round(F.sum(x) / F.sum(f"capacity_{x}"), 6)
    return containers(result, profiles, **how).groupBy("profile_id").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), share("tokens").alias("fill_share"), share("documents").alias("document_share"), share("attention").alias("attention_share"),
        F.count_if(F.col("documents") == F.col("capacity_documents")).alias("full_of_documents"), F.count_if(F.col("attention") >= 0.99 * F.col("capacity_attention")).alias("full_of_attention"),
    )


def packing_problems(result: DataFrame, sized: DataFrame, id_col: str, tokens_col: str, profiles: DataFrame, **how) -> DataFrame:
    """(profile_id, texts, over_capacity, lost, split_needlessly): texts packed, containers above any capacity, texts whose pieces are not all of their tokens once, and texts split although they fit."""
    over = (F.col("tokens") > F.col("capacity_tokens")) | (F.col("documents") > F.col("capacity_documents")) | (F.col("attention") > F.col("capacity_attention") * (1 + 1e-9))
    full = containers(result, profiles, **how).groupBy("profile_id").agg(F.count_if(over).alias("over_capacity"))
    n = F.col("token_end") - F.col("token_start")
    pieces = result.groupBy("profile_id", "item_id").agg(F.count("*").alias("pieces"), F.sum(n).alias("packed"), F.max("token_end").alias("last"), F.countDistinct("token_start").alias("starts"))
    due = sized.where(F.col(tokens_col) > 0).select(F.col(id_col).cast("long").alias("item_id"), F.col(tokens_col).alias("n"), F.explode(F.array(*(F.lit(r["profile_id"]) for r in profiles.select("profile_id").limit(1000).collect()))).alias("profile_id"))
    room = profiles.select("profile_id", "capacity_tokens")
    both = join_large(due, pieces, ["profile_id", "item_id"], "full").join(F.broadcast(room), "profile_id")
    lost = F.coalesce((F.col("packed") != F.col("n")) | (F.col("last") != F.col("n")) | (F.col("starts") != F.col("pieces")), F.lit(True))
    per = both.groupBy("profile_id").agg(F.count("*").alias("texts"), F.count_if(lost).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("split_needlessly"))
    return per.join(F.broadcast(full), "profile_id").select(F.col("profile_id").cast("int").alias("profile_id"), "texts", "over_capacity", "lost", "split_needlessly")
