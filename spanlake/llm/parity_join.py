"""Near-duplicate records by a parity-sketch join on word sets.

Records with the same set of words form one class and are represented once.  Of
two sets with Jaccard similarity at least t and sizes a and b, at most
d = (1 - t) / (1 + t) * (a + b) words differ.  The words are hashed into P parts.
A part is held as the XOR of its words' 64-bit hashes (a parity sketch: each
difference flips it); two parts with few differences have the same XOR once those
words are taken out on either side, so they meet by equality.  P depends on the
band of the sum a + b, so both sides of a pair cut their words alike; a record
takes part in each band its partners can lie in.

How many words are taken out is the level of a part, and a record has the least
levels at which no partner can be missed without a part that is empty once words
are taken out: every missed part with words in common differs by more than its
level, every other one by at least the record's own words in it, so the levels are
enough if d < sum over parts of min(level + 1, words).  Levels rise part by part in
one fixed order, so of two records the one with the lower levels suffices for both,
and empty remainders, which nearly all records of a band would share, are never
signatures.  Records whose words lie in too few parts for that (a few in a thousand
of those with a dozen words) add them, and meet each other there.

Every signature carries a bit sketch in which each word flips one bit; the
Hamming distance of two sketches never exceeds the number of differing words and
discards most meetings at once.  What is left is verified on the words.  Nothing
is capped: all meetings of all signatures are examined.  All joins between records
are merge joins; nothing that grows with the records is broadcast.

Words are the longest runs of letters or digits, lower-cased.  Values without a
word (null, empty, only marks) are in no class and no pair.  Rows repeated under
one id count once; if one id has several values, each value takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanlake.llm.common import list_pieces

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, words as sorted 64-bit hashes) of every row with a word."""
    words = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).where(F.col("id").isNotNull() & (F.size("w") > 0))
    hashed = words.select("id", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("words"))
    return hashed.select("id", F.md5(F.concat_ws(",", F.col("words").cast("array<string>"))).alias("class_id"), "words")


SIGNATURES_PER_WORD = 1.7  # about as many as measured, to size partitions
PER_PART = 2  # differences that a part allows for; more make parts larger, meetings fewer and signatures more


def band_budget(k: int, per_part: int = PER_PART) -> int:
    """Differences that 2**k parts allow for."""
    return per_part * 2**k - 1


def part_levels(count: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Level of each part, (records, parts): the first in order, part by part, at which d < sum of min(level + 1, count); -1 where most is not enough.

    count: words of each record in each part; d: differences of each record, at most.
    """
    records, parts = count.shape
    step = np.full(records, -1, dtype=np.int64)
    reached = np.minimum(1, count).sum(axis=1)
    step[d < reached] = 0
    for level in range(most):
        gain = np.cumsum(count > level + 1, axis=1)  # a part raised to level + 1 adds one if it has the words
        enough = gain >= (d - reached + 1)[:, None]
        now = (step < 0) & enough[:, -1]
        step[now] = level * parts + enough[now].argmax(axis=1) + 1
        reached = reached + gain[:, -1]
    levels = step[:, None] // parts + (np.arange(parts) < step[:, None] % parts)
    return np.where(step[:, None] < 0, -1, levels)


def signatures(words: np.ndarray, doc: np.ndarray, size: np.ndarray, threshold: float, sizes: np.ndarray, per_part: int = PER_PART) -> tuple[np.ndarray, ...]:
    """(doc, signature, words taken out, level of the part) of all records; words are their hashes, doc the record of each.

    sizes are the sizes that occur at all, in order: a record skips a band if none
    of them would give a sum in it.
    """
    rate = (1 - threshold) / (1 + threshold)
    least, most = size * (1 + threshold), size * (1 + 1 / threshold)  # sums a partner can give
    out: list[tuple[np.ndarray, ...]] = []
    k = 0
    while True:
        budget = band_budget(k, per_part)
        low = (band_budget(k - 1, per_part) + 1) / rate if k else 0.0  # this band: low <= sum < high
        high = (budget + 1) / rate
        # sums are whole numbers and differences are rounded down, hence the margins of one
        first_size = np.searchsorted(sizes, np.maximum(size * threshold - 1, low - 1 - size))
        last_size = np.searchsorted(sizes, np.minimum(size / threshold + 1, high + 1 - size), side="right")
        here = np.flatnonzero((most >= low - 1) & (least < high + 1) & (first_size < last_size))
        if len(here):
            parts = 2**k
            slot = np.full(len(size), -1, dtype=np.int64)
            slot[here] = np.arange(len(here))
            mine = slot[doc] >= 0
            w, at = words[mine], slot[doc[mine]]
            cell = at * parts + (_mix(w) >> np.uint64(40)).astype(np.int64) % parts
            order = np.argsort(cell, kind="stable")
            w, cell = w[order], cell[order]
            count = np.bincount(cell, minlength=len(here) * parts)
            start = np.cumsum(count) - count
            xor = np.zeros(len(count), dtype=np.uint64)
            full = np.flatnonzero(count)
            if len(full):
                xor[full] = np.bitwise_xor.reduceat(w, start[full])
            d = np.minimum(np.floor(rate * (size[here] + sizes[last_size[here] - 1]) + 1e-9), budget).astype(np.int64)
            levels = part_levels(count.reshape(len(here), parts), d, per_part)
            bare = np.repeat(levels[:, 0] < 0, parts)  # these records also meet on empty remainders
            level = np.where(bare, per_part, levels.ravel())
            salt = _mix(np.arange(parts, dtype=np.uint64) + np.uint64(parts << 20))
            # remainders with more and more words taken out; a word is taken out after those before it
            part = np.flatnonzero((count > 0) | bare)
            next_word, rest, left, gone = start[part], xor[part], count[part], 0
            while len(part):
                keep = (left > 0) | (bare[part] & (gone < per_part))
                p = part[keep]
                sig = _mix(rest[keep] + salt[p % parts])
                out.append((here[p // parts], sig.view(np.int64), np.full(len(p), gone, dtype=np.int8), level[p].astype(np.int8)))
                go = np.flatnonzero((level[part] > gone) & (left > 0))
                n = start[part[go]] + count[part[go]] - next_word[go]
                source = np.repeat(go, n)
                word = np.repeat(next_word[go] - np.cumsum(n) + n, n) + np.arange(n.sum())
                part, rest, left, next_word, gone = part[source], rest[source] ^ w[word], left[source] - 1, word + 1, gone + 1
        if not (most >= high - 1).any():
            break
        k += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int8)
    cols = [np.concatenate(x) for x in zip(*out)]
    order = np.argsort(cols[0], kind="stable")  # a record's rows stay together: they compress
    return tuple(c[order] for c in cols)


def bit_sketches(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n rows of four 64-bit words; each word of a record flips one bit of 256."""
    bits = (_mix(words ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & 255
    flat = np.bincount(doc * 256 + bits, minlength=n * 256) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, 256), axis=1, bitorder="little").view(np.int64).reshape(n, 4)


def _signature_rows(reps: DataFrame, threshold: float, sizes: np.ndarray, per_part: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in list_pieces(big, 1, 250_000):
                lists = batch.column(1)
                words = _mix(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(size)), size)
                sketch = bit_sketches(words, doc, len(size))
                at, sig, gone, level = signatures(words, doc, size, threshold, sizes, per_part)
                meta = size[at].astype(np.int64) << 16 | level.astype(np.int64) << 8 | gone
                for lo in range(0, len(at), 200_000):
                    x, rows = at[lo : lo + 200_000], slice(lo, lo + 200_000)
                    cols = [pa.array(sig[rows]), batch.column(0).take(pa.array(x)), pa.array(meta[rows]), *(pa.array(sketch[x, i]) for i in range(4))]
                    yield pa.RecordBatch.from_arrays(cols, ["sig", "rep", "meta", "s0", "s1", "s2", "s3"])

    return reps.select("rep", "words").mapInArrow(run, "sig long, rep long, meta long, s0 long, s1 long, s2 long, s3 long")


def representative_pairs(df: DataFrame, id_col: str, text_col: str, members: DataFrame, threshold: float, per_part: int = PER_PART, partition_bytes: int = 24 << 20) -> DataFrame:
    """(class_a, class_b, shared, size_a, size_b) for class pairs at or above the threshold, each once.

    members: id, class_id, size and short, the words' 31-bit hashes.  Signatures
    are cut from these (equal words stay equal, so no pair is lost); classes that
    met are read again from df and verified on 64 bits of every word.
    """
    from spanlake.llm.common import join_large, join_small
    from spanlake.session import checkpointed

    spark = df.sparkSession
    # as many rows as there are distinct sizes
    counts = {r["size"]: r["count"] for r in members.groupBy("size").count().collect()}
    sizes = np.array(sorted(counts), dtype=np.int64)
    # partitions of the signatures by their expected number, for sorts that stay in memory at any scale
    expected = SIGNATURES_PER_WORD * sum(size * n for size, n in counts.items()) * 56
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(expected // partition_bytes) + 1)
    reps = members.groupBy("class_id").agg(F.first("short").alias("words"))
    rows = _signature_rows(reps.select(F.xxhash64("class_id").alias("rep"), "words"), threshold, sizes, per_part)
    rate = (1 - threshold) / (1 + threshold)
    gone, level = F.col("meta").bitwiseAND(255), F.shiftright("meta", 8).bitwiseAND(255)
    l_gone, l_level = F.col("l_meta").bitwiseAND(255), F.shiftright("l_meta", 8).bitwiseAND(255)
    rows = rows.repartition(partitions, "sig")
    # the side with fewer words taken out comes first; with as many, the two orders give one.
    # Exploding nothing drops the others after the exchange, so both sides read one and the same
    few = F.explode(F.when(gone * 2 <= level, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("_few")
    a = rows.select("sig", *(F.col(c).alias("l_" + c) for c in rows.columns[1:]), few).drop("_few")
    once = (l_gone < gone) | ((l_gone == gone) & (F.col("l_rep") < F.col("rep")))
    sums = F.shiftright("l_meta", 16) + F.shiftright("meta", 16)
    far = sum((F.bit_count(F.col(f"l_s{i}").bitwiseXOR(F.col(f"s{i}"))) for i in range(1, 4)), F.bit_count(F.col("l_s0").bitwiseXOR(F.col("s0"))))
    near = (far <= sums * F.lit(rate) + F.lit(1e-9)) & (F.col("l_rep") != F.col("rep")) & once & (l_gone + gone <= F.least(l_level, level))
    met = join_large(a, rows, (a["sig"] == rows["sig"]) & near)
    pairs = checkpointed(met.select(F.least("l_rep", "rep").alias("ra"), F.greatest("l_rep", "rep").alias("rb")).distinct(), spark)
    asked = pairs.select(F.col("ra").alias("rep")).union(pairs.select("rb")).distinct()
    one_each = checkpointed(join_small(members.select(F.xxhash64("class_id").alias("rep"), "class_id", "id"), asked, ["rep"]).groupBy("rep", "class_id").agg(F.min("id").alias(id_col)), spark)
    met_rows = join_small(df.select(id_col, text_col), one_each.select(id_col).distinct(), [id_col])
    words = join_large(word_classes(met_rows, id_col, text_col), one_each.select("rep", "class_id"), "class_id").groupBy("rep", "class_id").agg(F.first("words").alias("words"))
    words = checkpointed(words, spark)
    both = join_large(join_large(pairs, words.toDF("ra", "class_a", "wa"), "ra"), words.toDF("rb", "class_b", "wb"), "rb")
    both = both.withColumn("shared", F.size(F.array_intersect("wa", "wb"))).withColumn("size_a", F.size("wa")).withColumn("size_b", F.size("wb"))
    enough = F.col("shared") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("shared")) - F.lit(1e-9)
    return both.where(enough).select("class_a", "class_b", "shared", "size_a", "size_b")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, per_part: int = PER_PART) -> tuple[DataFrame, DataFrame]:
    """(membership, links): id and class_id of every record with words, and the class pairs at or above the threshold.

    The two hold every near pair without listing those inside a class; ``groups`` makes one row per record of them.
    per_part changes the work, never the result.
    """
    from spanlake.session import checkpointed

    short = F.transform("words", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("short")
    members = checkpointed(word_classes(df, id_col, text_col).select("id", "class_id", F.size("words").alias("size"), short), df.sparkSession)
    return members.select("id", "class_id").distinct(), representative_pairs(df, id_col, text_col, members, threshold, per_part)


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records, within classes and across linked classes."""
    from spanlake.llm.common import join_large

    rows = members.select("id", "class_id")
    several = rows.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    across = links.select("class_a", "class_b").unionByName(several)
    both = join_large(join_large(across, rows.toDF("ia", "class_a"), "class_a"), rows.toDF("ib", "class_b"), "class_b").where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def groups(members: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, class_id, group_id, links): connected groups of classes, each named by its least id; links counts linked classes.

    The form to use on large collections: one row per record.  Alternates large-star
    and small-star steps on the class links until nothing changes; each step's edges
    are written to the shared folder.
    """
    from spanlake.llm.common import join_large
    from spanlake.session import checkpointed

    spark = members.sparkSession
    links = checkpointed(links.select("class_a", "class_b"), spark)
    edges, last = links.select(F.greatest("class_a", "class_b").alias("u"), F.least("class_a", "class_b").alias("v")).where("u <> v").distinct(), None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_large(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_large(down, small_low, "u")
        edges = checkpointed(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), spark)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "class_id")
    degree = links.select(F.col("class_a").alias("class_id")).union(links.select("class_b")).groupBy("class_id").agg(F.count("*").alias("links"))
    classes = members.groupBy("class_id").agg(F.min("id").alias("first"))
    classes = join_large(join_large(classes, root, "class_id", "left"), degree, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    classes = join_large(classes, classes.groupBy("root").agg(F.min("first").alias("group_id")), "root")
    out = join_large(members, classes, "class_id")
    return out.select("id", F.col("first").alias("class_id"), "group_id", F.coalesce("links", F.lit(0)).alias("links"))
