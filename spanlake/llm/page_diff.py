"""Main body of web pages by differencing each page against its nearest URLs.

Pages of one host are sorted by URL path; each page's lines are aligned with
those of its nearest pages by longest common subsequence (repeated on what is
left, for blocks that moved), and lines shared with several of them are page
furniture.  Lists of other posts carry new titles on every page; they are found
by their headings, which are shared lines that titles follow.  Rare furniture
that too few neighbours share is found by the keys deleted on other hosts.

A host with more pages than ``block_pages`` is cut into ranges of its sorted
paths, each with the nearest paths on either side of it, and the captures of a path
that holds many of them by a hash of the id, so a host or a page may hold any part
of all rows; what is learned from a host is summed over its ranges, so the result
is that of the whole host.  Captures of one path are never compared with each
other, nor are pages whose long lines are mostly the same: the search goes on
outward past them, and of pages with the same long lines one is a neighbour.

Null texts, and urls without a host, give no rows.  A page without neighbours
keeps all its lines.  Rows delivered again give their lines once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from spanlake.llm.common import host_of, join_large, join_small, path_of

_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_DATE = re.compile(r"^(?:0[.]? (?:de )?[^\W\d]+\.?(?: de)? 0|[^\W\d]+\.? 0(?:st|nd|rd|th)?,? 0|0[-./]0[-./]0)(?: ?[|·-] ?0 ?\w+\.?)?$")
_TRAIL = re.compile(r" ?[›»>] ?")
_END = re.compile(r"[.!?…。！？][\"'”»’)]*$")
_CUT = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\.{3}|…|\ufffd)\s*$")
_MARK = re.compile(r"^(?:[*•–-]|0[.)]) ")
_NAME = re.compile(r"[^\W\d_]{5,}")
_NOTE = re.compile(r" ?\(0 [^\W\d]+\.?\)$")


def line_key(line: str) -> str:
    """What two lines must agree in to be the same furniture."""
    x = _DIGITS.sub("0", _BLANKS.sub(" ", line.strip()).lower())
    if len(x) < 40 and _DATE.match(x):
        return "\x01date"
    if "›" in x:
        return "\x01trail " + _TRAIL.split(x, 1)[0]
    return x


def site_key(key: str, host: str) -> str:
    """key with the words that the host's name holds blanked out, to compare lines of different hosts."""
    return _NAME.sub(lambda m: "\x02" if m.group() in host else m.group(), key)


def _lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence over match points only (lines hardly repeat within a page)."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, k in enumerate(b):
        where[k].append(j)
    ends: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    at: list[int] = []
    for i, k in enumerate(a):
        for j in reversed(where.get(k, ())):
            p = bisect_left(ends, j)
            nodes.append((i, j, at[p - 1] if p else -1))
            if p == len(ends):
                ends.append(j)
                at.append(len(nodes) - 1)
            else:
                ends[p], at[p] = j, len(nodes) - 1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        i, j, n = nodes[n]
        out.append((i, j))
    return out[::-1]


def shared_lines(a: list[str], b: list[str], rounds: int = 3, in_a_at_all: frozenset[str] | None = None, in_b_at_all: frozenset[str] | None = None) -> tuple[list[int], list[int]]:
    """Indices of lines of a and of b that repeated alignment pairs up; the sets of either's lines may be given."""
    of_a, of_b = in_a_at_all or frozenset(a), in_b_at_all or frozenset(b)
    left, right = [i for i, k in enumerate(a) if k in of_b], [j for j, k in enumerate(b) if k in of_a]
    in_a: list[int] = []
    in_b: list[int] = []
    for _ in range(rounds):
        if not left or not right:
            break
        pairs = _lcs([a[i] for i in left], [b[j] for j in right])
        if not pairs:
            break
        in_a += [left[i] for i, _ in pairs]
        in_b += [right[j] for _, j in pairs]
        gone_a, gone_b = {i for i, _ in pairs}, {j for _, j in pairs}
        left = [x for i, x in enumerate(left) if i not in gone_a]
        right = [x for j, x in enumerate(right) if j not in gone_b]
    return in_a, in_b


def _title_like(key: str) -> bool:
    return 0 < len(key) < 130 and not _MARK.match(key) and (not _END.search(key) or bool(_NOTE.search(key)))


def _eligible(key: str) -> bool:
    """May the line be a heading of a list?"""
    return not (_END.search(key) or key[0] == "\x01" or len(key) > 60)


def _long_keys(keys: list[str]) -> frozenset[str]:
    return frozenset(k for k in keys if len(k) > 150)


def _keys(text: str) -> list[tuple[int, str]]:
    return [(n, line_key(x)) for n, x in enumerate(text.split("\n"), 1) if x.strip()]


class Aligned:
    """Pages of a range of a host's sorted paths, with the lines that each page shares with its neighbours.

    Only pages that are own are compared.  more tells of either side whether the host has
    paths beyond those given; ``complete`` is false if a page needed them.
    """

    def __init__(self, ids: list, paths: list[str], texts: list[str], own: list[bool] | None = None, more: tuple[bool, bool] = (False, False), neighbours: int = 12, votes: int = 2):
        self.pages: list[tuple[int, str, list[int], list[str]]] = []
        mine: list[bool] = []
        slots: dict = {}
        for r in sorted(range(len(ids)), key=lambda i: (paths[i], ids[i])):
            if (at := slots.get(ids[r])) is not None:
                mine[at] = mine[at] or own is None or own[r]
                continue
            slots[ids[r]] = len(mine)
            mine.append(own is None or own[r])
            numbered = _keys(texts[r])
            self.pages.append((r, paths[r], [n for n, _ in numbered], [k for _, k in numbered]))
        pages = self.pages
        order = [i for i in range(len(pages)) if not i or pages[i][1] != pages[i - 1][1]]  # one capture stands for its path
        slot = {pages[i][1]: s for s, i in enumerate(order)}
        long_keys = [_long_keys(p[3]) for p in pages]
        held = [frozenset(p[3]) for p in pages]
        self.own = [i for i in range(len(pages)) if mine[i]]
        self.complete = True
        self.shared: dict[int, set[int]] = {}
        self.rare: dict[int, set[int]] = {}
        for i in self.own:
            near: list[int] = []
            groups: set[frozenset[str]] = set()

            def passed(j: int) -> bool:
                """Is j a copy of the page under another address, or of a neighbour?"""
                both = long_keys[i] & long_keys[j]
                return long_keys[j] in groups or bool(both) and 2 * len(both) >= min(len(long_keys[i]), len(long_keys[j]))

            low, high = slot[pages[i][1]] - 1, slot[pages[i][1]] + 1
            back = True
            while len(near) < neighbours:
                while low >= 0 and passed(order[low]):
                    low -= 1
                while high < len(order) and passed(order[high]):
                    high += 1
                if (low < 0 and more[0]) or (high >= len(order) and more[1]):
                    self.complete = False
                    return
                if low < 0 and high >= len(order):
                    break
                if (back and low >= 0) or high >= len(order):
                    j, low = order[low], low - 1
                else:
                    j, high = order[high], high + 1
                near.append(j)
                if long_keys[j]:
                    groups.add(long_keys[j])
                back = not back
            counts: Counter = Counter()
            for j in near:
                counts.update(set(shared_lines(pages[i][3], pages[j][3], 3, held[i], held[j])[0]))
            need = votes if len(near) > 4 else 1
            self.shared[i] = {x for x, n in counts.items() if n >= need}
            # a post that other pages list as well is still a title, not furniture of the whole host
            self.rare[i] = {x for x in self.shared[i] if counts[x] * 5 <= len(near) * 2}

    def _listed(self, i: int, y: int) -> bool:
        return (y not in self.shared[i] or y in self.rare[i]) and _title_like(self.pages[i][3][y])

    def headings(self) -> dict[str, list[int]]:
        """Shared lines that may head a list: on how many pages titles follow, and on how many they stand."""
        follows: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for i in self.own:
            keys = self.pages[i][3]
            for x in self.shared[i]:
                if _eligible(keys[x]):
                    f = follows[keys[x]]
                    f[1] += 1
                    f[0] += x + 2 < len(keys) and all(self._listed(i, y) for y in (x + 1, x + 2))
        return follows

    def whole(self) -> list[str]:
        return sorted({self.pages[i][3][x] for i in self.own for x in self.shared[i]})

    def below(self, i: int) -> dict[int, list[str]]:
        """Lines of a page that may be listed posts, each with the lines that may head their list."""
        keys = self.pages[i][3]
        out: dict[int, list[str]] = defaultdict(list)
        for x in sorted(self.shared[i]):
            if _eligible(keys[x]):
                y = x + 1
                while y < len(keys) and self._listed(i, y):
                    out[y].append(keys[x])
                    y += 1
        return out

    def ending(self, i: int) -> str | None:
        """The page's last line without a mark of a cut, if it may be the beginning of a shared line."""
        keys = self.pages[i][3]
        if not keys or len(keys) - 1 in self.shared[i]:
            return None
        cut = _CUT.sub("", keys[-1]).rstrip()
        return cut if len(cut) >= 6 else None


def _heads(yes: int, of: int) -> bool:
    """Do titles follow on at least two pages in three?"""
    return yes * 3 >= of * 2


def furniture(ids: list, paths: list[str], texts: list[str], neighbours: int = 12, votes: int = 2) -> list[tuple[int, int, str, int]]:
    """(row, line number, key, verdict) for non-blank lines; verdict 1 shared, 2 listed post, 0 kept."""
    found = Aligned(ids, paths, texts, None, (False, False), neighbours, votes)
    heads = {k for k, (yes, of) in found.headings().items() if _heads(yes, of)}
    whole = found.whole()
    out = []
    for i in found.own:
        r, _, numbers, keys = found.pages[i]
        listed = {y for y, above in found.below(i).items() if any(k in heads for k in above)}
        cut = found.ending(i)
        if cut is not None:
            at = bisect_left(whole, cut)
            if at < len(whole) and whole[at].startswith(cut) and whole[at] != cut:
                listed.add(len(keys) - 1)
        for x, n in enumerate(numbers):
            out.append((r, n, keys[x], 1 if x in found.shared[i] else 2 if x in listed else 0))
    return out


def _looks(keys: list[str], host: str) -> list[bytes]:
    """What each line is looked up by on other hosts."""
    known: dict[str, bytes] = {}
    grams = {x for i in range(len(host) - 4) if (x := host[i : i + 5]).isalpha()}  # a word of five letters or more in the name holds one
    for k in keys:
        if k not in known:
            own = site_key(k, host) if any(g in k for g in grams) else k
            known[k] = hashlib.blake2b(own.encode("utf-8", "replace"), digest_size=16).digest()
    return [known[k] for k in keys]


def _ranges(large: DataFrame, block_pages: int) -> DataFrame:
    """(host, path, first_id, sig, captures, rank, block): the paths of large hosts in order, cut where about block_pages pages are full."""
    spark = large.sparkSession
    kind = large.schema["id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = []
            for text in batch.column(3).to_pylist():
                long = _long_keys([k for _, k in _keys(text)])
                sig.append(hashlib.blake2b("\n".join(sorted(long)).encode("utf-8", "replace"), digest_size=16).hexdigest() if long else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sig, pa.string())], ["id", "host", "path", "sig"])

    slim = large.select("id", "host", "path", "text").mapInArrow(signed, f"id {kind}, host string, path string, sig string")
    one = slim.groupBy("host", "path").agg(F.min(F.struct("id", "sig")).alias("first"), F.count("*").alias("captures"))
    one = one.select("host", "path", F.col("first.id").alias("first_id"), F.coalesce("first.sig", F.concat(F.lit("/"), "path")).alias("sig"), "captures", F.least("captures", F.lit(max(1, block_pages // 4))).alias("w"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            w = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            before = full + np.cumsum(w) - w
            extra = [pa.array(np.full(len(w), part), pa.int32()), pa.array(rank + np.arange(len(w)), pa.int64()), pa.array(before, pa.int64())]
            rank, full = rank + len(w), full + int(w.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "rank", "before"])

    schema = f"host string, path string, first_id {kind}, sig string, captures long, w long, part int, rank long, before long"
    rows = _settled(one.repartitionByRange("host", "path").sortWithinPartitions("host", "path").mapInArrow(numbered, schema), spark)
    at = [0, 0]
    offsets = []
    for part, n, w in sorted(tuple(r) for r in rows.groupBy("part").agg(F.count("*"), F.sum("w")).collect()):  # one row per partition
        offsets.append((part, *at))
        at = [at[0] + n, at[1] + w]
    offset = spark.createDataFrame(offsets or [(0, 0, 0)], "part int, ranks long, pages long")
    rows = rows.join(F.broadcast(offset), "part").withColumn("rank", F.col("rank") + F.col("ranks")).withColumn("before", F.col("before") + F.col("pages"))
    rows = join_small(rows, rows.groupBy("host").agg(F.min("before").alias("base")), ["host"])
    return _settled(rows.select("host", "path", "first_id", "sig", "captures", "rank", F.floor((F.col("before") - F.col("base")) / block_pages).cast("int").alias("block")), spark)


def _halo(ranges: DataFrame, most: int, reach: int) -> DataFrame:
    """(host, block, side, rank): the most nearest paths on either side of each range, one of those with the same long lines, out of reach ranges."""

    def ends(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("rank").to_pylist(), table.column("sig").to_pylist()))
        out = []
        for side, line in ((1, rows), (-1, rows[::-1])):  # a range's first paths lie after the ranges before it
            seen: dict[str, int] = {}
            for rank, sig in line:
                if len(seen) == most:
                    break
                seen.setdefault(sig, rank)
            out += [(side, rank, sig) for sig, rank in seen.items()]
        n = len(out)
        return pa.table({"host": table.column("host").slice(0, 1).take(pa.array([0] * n)), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int32()), "side": pa.array([o[0] for o in out], pa.int32()), "rank": pa.array([o[1] for o in out], pa.int64()), "sig": pa.array([o[2] for o in out], pa.string())})

    def nearest(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        seen: dict[str, int] = {}
        for rank, sig in sorted(zip(table.column("rank").to_pylist(), table.column("sig").to_pylist()), reverse=side == -1):
            if len(seen) == most:
                break
            seen.setdefault(sig, rank)
        n = len(seen)
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * n, pa.string()), "block": pa.array([table.column("block")[0].as_py()] * n, pa.int32()), "side": pa.array([side] * n, pa.int32()), "rank": pa.array(list(seen.values()), pa.int64())})

    first = ranges.select("host", "block", "rank", "sig").groupBy("host", "block").applyInArrow(ends, "host string, block int, side int, rank long, sig string")
    # a range's paths are offered to the ranges within reach, never to a whole host
    offered = first.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("block", F.col("block") - F.col("side") * F.col("step")).where("block >= 0")
    return offered.groupBy("host", "block", "side").applyInArrow(nearest, "host string, block int, side int, rank long")


def _large_hosts(large: DataFrame, block_pages: int, neighbours: int, votes: int) -> DataFrame:
    """(id, line_no, look, verdict, host) of hosts that are cut into ranges."""
    spark = large.sparkSession
    kind = large.schema["id"].dataType.simpleString()
    ranges = _ranges(large, block_pages)
    parts = F.greatest(F.lit(1), F.ceil(F.col("captures") / F.lit(max(1, block_pages // 4))))
    placed = join_large(large, ranges, ["host", "path"])
    # captures of one path that are a large part of a range are spread by id; its first one stays
    placed = placed.withColumn("first", F.col("id") == F.col("first_id")).withColumn("part", F.when(F.col("first"), 0).otherwise(F.pmod(F.xxhash64("id"), parts)).cast("int"))
    columns = ["host", "block", "part", "last", "side", "own", "id", "path", "text"]
    own = placed.withColumn("side", F.lit(0)).withColumn("own", F.lit(True)).drop("last")
    firsts = placed.where("first").select("host", "block", "rank", "id", "path", "text")
    last = ranges.groupBy("host").agg(F.max("block").alias("last"))
    todo = _settled(join_large(placed.select("host", "block", "part").distinct(), last, "host"), spark)

    def difference(most: int, reach: int):
        def run(table: pa.Table) -> pa.Table:
            host, block, part, last = (table.column(c)[0].as_py() for c in ("host", "block", "part", "last"))
            ids, sides, paths = table.column("id"), table.column("side").to_pylist(), table.column("path").to_pylist()
            more = tuple(beyond or len({p for p, x in zip(paths, sides) if x == side}) >= most for side, beyond in ((-1, block - reach > 0), (1, block + reach < last)))
            found = Aligned(ids.to_pylist(), paths, table.column("text").to_pylist(), table.column("own").to_pylist(), more, neighbours, votes)
            rows = []  # (row, line, look, verdict, name, yes, of, heads)
            if not found.complete:
                rows.append((None, None, None, -1, None, None, None, None))
            else:
                rows += [(None, None, None, 3, k, None, None, None) for k in found.whole()]
                rows += [(None, None, None, 4, k, yes, of, None) for k, (yes, of) in found.headings().items()]
                for i in found.own:
                    r, _, numbers, keys = found.pages[i]
                    below, cut, looks = found.below(i), found.ending(i), _looks(keys, host)
                    for x, n in enumerate(numbers):
                        rows.append((r, n, looks[x], int(x in found.shared[i]), cut if x == len(keys) - 1 else None, None, None, below.get(x)))
            cols = list(zip(*rows)) or [()] * 8
            types = (pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            look, verdict, name, yes, of, heads = (pa.array(c, t) for c, t in zip(cols[2:], types))
            n = len(rows)
            return pa.table({"id": ids.take(pa.array(cols[0], pa.int64())), "line_no": pa.array(cols[1], pa.int32()), "look": look, "verdict": verdict, "name": name, "yes": yes, "of": of, "heads": heads, "host": pa.array([host] * n, pa.string()), "block": pa.array([block] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "last": pa.array([last] * n, pa.int32())})

        return run

    schema = f"id {kind}, line_no int, look binary, verdict int, name string, yes int, of int, heads array<string>, host string, block int, part int, last int"
    most, reach, lines = 4 * neighbours, 2, None
    while True:  # until no page needs a path beyond those beside its range
        beside = join_large(join_large(_halo(ranges, most, reach), todo, ["host", "block"]), firsts.drop("block"), ["host", "rank"]).withColumn("own", F.lit(False)).select(*columns)
        within = join_large(firsts, todo.where("part > 0"), ["host", "block"]).withColumn("side", F.lit(0)).withColumn("own", F.lit(False)).select(*columns)
        tasks = join_large(own, todo, ["host", "block", "part"]).select(*columns).unionByName(within).unionByName(beside)
        out = _settled(tasks.groupBy("host", "block", "part").applyInArrow(difference(most, reach), schema), spark)
        done = out.where("verdict >= 0")
        lines = done if lines is None else lines.unionByName(done)
        todo = out.where("verdict < 0").select("host", "block", "part", "last")
        if todo.isEmpty():
            break
        most, reach = 8 * most, 8 * reach

    heads = lines.where("verdict = 4").groupBy("host", "name").agg(F.sum("yes").alias("yes"), F.sum("of").alias("of")).where(_heads(F.col("yes"), F.col("of"))).select("host", "name")
    listed = join_small(lines.where("verdict = 0").select("host", "id", "line_no", F.explode("heads").alias("name")), heads, ["host", "name"]).select("host", "id", "line_no")
    text = lines.where("verdict in (0, 1) and name is not null")
    keys = lines.where("verdict = 3").select("host", "name", F.lit(1).alias("key")).distinct().unionByName(text.select("host", "name", F.lit(0).alias("key")).distinct())
    order = Window.partitionBy("host", F.substring("name", 1, 6)).orderBy(F.desc("name"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    follow = keys.withColumn("next", F.last(F.when(F.col("key") == 1, F.col("name")), ignorenulls=True).over(order))
    begun = follow.where((F.col("key") == 0) & F.startswith("next", "name") & (F.col("next") != F.col("name"))).select("host", "name")
    ended = join_small(text.select("host", "id", "line_no", "name"), begun, ["host", "name"]).select("host", "id", "line_no")
    extra = listed.unionByName(ended).distinct().withColumn("listed", F.lit(True))
    lines = join_large(lines.where("verdict in (0, 1)"), extra, ["host", "id", "line_no"], "left")
    return lines.select("id", "line_no", "look", F.when((F.col("verdict") == 0) & F.col("listed"), 2).otherwise(F.col("verdict")).alias("verdict"), "host")


def page_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, block_pages: int = 1024, neighbours: int = 12, votes: int = 2, hosts: int = 3) -> DataFrame:
    """(id_col, line_no, furniture boolean) for each non-blank line of every page."""
    pages = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(text_col).alias("text"))
    pages = pages.where(F.col("host").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    large = _settled(pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > block_pages).select("host", F.lit(True).alias("large")), df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def difference(table: pa.Table) -> pa.Table:
        ids, host = table.column("id"), table.column("host")[0].as_py()
        found = furniture(ids.to_pylist(), table.column("path").to_pylist(), table.column("text").to_pylist(), neighbours, votes)
        return pa.table({
            "id": ids.take(pa.array([f[0] for f in found], pa.int64())).combine_chunks(),
            "line_no": pa.array([f[1] for f in found], pa.int32()),
            "look": pa.array(_looks([f[2] for f in found], host), pa.binary()),
            "verdict": pa.array([f[3] for f in found], pa.int32()),
            "host": pa.array([host] * len(found), pa.string()),
        })

    marked = join_small(pages, large, ["host"], "left")
    lines = marked.where("large is null").drop("large").groupBy("host").applyInArrow(difference, f"id {kind}, line_no int, look binary, verdict int, host string")
    lines = _settled(lines, df.sparkSession)
    if not large.isEmpty():
        lines = lines.unionByName(_settled(_large_hosts(marked.where("large").drop("large"), block_pages, neighbours, votes), df.sparkSession))
    known = (
        lines.where("verdict = 1")
        .groupBy("look", "host").agg(F.lit(1).alias("one"))
        .groupBy("look").agg(F.count("*").alias("on_hosts")).where(F.col("on_hosts") >= hosts)
        .select("look", F.lit(True).alias("known"))
    )
    lines = join_small(lines, known, ["look"], "left")
    return lines.select(F.col("id").alias(id_col), "line_no", ((F.col("verdict") > 0) | F.coalesce(F.col("known"), F.lit(False))).alias("furniture"))


def _settled(df: DataFrame, spark) -> DataFrame:
    """Cut the lineage in the shared folder, so that the differencing runs once."""
    from spanlake.session import checkpointed

    return checkpointed(df, spark)


def main_body(df: DataFrame, id_col: str, url_col: str, text_col: str, **how) -> DataFrame:
    """df's id and text with the furniture lines taken out; pages that lose all lines keep an empty text."""
    drop = page_lines(df, id_col, url_col, text_col, **how).where("furniture").groupBy(id_col).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(F.col("gone"), F.array().cast("array<int>")), i + 1))
    return join_large(df.select(id_col, text_col), drop, id_col, "left").select(id_col, F.array_join(kept, "\n").alias("main_text"))
