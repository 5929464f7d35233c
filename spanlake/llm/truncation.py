"""Records whose text was cut off, by a classifier trained on artificial cuts.

Intact texts are cut at random places, as if by accident (with and without marks
of a cut) or at a field's limit (with the lifts that frequent lengths have); hashed logistic regression on
the closing characters, punctuation, the last line's form and how much oftener than
lengths near it the source has texts of exactly this length learns to tell them from uncut texts.
Some of the texts taken for intact are cut themselves: after a first fit those
scored as cut leave the negatives and the model is fitted again.

The training sample is bounded by ``sample_rows``; the lengths' lifts cover all
records, each measured against its host at any size, and every record is scored.  Null texts are not scored; an empty text is
whole.  Rows delivered again have one text and get one score each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanlake.llm.canonical import canonical_array
from spanlake.llm.common import host_of, join_large, join_small, pieces

BITS = 18
TAIL = 320  # closing characters that are looked at
MARKS = ("...", "…", " [...]", "�")  # appended to a share of the artificial cuts
_MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\.{3,}|…+|�+)\s*$")
_STOP = re.compile(r"[.!?؟。！？।۔;:]+[\"'”»’)\]」』“]*(?:\s+|$)|[。！？]+[」』”]?")
_END = re.compile(r"[.!?؟。！？।۔;][\"'”»’)\]」』“]*$")
_LIST = re.compile(r"^\s*(?:[-*•–—·]\s|\d{1,2}[.)]\s)")
_NAMED = re.compile(r"[A-ZÀ-Ý][a-zß-ÿ]+(?: [A-ZÀ-Ý][a-zß-ÿ]+){1,2}")
_THAI_GAP = re.compile(r"(?<=[\u0e00-\u0e7f]) (?=[\u0e00-\u0e7f])")
_WORD = re.compile(r"\w+|[^\w\s]")


def _bucket(n: int) -> int:
    return n if n < 4 else 4 if n < 6 else 6 if n < 10 else 10 if n < 30 else 30


def features(tail: str, same_length: int, lang: str) -> list[int]:
    """Hashed features of a text's closing characters."""
    out = [f"len {_bucket(same_length)}"]
    mark = _MARK.search(tail)
    kind = mark.group().strip()[:1] if mark else ""
    text = tail[: mark.start()] if mark else tail.rstrip()
    trailing = len(tail) - len(tail.rstrip())
    line_at = text.rfind("\n") + 1
    line = text[line_at:]
    before = text[:line_at].rstrip()
    low = re.sub(r"\d", "0", line.lower())
    pieces = [x for x in _STOP.split(line) if x.strip()]
    stopped = bool(_END.search(text))
    last = pieces[-1].strip() if pieces else ""
    inside = len(pieces) > 1
    words = _WORD.findall(last.lower())
    listed = bool(_LIST.match(line))
    form = f"{int(stopped)}{int(inside)}{int(listed)}{kind}"
    final = text[-1:] or " "
    cat = unicodedata.category(final)
    token = line.split()[-1] if line.split() else ""
    out += [
        f"form {form}", f"form {form} {lang}", f"cat {cat} {form}", f"trail {min(trailing, 2)} {form}", f"mark {kind}",
        f"words {min(len(words), 14)} {form}", f"cap {int(token[:1].isupper())} {form}", f"last {words[-1:]}", f"last2 {words[-2:]} {form}",
        f"first {words[:1]} {int(inside)}", f"first2 {words[:2]} {int(inside)}", f"firstlen {words[:1]} {min(len(words), 14)} {int(inside)}",
        f"prev {before[-1:]} {form}", f"prevlist {int(bool(_LIST.match(before[before.rfind(chr(10)) + 1 :])))} {form}",
        f"linelen {min(len(line) // 25, 8)} {form}", f"web {int('www.' in token or token[:1] in '#@' or '://' in token)} {form}",
        f"titled {sum(w[:1].isupper() for w in last.split())} {min(len(words), 10)} {int(inside)}",
        f"seps {sum(line.count(c) for c in '|·/›•')} {int(stopped)}", f"wordlen {min(len(token), 12)} {lang} {form}",
    ]
    if 0 < len(words) <= 6 and not inside:
        bare = _LIST.sub("", line)
        closing = f"{sum(w[:1].isupper() for w in bare.split())} of {len(bare.split())} {before[-1:]} {int(text[:line_at].endswith(chr(10) * 2))} {int(_END.search(bare) is not None)}"
        out += [f"closing {k} {closing} {int(listed) if k else ''}" for k in range(2)] + [f"closing {int(any(c.isdigit() for c in bare))} {closing} {min(len(words), 4)}"]
        out.append("shape " + " ".join("A" if w.isupper() else "Aa" if w[:1].isupper() else "0" if w.isdigit() else "a" if w.isalnum() else w for w in _WORD.findall(line)))
    out += [f"suffix {low[-k:]} {lang}" for k in range(1, 9)]
    if len(low) < 120:
        out.append(f"line {low}")
    return [crc32(x.encode("utf-8", "replace")) & ((1 << BITS) - 1) for x in out]


def _drawn(limits: list[tuple[int, int]], rng: np.random.Generator) -> int:
    """A bucket of limits, (bucket, lengths in it), by the share of its lengths."""
    at = int(rng.integers(sum(n for _, n in limits)))
    for bucket, n in limits:
        if at < n:
            return bucket
        at -= n
    raise AssertionError


def _cuts(text: str, limits: list[tuple[int, int]], rng: np.random.Generator, cuts: int) -> Iterator[tuple[str, int]]:
    """(cut text, length lift) for a few places inside words or sentences.

    Every second cut stands for one at a field's limit: it gets a lift that such
    lengths have in the collection, as no text of a limited field is longer.
    """
    for k in range(cuts):
        n = int(rng.integers(max(1, len(text) // 5), max(2, len(text))))
        at_limit = bool(limits) and k % 2 == 1
        count = _drawn(limits, rng) if at_limit else 1
        mark = MARKS[int(rng.integers(len(MARKS)))] if not at_limit and rng.random() < 0.3 else ""
        cut, rest = text[:n], text[n:]
        ended = cut.rstrip()
        if not rest.strip() or not ended or rest[0] == "\n" or cut[-1] == "\n" or (_END.search(ended) and not rest[0].isalnum()):
            continue
        yield (ended if mark or rng.random() < 0.5 else cut) + mark, count


def _whole(text: str, limits: list[tuple[int, int]], rng: np.random.Generator, wanted: int) -> Iterator[tuple[str, int]]:
    """(text up to the end of a line or Thai sentence, length lift): beginnings that stop at a natural end."""
    ends = [m.start() for m in _THAI_GAP.finditer(text)]
    lines = text.split("\n")
    at = 0
    for k, line in enumerate(lines[:-1]):
        at += len(line)
        after = next((x.lstrip() for x in lines[k + 1 :] if x.strip()), "")
        wrapped = not _END.search(line.rstrip()) and after[:1].islower() or line.rstrip()[-1:] in ",-"
        if line.strip() and not wrapped and (not lines[k + 1].strip() or len(line) < 45 or _LIST.match(after) or _END.search(line.rstrip())):
            ends += [at] * (1 if _END.search(line.rstrip()) else 2)
        at += 1
    for _ in range(wanted if ends else 0):
        n = ends[int(rng.integers(len(ends)))]
        count = _drawn(limits, rng) if limits and rng.random() < 0.05 else 1
        yield text[:n] + ("\n" if rng.random() < 0.1 else ""), count


def _signed(text: str, rng: np.random.Generator) -> Iterator[tuple[str, int]]:
    """A finished text closed by a line of two or three of its own capitalised words, as a signature is."""
    names = _NAMED.findall(text)
    ended = text.rstrip()
    if names and rng.random() < 0.3 and _END.search(ended):
        mark = ("", "", "- ", "— ")[int(rng.integers(4))]
        yield f"{ended}\n\n{mark}{names[int(rng.integers(len(names)))]}", 1


class CutModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        at = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(size.sum()))
        total = np.add.reduceat(self.weights[at], np.cumsum(size) - size)
        return 1 / (1 + np.exp(-(total + self.bias)))


class Hashed:
    """Rows of hashed features as one matrix: the features of all rows one after another, and how many each row has."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.begin = np.cumsum(size) - size

    @classmethod
    def once(cls, flat: np.ndarray, size: np.ndarray) -> Hashed:
        """Each feature once a row."""
        keys = np.unique(np.repeat(np.arange(len(size), dtype=np.int64), size) << BITS | flat.astype(np.int64))
        return cls(keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(size)))

    def picked(self, rows: np.ndarray) -> Hashed:
        size = self.size[rows]
        at = np.repeat(self.begin[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Hashed(self.flat[at], size)

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Sum of each row's entries in of, an array by feature."""
        out = np.zeros(len(self.size))
        full = np.flatnonzero(self.size)
        if len(full):
            out[full] = np.add.reduceat(of[self.flat], self.begin[full])
        return out


def fit(rows: Hashed, labels: np.ndarray, epochs: int = 6, seed: int = 7, rate: float = 0.1, decay: float = 2e-3, rare: int = 5) -> CutModel:
    """Logistic regression by Adagrad over shuffled batches of hashed rows."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(rows.flat, minlength=1 << BITS)
    known = np.flatnonzero(seen >= rare)  # a feature of few rows would only learn them by heart
    slot = np.full(1 << BITS, -1, dtype=np.int64)
    slot[known] = np.arange(len(known))
    kept = slot[rows.flat] >= 0
    dense = Hashed(slot[rows.flat[kept]], np.bincount(np.repeat(np.arange(len(rows.size)), rows.size)[kept], minlength=len(rows.size)))
    weights, squares, bias = np.zeros(len(known)), np.full(len(known), 1e-2), 0.0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows.size)), max(1, len(rows.size) // 128)):
            part = dense.picked(batch)
            error = 1 / (1 + np.exp(-(part.sums(weights) + bias))) - labels[batch]
            met = np.flatnonzero(np.bincount(part.flat, minlength=len(known)))
            grad = np.bincount(part.flat, np.repeat(error, part.size), minlength=len(known))[met] + decay * weights[met]
            squares[met] += grad**2
            weights[met] -= rate * grad / np.sqrt(squares[met])
            bias -= 0.01 * error.mean()
    whole = np.zeros(1 << BITS)
    whole[known] = weights
    return CutModel(whole, bias)


def held_out_scores(rows: Hashed, labels: np.ndarray, folds: int = 3, seed: int = 7) -> np.ndarray:
    """Each row's score by a model that has not seen it."""
    part = np.random.default_rng(seed).integers(folds, size=len(rows.size))
    out = np.zeros(len(rows.size))
    for k in range(folds):
        rest, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(rest) and len(own):
            model = fit(rows.picked(rest), labels[rest], epochs=3, seed=seed)
            out[own] = 1 / (1 + np.exp(-(rows.picked(own).sums(model.weights) + model.bias)))
    return out


def _with_lengths(df: DataFrame, id_col: str, url_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Each record with its host and the length of its text."""
    host = F.coalesce(host_of(F.col(url_col)), F.lit(""))
    slim = df.select(F.col(id_col).alias("id"), host.alias("host"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang")).where(F.col("text").isNotNull())
    return slim.withColumn("n", F.length("text"))


def length_lifts(base: DataFrame) -> DataFrame:
    """(host, n, same) for lengths that more records of a host have than lengths near them let expect.

    same is the count over one more than the count expected, the mean of the other
    lengths in the bin of a sixteenth of an octave and the bins beside it: near the
    count where a host has few records, and near 1 for any length met by chance.
    """
    counts = base.groupBy("host", "n", "id").agg(F.lit(1).alias("one")).groupBy("host", "n").agg(F.count("*").alias("count"))
    step = lambda k: F.ceil(F.pow(F.lit(2.0), k / F.lit(16.0)))
    counts = counts.withColumn("bin", F.floor(F.lit(16.0) * F.log2(F.greatest(F.col("n"), F.lit(1)))))
    bins = counts.groupBy("host", "bin").agg(F.sum("count").alias("near"))
    around = bins.withColumn("near", F.sum("near").over(Window.partitionBy("host").orderBy("bin").rangeBetween(-1, 1)))
    others = F.greatest(F.lit(1), step(F.col("bin") + 2) - step(F.col("bin") - 1) - 1)
    lift = F.round(F.col("count") / (1 + (F.col("near") - F.col("count")) / others)).cast("int")
    return join_large(counts, around, ["host", "bin"]).select("host", "n", lift.alias("same")).where("same > 1")


def sample_bound(wanted: int, total: int) -> int:
    """The greatest of the 64-bit hashes that put about wanted of total records into a sample, at any total."""
    return -(1 << 63) + min((1 << 64) - 1, (1 << 64) * wanted // max(1, total))


def truncated(
    df: DataFrame, id_col: str, text_col: str, url_col: str, lang_col: str, sample_rows: int = 12000, cuts: int = 3, threshold: float = 0.5, seed: int = 7
) -> DataFrame:
    """(id_col, host, score, truncated) for every record with a text."""
    from spanlake.session import checkpointed

    base = _with_lengths(df, id_col, url_col, text_col, lang_col)
    lifts = checkpointed(length_lifts(base), df.sparkSession)
    # how many lengths that stand for field limits fall in each bucket: at most four rows
    bucket = F.expr("case when same < 6 then 4 when same < 10 then 6 when same < 30 then 10 else 30 end")
    limits = sorted((r["bucket"], r["count"]) for r in lifts.where("same >= 4").groupBy(bucket.alias("bucket")).count().collect())
    # a bounded sample, by hash and so the same whatever the partitions
    total = base.count()
    chosen = F.xxhash64("id", F.lit(seed)) <= F.lit(sample_bound(sample_rows, total))
    sample = base.where(chosen).limit(2 * sample_rows)
    sample = join_small(sample, lifts, ["host", "n"], "left").select("text", "lang", F.coalesce("same", F.lit(1)).alias("same"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 0, 500_000)):
            texts, langs, same = (c.to_pylist() for c in batch.columns)
            tails, where, out = [], [], []
            for text, lang, count in zip(texts, langs, same):
                rng = np.random.default_rng([seed, crc32(text.encode())])
                where.append((0, count, lang))
                tails.append(text[-TAIL:])
                for end, c in (*_whole(text, limits, rng, cuts), *_signed(text, rng)):
                    where.append((0, c, lang))
                    tails.append(end[-TAIL:])
                for cut, c in _cuts(text, limits, rng, cuts):
                    where.append((1, c, lang))
                    tails.append(cut[-TAIL:])
            folded = canonical_array(pa.array(tails, pa.string())).to_pylist()
            out = [features(t, c, lang) for t, (_, c, lang) in zip(folded, where)]
            yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in where], pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["label", "features"])

    rows = sample.mapInArrow(label, "label int, features array<int>").toArrow()  # bounded by sample_rows
    if not rows.num_rows:
        if total:
            raise ValueError(f"no record of {total} fell into the sample of {sample_rows}")
        model = CutModel(np.zeros(1 << BITS), -1.0)
    else:
        lists = rows.column("features").combine_chunks()
        x, y = Hashed.once(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())), rows.column("label").to_numpy().astype(float)
        order = np.lexsort((x.sums(np.arange(1 << BITS, dtype=float) ** 2 % 1e9), x.size, y))  # the same whatever the order of arrival
        x, y = x.picked(order), y[order]
        for _ in range(2):
            clean = np.flatnonzero((y == 1) | (held_out_scores(x, y, seed=seed) < 0.5))
            x, y = x.picked(clean), y[clean]
        model = fit(x, y, seed=seed)
    weights, bias = model.weights.astype(np.float32), model.bias  # fixed size: 2 ** BITS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = CutModel(weights, bias)
        for batch in (x for b in batches for x in pieces(b, 2, 500_000)):
            tails = canonical_array(batch.column(2)).to_pylist()
            langs, same = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            p = fitted.score([features(t, c, lang) for t, c, lang in zip(tails, same, langs)])
            p = np.where([bool(t.strip()) for t in tails], p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], ["id", "host", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = base.select("id", "host", F.substring("text", -TAIL, TAIL).alias("tail"), "lang", "n")
    slim = join_small(slim, lifts, ["host", "n"], "left")
    scored = slim.select("id", "host", "tail", "lang", F.coalesce("same", F.lit(1)).alias("same")).mapInArrow(score, f"id {kind}, host string, score double")
    return scored.select(F.col("id").alias(id_col), "host", "score", (F.col("score") >= threshold).alias("truncated"))


def truncation_rates(scored: DataFrame, id_col: str) -> DataFrame:
    """Per host: records, truncated records and their share; ids count once."""
    once = scored.groupBy("host", id_col).agg(F.max("truncated").alias("cut"))
    return once.groupBy("host").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut_records"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))
