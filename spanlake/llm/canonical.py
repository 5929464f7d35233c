"""One form for text that reads the same although its characters differ.

An Arrow string column is decoded to one numpy array of code points.  A lookup
table gives each code point its expansion (width forms, joined letters, kinds of
blank, canonical decomposition) or nothing (invisible characters); the expansions
are gathered through offsets, look-alike letters are exchanged by a second gather,
marks are put in canonical order by one stable sort and composed with their bases
round by round.  No step calls anything per row.

There are two forms.  The key is for comparing: every letter that looks like a
Latin one becomes that, so values that read the same have equal keys.  The text is
for reading on: a look-alike is exchanged only where it is foreign to its word.  In a
word with Latin letters and none that only the other script has, it becomes Latin;
in a word with letters that only the other script has, the Latin ones become that
script's; a word of nothing but look-alikes becomes Latin in a text that has Latin
letters and none that only the other scripts have.  Russian and Greek words stay.

Kept apart: letter case, accents, punctuation, raised digits, line breaks and the
number of blanks.  Null stays null, empty stays empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.common import join_large, pieces

# Letters of other scripts that look like Latin ones, in pairs: Cyrillic, Greek, Armenian, Cherokee; then a few Latin twins.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜӀ" "аеорсухіјѕһԁԛԝүѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ" "ονϲ" "ՕՍԼօսոհ" "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ" "ɑɡ",
        "ABESIJKMHOPCTYXYGQWI" "aeopcyxijshdqwyvl" "ABEZHIKMNOPTYXCj" "ovc" "OULounh" "ABCEHJKLMPSTVWZ" "ag",
        strict=True,
    )
)
_SCRIPTS = {"LATIN": 2, "CYRILLIC": 3, "GREEK": 4, "ARMENIAN": 5, "CHEROKEE": 6}
# Characters that show nothing, beside those of category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def expansion(cp: int) -> list[int]:
    """What stands for one code point before composition."""
    ch = chr(cp)
    if cp in INVISIBLE or unicodedata.category(ch) == "Cf":
        return []
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return [0x20]
    form = unicodedata.decomposition(ch)
    if form.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06:
        return [y for x in form.split()[1:] for y in expansion(int(x, 16))] if not 0xFB00 <= cp <= 0xFB06 else [ord(x) for x in unicodedata.normalize("NFKC", ch)]
    if 0xAC00 <= cp <= 0xD7A3:
        return [cp]
    return [ord(x) for x in unicodedata.normalize("NFD", ch)]


def script(cp: int) -> int:
    """0 ends a word, 1 is a mark in one, 2 a Latin letter, 3 to 6 one of the scripts with look-alikes, 7 any other letter."""
    kind = unicodedata.category(chr(cp))[0]
    if kind == "M":
        return 1
    return _SCRIPTS.get(unicodedata.name(chr(cp), "").split(" ")[0], 7) if kind == "L" else 0


class _Tables:
    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.length = np.ones(0x110000, dtype=np.int64)
        self.at = np.zeros(0x110000, dtype=np.int64)
        self.rank = np.zeros(0x110000, dtype=np.uint8)  # canonical combining class
        self.script = np.zeros(0x110000, dtype=np.uint8)
        self.twin = np.zeros(0x110000, dtype=np.uint32)  # the Latin letter that a letter looks like
        self.back = np.zeros((8, 0x80), dtype=np.uint32)  # by script, the letter that looks like a Latin one
        for x, latin in reversed(LOOKALIKES.items()):
            self.twin[ord(x)] = ord(latin)
            self.back[script(ord(x)), ord(latin)] = ord(x)
        self.pool: list[int] = []
        self.composed: dict[int, int] = {}

    def learn(self, cps: np.ndarray) -> np.ndarray:
        for cp in np.unique(cps[~self.known[cps]]).tolist():
            out = expansion(cp)
            self.at[cp], self.length[cp], self.known[cp] = len(self.pool), len(out), True
            self.pool += out
            for x in out:
                self.rank[x], self.script[x] = unicodedata.combining(chr(x)), script(x)
        return np.array(self.pool, dtype=np.uint32)

    def compose(self, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The composite of each pair, or 0."""
        pairs, back = np.unique(base.astype(np.int64) << 21 | mark, return_inverse=True)
        for p in pairs.tolist():
            if p not in self.composed:
                one = unicodedata.normalize("NFC", chr(p >> 21) + chr(p & 0x1FFFFF))
                self.composed[p] = ord(one) if len(one) == 1 else 0
        return np.array([self.composed[p] for p in pairs.tolist()], dtype=np.uint32)[back]


_tables = _Tables()


def _exchanged(out: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Look-alikes exchanged where they are foreign to their word; see the text form above."""
    twin, kind = _tables.twin[out], _tables.script[out]
    inside = kind > 0
    fresh = inside & np.concatenate(([True], ~inside[:-1] | (row[1:] != row[:-1])))
    word = np.cumsum(fresh) - 1
    at = np.flatnonzero(inside)
    own = (kind >= 3) & (kind <= 6) & (twin == 0)  # letters that no Latin one looks like
    words, rows = int(fresh.sum()), int(row[-1]) + 1

    def any_of(mask: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(group[mask], minlength=n).astype(bool)

    latin, native = any_of((kind == 2) & inside, word, words), any_of(own, word, words)
    row_latin, row_native = any_of(kind == 2, row, rows), any_of(own, row, rows)
    alien = np.zeros(len(out), dtype=bool)
    w, r = word[at], row[at]
    alien[at] = (twin[at] > 0) & ((kind[at] == 2) | ~native[w] & (latin[w] | (row_latin[r] & ~row_native[r])))
    out = np.where(alien, twin, out)
    both = latin & native
    if both.any():
        which = np.zeros(words, dtype=np.uint8)
        which[word[own]] = kind[own]
        several = np.zeros(words, dtype=bool)
        several[word[own][which[word[own]] != kind[own]]] = True
        inner = np.flatnonzero(inside & (kind == 2))
        inner = inner[both[word[inner]] & ~several[word[inner]]]
        turned = np.where(out[inner] < 0x80, _tables.back[which[word[inner]], np.minimum(out[inner], 0x7F)], 0)
        stuck = any_of(turned == 0, word[inner], words)  # a word with other Latin letters stays
        turn = ~stuck[word[inner]]
        out[inner[turn]] = turned[turn]
    return out


def _fold(cps: np.ndarray, row: np.ndarray, text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points and the row of each; the text form or the key."""
    pool = _tables.learn(cps)
    size = _tables.length[cps]
    if not size.any():
        return cps[:0], row[:0]
    begin = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(begin, size)
    out = pool[np.repeat(_tables.at[cps], size) + within]
    row = np.repeat(row, size)
    if text:
        out = _exchanged(out, row)
    else:
        twin = _tables.twin[out]
        out = np.where(twin > 0, twin, out)
    rank = _tables.rank[out]
    if rank.any():
        run = np.cumsum((rank == 0) | np.concatenate(([True], row[1:] != row[:-1])))
        if ((rank[1:] < rank[:-1]) & (rank[1:] > 0) & (run[1:] == run[:-1])).any():
            order = np.lexsort((rank, run))  # stable: marks of equal class keep their order
            out, rank = out[order], rank[order]
        keep = np.ones(len(out), dtype=bool)
        base = np.flatnonzero((rank[:-1] == 0) & (rank[1:] > 0) & (row[1:] == row[:-1]))
        at, blocked = base + 1, np.zeros(len(base), dtype=np.int16)
        while len(base):
            one = _tables.compose(out[base], out[at])
            done = (one > 0) & (rank[at] != blocked)
            out[base[done]] = one[done]
            keep[at[done]] = False
            blocked = np.where(done, blocked, rank[at])
            on = (at + 1 < len(out)) & (rank[np.minimum(at + 1, len(out) - 1)] > 0) & (row[np.minimum(at + 1, len(out) - 1)] == row[at])
            base, at, blocked = base[on], at[on] + 1, blocked[on]
        out, row = out[keep], row[keep]
    for first, last, tail, count in ((0x1100, 0x1112, 0x1161, 21), (0, 0, 0x11A8, 27)):  # conjoining jamo
        if not ((out >= 0x1100) & (out <= 0x11FF)).any():
            break
        a, b = out[:-1].astype(np.int64), out[1:].astype(np.int64)
        same = row[:-1] == row[1:]
        if first:
            hit = same & (a >= first) & (a <= last) & (b >= tail) & (b < tail + count)
            whole = 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28
        else:
            hit = same & (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= tail) & (b < tail + count)
            whole = a + b - 0x11A7
        if hit.any():
            out = out.copy()
            out[:-1][hit] = whole[hit]
            keep = np.concatenate(([True], ~hit))
            out, row = out[keep], row[keep]
    return out, row


def canonical_array(array: pa.Array, text: bool = False) -> pa.Array:
    """The canonical strings of an Arrow string array: their keys, or their text form."""
    array = array.cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if not n:
        return array.cast(pa.string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    lengths = np.diff(starts[offsets - offsets[0]])
    out, row = _fold(cps, np.repeat(np.arange(n), lengths), text)
    joined = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64) if len(row) else np.zeros(n, dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(joined))
    if array.null_count:
        made = pa.compute.if_else(pa.compute.is_valid(array), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


def canonical(df: DataFrame, text_col: str, out_col: str = "canonical_text", key: bool = False) -> DataFrame:
    """df's columns with out_col, the text form of text_col, or its key; no shuffle.  An existing out_col is replaced."""
    kept = [c for c in df.columns if c != out_col]
    shaped = df.select(*kept, F.col(text_col).alias(out_col))
    where = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, where)):
            cols = batch.columns
            cols[where] = canonical_array(cols[where], text=not key)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return shaped.mapInArrow(run, shaped.schema)


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, class_id, variant): values of one class_id read the same; equal variants are equal values.

    The form to use on large collections: one row per distinct id and value; null texts
    are left out.  Hashes are 128 bits wide.
    """
    folded = canonical(df.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()), text_col, "_canonical", key=True)
    return folded.select(id_col, F.md5("_canonical").alias("class_id"), F.md5(text_col).alias("variant")).distinct()


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of unequal values that read the same.

    Variants are paired first, then expanded to their rows, so copies of one value
    are never compared with each other.
    """
    members = lookalike_classes(df, id_col, text_col)
    variants = members.groupBy("class_id", "variant").agg(F.count("*").alias("rows"))
    several = variants.groupBy("class_id").agg(F.count("*").alias("variants")).where(F.col("variants") > 1)
    variants = join_large(variants, several, "class_id", "left_semi").select("class_id", "variant")
    pairs = join_large(variants.withColumnRenamed("variant", "va"), variants.withColumnRenamed("variant", "vb"), "class_id").where("va < vb").select("va", "vb")
    rows = members.select(F.col(id_col).alias("id"), "variant")
    left = join_large(pairs, rows.select(F.col("id").alias("ia"), F.col("variant").alias("va")), "va").select("ia", "vb")
    both = join_large(left, rows.select(F.col("id").alias("ib"), F.col("variant").alias("vb")), "vb").where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
