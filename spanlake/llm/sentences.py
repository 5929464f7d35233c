"""Sentence units with exact code-point offsets, across languages and scripts.

The boundary rules are compiled into two small finite transducers per language
(their cascade is one transducer): the first follows words and labels each full
stop (abbreviation, initial, ordinal, plain), the second follows lines, quotes,
brackets, list marks and terminators and says where a unit starts.  Which quote
or bracket has a partner is settled beforehand by one pass over the marks.
Long texts are cut into chunks; see ``transducer``.

Null or blank texts yield no units; repeated rows yield their units repeatedly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanlake.llm.common import pieces
from spanlake.llm.transducer import Transducer

# Abbreviations by language and by what may follow them.
# never: no unit ends there; sentence: ends if a new sentence visibly follows
# (capital or digit); capital: ends only before a capital; number: belongs to a
# number that follows.
ABBREVIATIONS: dict[str, dict[str, str]] = {
    "en": {
        "never": "mr mrs ms mx dr prof st rt hon mt ft capt col gen gov sen rep rev sr jr vs cf al e.g i.e fig figs vol vols pp p pop app approx sec ch dept ed eds ph viz www messrs jan feb mar apr jun jul aug sept sep oct nov dec",
        "sentence": "etc inc ltd co corp a.m p.m ave rd blvd",
        "capital": "mon tue tues wed thu thur thurs fri sat",
        "number": "no nos",
    },
    "de": {
        "never": "hr fr frl dr prof dipl ing st nr ca evtl ggf inkl exkl vgl sog bzw bspw art abs tel www max min",
        "sentence": "usw etc",
        "capital": "mio mrd jh",
        "number": "",
    },
    "fr": {"never": "mm mme mlle dr pr st ste env cf p pp art vol fig av bd chap ex www", "sentence": "etc", "capital": "", "number": "no nos"},
    "es": {
        "never": "sr sra sres srta dr dra dña prof ing lic gral núm pág págs art cap aprox cf vol fig ud uds ee av avda www",
        "sentence": "etc uu",
        "capital": "",
        "number": "",
    },
    "ru": {"never": "млн млрд тыс ул пр им стр рис см проф акад www", "sentence": "г гг др т.д т.п", "capital": "руб коп", "number": ""},
    "el": {"never": "κ κα κος π.χ δηλ αρ σελ τηλ www", "sentence": "κ.λπ κτλ", "capital": "εκ δισ", "number": ""},
    "hi": {"never": "डॉ श्री प्रो श्रीमती क्र सं dr mr mrs ms prof www", "sentence": "", "capital": "रु", "number": ""},
}
ELSEWHERE = {"never": "dr mr mrs ms prof st vs www", "sentence": "etc inc ltd", "capital": "", "number": "no"}
ORDINALS = ("de",)  # one or two digits and a full stop are an ordinal there

CLASSES = (
    "SPACE NL DOT NEVER WEAK CAPITAL NUMBER TERM KTERM ELLIPSIS OPEN CLOSE LBR RBR CLOSER SQO DASH BULLET "
    "DIGIT UPPER LOWER LETTER CJK THAI INVERT RPAREN OTHER"
).split()
(SPACE, NL, DOT, NEVER, WEAK, CAPITAL, NUMBER, TERM, KTERM, ELLIPSIS, OPEN, CLOSE, LBR, RBR, CLOSER, SQO, DASH, BULLET,
 DIGIT, UPPER, LOWER, LETTER, CJK, THAI, INVERT, RPAREN, OTHER) = range(len(CLASSES))
CAND, START, START_AFTER_MARK, START_AT_CAND = 1, 2, 3, 4

_single: dict[str, int] = {
    ".": DOT, "!": TERM, "?": TERM, "؟": TERM, "।": TERM, "॥": TERM, "۔": TERM, "‼": TERM, "⁇": TERM, "⁉": TERM, "։": TERM,
    "。": KTERM, "！": KTERM, "？": KTERM, "｡": KTERM, "…": ELLIPSIS, "-": DASH, "–": DASH, "—": DASH, "―": DASH, "‐": DASH,
    "*": BULLET, "•": BULLET, "‣": BULLET, "▪": BULLET, "·": BULLET, "◦": BULLET, "¿": INVERT, "¡": INVERT,
    "(": LBR, "[": LBR, "（": LBR, "【": LBR, ")": RBR, "]": RBR, "）": RBR, "】": RBR,
    "«": OPEN, "»": CLOSE, "„": OPEN, "‚": OPEN, "“": OPEN, "”": CLOSE, "「": OPEN, "」": CLOSE, "『": OPEN, "』": CLOSE, "‹": OPEN, "›": CLOSE,
    '"': CLOSE, "'": CLOSER, "’": CLOSER, "‘": OPEN, "\n": NL, "\r": NL, " ": NL, " ": NL, "\x0b": NL, "\x0c": NL,
}


def _class_of(cp: int) -> int:
    ch = chr(cp)
    if ch in _single:
        return _single[ch]
    if ch.isspace():
        return SPACE
    kind = unicodedata.category(ch)
    if kind == "Nd":
        return DIGIT
    if kind[0] in "LM":
        if 0x0E00 <= cp <= 0x0E7F:
            return THAI
        if 0x2E80 <= cp <= 0x312F or 0x31A0 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0xFF66 <= cp <= 0xFF9F or cp >= 0x20000:
            return CJK
        return UPPER if kind in ("Lu", "Lt") else LOWER if kind == "Ll" else LETTER
    return OTHER


class _Lookup:
    """Code point to small number, growing with the code points seen."""

    def __init__(self, of):
        self.of, self.table, self.known = of, np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000, dtype=bool)

    def __call__(self, cps: np.ndarray) -> np.ndarray:
        new = np.unique(cps[~self.known[cps]])
        for cp in new.tolist():
            self.table[cp] = self.of(cp)
        self.known[new] = True
        return self.table[cps]


class _Words:
    """The word transducer of one language and its letter classes."""

    def __init__(self, lang: str):
        lists = ABBREVIATIONS.get(lang, ELSEWHERE)
        trie: list[dict] = [{}]
        kind: dict[int, int] = {}
        for name, label in (("never", NEVER), ("sentence", WEAK), ("capital", CAPITAL), ("number", NUMBER)):
            for word in lists[name].split():
                at = 0
                for ch in word:
                    if ch not in trie[at]:
                        trie[at][ch] = len(trie)
                        trie.append({})
                    at = trie[at][ch]
                kind[at] = label
        letters = sorted({ch for node in trie for ch in node} - {"."})
        number = {ch: 5 + i for i, ch in enumerate(letters)}
        # classes: 0 other, 1 dot, 2 digit, 3 cased letter, 4 uncased letter, 5.. letters of the lists
        back = {v: k for k, v in number.items()}
        ordinals = lang in ORDINALS

        def of(cp: int) -> int:
            ch = chr(cp)
            low = ch.lower()
            if low in number:
                return number[low]
            if ch == ".":
                return 1
            kind_ = unicodedata.category(ch)
            return 2 if kind_ == "Nd" else 4 if kind_ in ("Lo", "Mn", "Mc", "Lm") else 3 if kind_[0] == "L" else 0

        self.classes = _Lookup(of)
        cased = {v: unicodedata.category(k) in ("Ll", "Lu") for k, v in number.items()}

        def step(state, c):
            node, letters_, digits, decimal = state  # node: trie node or -1
            if c == 2:
                if letters_:
                    return (-1, 2, 0, False), 0
                return (-1, 0, min(digits + 1, 3), decimal), 0
            if c >= 3:
                fresh = not letters_ and not digits
                to = trie[node].get(back.get(c, ""), -1) if node >= 0 and not digits else -1
                one = c == 3 or cased.get(c, False)
                return (to, 1 if fresh and one else 2, 0, False), 0
            if c == 1:
                said = kind.get(node, 0) if node > 0 and letters_ else 0
                if not said and letters_ == 1:
                    said = NEVER
                if not said and ordinals and digits in (1, 2) and not decimal:
                    said = NEVER
                on = trie[node].get(".", -1) if node > 0 and letters_ else -1
                return (on if on > 0 else 0, 0, 0, digits > 0), said
            return (0, 0, 0, digits > 0), 0  # a comma or colon after a digit may go on with decimals

        self.machine = Transducer((0, 0, 0, False), 5 + len(letters), step)


def _boundaries() -> Transducer:
    stops = ("T", "C", "E", "K")

    def inside(c, ph, q, b, li):
        """The next state for c within a unit; None asks for a new unit at c."""
        free = not q and not b
        if c == SPACE:
            return (ph + "b" if ph != "I" else "Ib", 0, q, b, li)
        if c == NL:
            return (ph + "b", 1, q, b, li)
        if c == OPEN:
            return None if free and ph in stops else ("I", 0, 1, b, li)
        if c == CLOSE:
            return ("C" if ph in (*stops, "W", "S", "M", "N") else "I", 0, 0, b, li)
        if c == LBR:
            return ("I", 0, q, 1, li)
        if c == RBR:
            return ("C" if ph in stops else "I", 0, q, 0, li)
        if c == CLOSER:
            return ("C" if ph in (*stops, "W") else "I", 0, q, b, li)
        if c == DOT:
            return ("E" if ph in ("T", "E", "S", "W", "M", "N") else "T", 0, q, b, li)
        if c in (NEVER, WEAK, CAPITAL, NUMBER):
            return ({NEVER: "S", WEAK: "W", CAPITAL: "M", NUMBER: "N"}[c], 0, q, b, li)
        if c == TERM:
            return ("T", 0, q, b, li)
        if c == KTERM:
            return ("K", 0, q, b, li)
        if c == ELLIPSIS:
            return ("E", 0, q, b, li)
        if free:
            if ph == "K":
                return None
            if c == UPPER and ph in ("T", "C", "E") or ph == "T" and c in (CJK, LETTER, THAI, INVERT):
                return None
        return ("H" if c == THAI else "I", 0, q, b, li)

    def begin(c, li=0):
        return inside(c, "I", 0, 0, li)

    def step(state, c):
        ph, n, q, b, li = state
        if ph == "P":
            if c in (SPACE, NL):
                return state, 0
            if c in (DASH, BULLET):
                return ("d", 0, 0, 0, 0), CAND
            if c == DIGIT:
                return ("g", 1, 0, 0, 0), CAND
            return begin(c), START
        if ph == "d":
            if c == SPACE:
                return ("mark", 0, 0, 0, 0), 0
            if c == NL:
                return ("P", 0, 0, 0, 0), 0
            return begin(c), START_AT_CAND
        if ph == "mark":
            if c == SPACE:
                return state, 0
            if c == NL:
                return ("P", 0, 0, 0, 0), 0
            return begin(c, 1), START_AFTER_MARK
        if ph == "g":  # digits at a line's start: a list mark or a number
            if c == DIGIT:
                return ("g", min(n + 1, 3), 0, 0, 0), 0
            if n <= 2 and c in (RPAREN, RBR, DOT, NEVER):
                return ("gp", 0, 0, 0, 0), 0
            return begin(c), START_AT_CAND
        if ph == "gp":
            if c == SPACE:
                return ("mark", 0, 0, 0, 0), 0
            return begin(c), START_AT_CAND
        if ph == "w":  # digits or dash at the start of a line that may go on with a sentence
            if n < 3 and c == DIGIT:
                return ("w", n + 1, q, b, li), 0
            if n in (1, 2) and c in (RPAREN, RBR):
                return ("wp", 0, q, b, li), 0
            return step(("I", 0, q, b, li), c)
        if ph == "wp":
            if c == SPACE:
                return ("mark", 0, 0, 0, 0), 0
            return step(("I", 0, q, b, li), c)
        if ph == "wd":
            if c == SPACE:
                return ("wds", 0, q, b, li), 0
            return step(("I", 0, q, b, li), c)
        if ph == "wds":
            if c == SPACE:
                return state, 0
            if c in (UPPER, OPEN, SQO, INVERT, OTHER) and not q and not b:
                return begin(c, 1), START_AFTER_MARK
            return step(("I", 0, q, b, li), c)
        if ph in ("td", "tds"):  # a dash after a finished sentence, on its line
            if c == SPACE:
                return ("tds", 0, 0, 0, li), 0
            if c == LOWER:
                return begin(c, li), 0
            if c == NL:
                return ("P", 0, 0, 0, 0), 0
            return begin(c), START_AT_CAND if ph == "td" else START_AFTER_MARK
        if not ph.endswith("b"):
            to = inside(c, ph, q, b, li)
            return (begin(c), START) if to is None else (to, 0)
        # after blanks
        was, free = ph[:-1], not q and not b
        if c == SPACE:
            return state, 0
        if c == NL:
            return (("P", 0, 0, 0, 0) if n else (ph, 1, q, b, li)), 0
        if n and free and c == BULLET:
            return ("d", 0, 0, 0, 0), CAND
        if was in ("I", "S", "H", "N", "M", "W", "E") and n and free:  # a wrapped line, or a list begins
            if c == DASH:
                return (("d", 0, 0, 0, 0) if li else ("wd", 0, q, b, li)), CAND
            if c == DIGIT and was in ("I", "S", "H"):
                return ("w", 1, q, b, li), CAND
            if li and was == "I" and c not in (LOWER, DIGIT, OTHER, CLOSER):
                return begin(c), START
        if not free:
            keep = was if c in (CLOSE, CLOSER, RBR, DOT, TERM) else "I"
            to = inside(c, keep, q, b, li)
            return (to or ("I", 0, q, b, li)), 0
        if c in (CLOSE, CLOSER) and was in stops:
            return ("C", 0, q, b, li), 0
        new = {
            "T": True,
            "K": True,
            "C": c not in (LOWER, OTHER, CLOSER, CLOSE, RBR, DOT, TERM, ELLIPSIS),
            "E": c not in (LOWER, OTHER, CLOSER, CLOSE, RBR, DOT, TERM, ELLIPSIS, DASH),
            "W": c in (UPPER, DIGIT, OPEN, SQO, INVERT, BULLET),
            "M": c in (UPPER, OPEN, SQO, INVERT),
            "N": c in (UPPER, OPEN, SQO, INVERT),
            "H": c == THAI,
        }.get(was, False)
        if c == DASH and was in ("T", "K", "C"):
            if n:
                return ("d", 0, 0, 0, 0), CAND
            return (("td", 0, 0, 0, li), CAND) if was != "C" else (("I", 0, q, b, li), 0)
        if new and n and c == DIGIT:
            return ("g", 1, 0, 0, 0), CAND
        if new:
            return begin(c), START
        return inside(c, "I", q, b, li), 0

    return Transducer(("P", 0, 0, 0, 0), len(CLASSES), step)


_base = _Lookup(_class_of)
_words: dict[str, _Words] = {}
_machine: list[Transducer] = []


def _mark_classes(cps: np.ndarray, classes: np.ndarray, ends: np.ndarray, lang: str) -> None:
    """Set, in place, what depends on neighbours: straight quotes, partners, Greek question marks."""
    before = np.concatenate(([10], cps[:-1]))
    after = np.concatenate((cps[1:], [10]))
    firsts = np.concatenate(([0], ends[:-1]))
    firsts = firsts[firsts < len(cps)]
    before[firsts] = 10
    blank_before = np.isin(_base(before), (SPACE, NL, LBR, DASH))
    word_after = np.isin(_base(after), (UPPER, LOWER, LETTER, DIGIT, CJK, INVERT))
    classes[(cps == ord('"')) & blank_before & word_after] = OPEN
    classes[(cps == ord("'")) & blank_before & word_after] = SQO
    if lang == "de":
        classes[cps == ord("“")] = CLOSE
    classes[((cps == ord(";")) | (cps == 0x37E)) & (before >= 0x370) & (before <= 0x3FF)] = TERM
    # a capital says nothing in a word of capitals that follows another one
    letter = np.isin(classes, (UPPER, LOWER, LETTER))
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    if len(starts):
        stop = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1
        upper = np.concatenate(([0], np.cumsum(classes == UPPER)))
        full = upper[stop] - upper[starts] == stop - starts
        caps = (stop - starts > 1) & full
        # a single capital between two such words is one of them
        caps[1:-1] |= full[1:-1] & (stop - starts == 1)[1:-1] & caps[:-2] & caps[2:]
        doc = np.searchsorted(ends, starts, side="right")
        after_caps = caps & np.concatenate(([False], caps[:-1] & (doc[1:] == doc[:-1])))
        edge = np.zeros(len(cps) + 1, dtype=np.int8)
        edge[starts[after_caps]] += 1
        edge[stop[after_caps]] -= 1
        classes[np.cumsum(edge[:-1]).astype(bool)] = LOWER
    # a mark counts only if the next mark of its family within the paragraph is its partner
    hard = np.zeros(len(cps), dtype=bool)
    hard[firsts] = True
    newline = classes == NL
    hard |= newline & (_base(before) == NL)
    for opens, closes, lone_open, lone_close in ((OPEN, CLOSE, OTHER, CLOSER), (LBR, RBR, OTHER, RPAREN)):
        at = np.flatnonzero((classes == opens) | (classes == closes) | hard)
        what = np.where(classes[at] == opens, 1, np.where(classes[at] == closes, 2, 0))
        if not len(at):
            continue
        paired = np.zeros(len(at), dtype=bool)
        ok = (what[:-1] == 1) & (what[1:] == 2) & ~(hard[at[1:]])
        paired[:-1] |= ok
        paired[1:] |= ok
        # a text's first mark is itself a hard stop; it may still open a pair
        classes[at[(what == 1) & ~paired]] = lone_open
        classes[at[(what == 2) & ~paired]] = lone_close


def split_batch(texts: list[str], lang: str, chunk: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of every unit, in order."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return (np.zeros(0, dtype=np.int64),) * 3
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lengths)
    key = lang if lang in ABBREVIATIONS else "*"
    if key not in _words:
        _words[key] = _Words(key)
    if not _machine:
        _machine.append(_boundaries())
    classes = _base(cps)
    _mark_classes(cps, classes, ends, lang)
    words = _words[key]
    stops = words.machine.run(words.classes(cps), lengths, chunk)
    labelled = (stops > 0) & (classes == DOT)
    classes[labelled] = stops[labelled]
    said = _machine[0].run(classes, lengths, chunk)
    filled = (classes != SPACE) & (classes != NL)
    index = np.arange(len(cps))
    last_filled = np.maximum.accumulate(np.where(filled, index, -1))
    last_cand = np.maximum.accumulate(np.where(said == CAND, index, -1))
    at = np.flatnonzero(said >= START)
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3
    begin = np.where(said[at] == START_AT_CAND, last_cand[at], at)
    limit = np.where(said[at] == START, at, last_cand[at])
    doc = np.searchsorted(ends, at, side="right")
    stop = np.append(limit[1:], ends[-1])
    stop = np.minimum(stop, ends[doc])
    end = last_filled[stop - 1] + 1
    base = (ends - lengths)[doc]
    keep = end > begin
    return doc[keep], (begin - base)[keep], (end - base)[keep]


def sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str, with_text: bool = True, chunk: int = 512) -> DataFrame:
    """One row per unit: id_col, unit_no, char_start, char_end and, if asked for, text.

    Works within partitions, without a shuffle.  Texts that are null or blank have
    no units; an unknown or null language uses the general abbreviations.
    """
    kind = df.schema[id_col].dataType
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lower(F.coalesce(F.substring(F.col(lang_col), 1, 2), F.lit(""))).alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            texts, langs = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=object)
            texts = [t or "" for t in texts]
            parts = []
            for lang in sorted(set(langs.tolist())):
                rows = np.flatnonzero(langs == lang)
                doc, begin, end = split_batch([texts[i] for i in rows], lang, chunk)
                first = np.searchsorted(doc, doc, side="left")
                parts.append((rows[doc], np.arange(len(doc)) - first, begin, end))
            if not parts:
                continue
            row, no, begin, end = (np.concatenate(x) for x in zip(*parts))
            cols = [batch.column(0).take(pa.array(row)), pa.array(no.astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))]
            if with_text:
                cols.append(pa.array([texts[r][a:z] for r, a, z in zip(row.tolist(), begin.tolist(), end.tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "unit_no", "char_start", "char_end", "text"][: len(cols)])

    fields = f"_id {kind.simpleString()}, unit_no int, char_start int, char_end int" + (", text string" if with_text else "")
    return slim.mapInArrow(run, fields).withColumnRenamed("_id", id_col)
