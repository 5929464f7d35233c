"""Personal information in free text: found with place and kind, replaced by surrogates or typed placeholders.

E-mail addresses, phone numbers, identity numbers, street addresses and names are
found by patterns over a copy of the text whose width forms and blanks are folded
one to one, so offsets hold.  Names are recognised by a lexicon learned from tables
of people: given names as listed, family names by the beginnings and endings that
listed ones share, joined by a small grammar of initials, particles and either
order.  Family names that stand in a street, square or firm are left alone.

Every entity gets a surrogate by a keyed hash: of the same kind, script, letter case
and digit format, the same wherever the same entity occurs, distinct from the
surrogate of any other entity and from every real one.  Names are replaced part by
part, each part of a name by one invented word wherever it stands, a woman's given
name by one that reads so: titles before the names of all texts tell, else the
name's end.  Family names keep the ends that tell men from women.  Collisions are
found over all parts and entities and hashed again until none is left, invented words
growing with each attempt.

Null texts give no rows; overlapping findings keep the earlier kind in the order
email, address, id_number, phone, name.  Rows with one id twice give rows twice.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_FOLD = (
    {0xFF01 + i: 0x21 + i for i in range(94)}
    | dict.fromkeys([0xA0, 0x2007, 0x2009, 0x202F, 0x3000], 0x20)
    | dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013], 0x2D)
    | {0x2019: 0x27}
)
_FOLDED = re.compile("[" + "".join(map(chr, _FOLD)).replace("-", "").replace("]", "") + "]")
_BEFORE = r"(?<![0-9A-Za-z])"

_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\d+")
_BLANK = re.compile(r"\s")

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|arroba)\s?[\])}]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]+\s(?:dot|DOT)\s))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|punto|punkt)\s?[\])}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+"
)
_TAIL = r"(?:\s?(?:ext\.?|x|extension|poste|Durchwahl|分机)\s?\d{1,5})?(?![0-9A-Za-z]|-\d)"
PHONE = re.compile(
    r"(?<![0-9A-Za-z.])(?<![-/]\b)(?<!\d-)(?:"
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}"
    r"|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|1?\d{10}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|\d{3}(?: \d{2}){3}"
    r"|\(0\d{2,4}\) ?\d{3,6}[ -]?\d{2,5}"
    r"|0\d{2,4}/\d{3,6}-?\d{2,5}"
    r"|0\d{2,4} \d{4,6} ?\d{2,5}"
    r"|\d{3}-\d{4}"
    r")" + _TAIL
)
# the seven digits that every number has, and how far one can begin before and end after them
_PHONE_DIGITS = re.compile(r"\d(?:[ .()/-]{0,3}\d){6}")
_PHONE_BEFORE, _PHONE_AFTER = 6, 48
# Digits of a number with its country code, at most; others have 15.
_MOST_DIGITS = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12, "49": 13, "86": 13}


def _phone_end(found: str) -> int:
    """Where a number with country code ends: groups beyond its length belong to the text after it."""
    head = re.match(r"\+(\d{1,3})", found)
    if not head:
        return len(found)
    most = next((n for code, n in _MOST_DIGITS.items() if head[1].startswith(code)), 15)
    tail = re.search(r"\s?(?:ext\.?|x|extension|poste|Durchwahl|分机)\s?\d{1,5}$", found)
    body = found[: tail.start()] if tail else found
    if sum(c.isdigit() for c in body) <= most:
        return len(found)
    while sum(c.isdigit() for c in body) > most and re.search(r"[ .-]", body):
        body = re.sub(r"[ .-]+[^ .-]*$", "", body)
    return len(body)


# what stands before a number and says what it is
_LABELS = (
    r"insurance (?:number|no\.?)|\bSIN|\bSSN|care ?card(?: reads| number)?|health (?:card|number)(?: reads)?|PHN|passports?(?: (?:no\.?|number))?|licen[cs]e(?: (?:no\.?|number))?"
    r"|identity card|national card|num[ée]ro de s[ée]curit[ée](?: sociale)?|s[ée]curit[ée] sociale|passeport(?: n[o°]\.?)?|permis(?: de conduire)?|carte (?:soleil|d'identit[ée])"
    r"|\bDNI|\bNIE|\bNIF|pasaporte|seguridad social|c[ée]dula|Ausweis(?: ?-?Nr\.?)?|Reisepass(?: Nr\.?)?|Personalausweis(?: Nr\.?)?|F[üu]hrerschein(?: Nr\.?)?|(?:Sozial)?versicherungsnummer"
    r"|护照号码?|身份证号码?|社保号码?|驾照号码?|паспорт|СНИЛС|여권번호|주민등록번호"
)
ID_LABEL = re.compile(rf"(?:{_LABELS})\s*(?:is|:|：|no\.?|Nr\.?|number|reads|n\.?º)?\s*", re.I)
ID_VALUE = re.compile(r"(?:[A-Z]{1,3}[- ]?|[a-z]{1,2}[- ]?)?\d(?:[ .-]?\d){4,17}(?:-?[A-Za-z](?![A-Za-z]))?(?![0-9])|[A-Z]\d[0-9A-Z]{5,9}(?![0-9A-Za-z])")


# where such a number can begin: its first digit
_ID_DIGIT = re.compile(r"\d(?:(?:[ .-]?\d){4}|(?<=[A-Z]\d)[0-9A-Z]{5})")
_ID_REACH = 80  # characters before that digit in which its label ends; the longest label has half as many


def _folded(text: str) -> str:
    """text with width forms and blanks folded one to one."""
    return text.translate(_FOLD) if not text.isascii() and _FOLDED.search(text) else text


def _caseless(text: str) -> str:
    """text as the patterns that ignore case see it."""
    if text.isascii():
        return text.lower()
    return (text.translate({0x130: "i", 0x131: "i"}) if "\u0130" in text or "\u0131" in text else text).casefold()


NOT_PHONE = re.compile(
    r"(?:contract|account|acct|parcel|identifier|bylaw|by-law|tender|meter|reading|part|file|invoice|permit|plan|resolution|item|coordinates|route|reference|ref|docket|serial"
    r"|contrato|cuenta|expediente|contrat|compte|dossier|vertrag|konto|akte|合同|账户|档案)[\w.]*(?: (?:is|no\.?|number|nr\.?|#))?[\s:#]*$",
    re.I,
)

_DIR = r"(?:North|South|East|West|N\.?E\.?|N\.?W\.?|S\.?E\.?|S\.?W\.?|[NSEW]\.?)"
_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Crescent|Cres|Court|Ct|Place|Pl|Way|Boulevard|Blvd|Terrace|Parkway|Pkwy|Highway|Hwy|Square|Sq|Close|Trail)"
_UNIT = r"(?:Unit|Suite|Ste|Apt|Apartment|Floor|Fl|Room|#)\.? ?#?\d+[A-Za-z]?"
_TITLED, _SMALL = "[A-Z][\\w']*(?: [A-Z][\\w']*){0,2}?", r"(?!(?:about|other|every|public|their|these|those|which|where|while|after|before|under|council)\b)[a-z][\w']{4,}"
_STOP_IN = rf"\.(?=[.,;:)]|\s[a-z]|\s{_DIR}(?![A-Za-z])|\s[A-Z]\d[A-Z]\b)"
ADDRESS_EN = re.compile(
    rf"{_BEFORE}(?:(?:{_UNIT}|#\d+)\s?(?:,|-)\s?)?(?:\d{{1,5}}-)?\d{{1,5}}[A-Za-z]? (?:{_DIR} )?(?:(?:\d{{1,3}}(?:st|nd|rd|th|ST|ND|RD|TH)|{_TITLED}) (?:{_TYPE}|{_TYPE.upper()})|{_SMALL} {_TYPE.lower()})\b"
    rf"(?:{_STOP_IN})?(?: (?:North|South|East|West|NORTH|SOUTH|EAST|WEST|north|south|east|west|NE|NW|SE|SW|[NSEW])\b(?:\.(?=[.,;:)]|\s[a-z]|\s[A-Z]\d[A-Z]\b))?)?(?:,? (?i:{_UNIT}))?"
)
ADDRESS_FR = re.compile(
    rf"{_BEFORE}\d{{1,5}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|boul\.|boulevard|bd|chemin|allée|place|impasse|quai|route|côte|montée)(?: (?:des|de la|de l'|du|de|d'))? ?[A-ZÀ-Ý][\w'-]*(?: (?-i:[A-ZÀ-Ý])[\w'-]*)?"
    r"(?: (?:Est|Ouest|Nord|Sud)\b)?(?:, (?:app|apt|bureau|suite|unité|étage)\.? ?\d+[A-Za-z]?)?",
    re.I,
)
ADDRESS_ES = re.compile(
    rf"{_BEFORE}(?:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pl\.|Paseo|Camino|Ronda|Travesía)(?: (?:de la|de los|de las|del|de))? ?[A-ZÁÉÍÓÚÑ][\w'-]*(?: (?-i:[A-ZÁÉÍÓÚÑ])[\w'-]*)?"
    r",? (?:n\.º ?|núm\. ?|nº ?)?\d{1,4}[A-Za-z]?(?!\d)(?:, ?\d{1,2}\.?[ºª](?: ?(?:[A-Z]\b|izq\.?|dcha\.?))?)?",
    re.I,
)
ADDRESS_DE = re.compile(
    rf"{_BEFORE}(?:[A-ZÄÖÜ][\wß-]*(?:straße|strasse|str\.|weg|gasse|allee|ring|ufer|damm|steig|platz|pfad|markt)"
    r"|(?:Am|An der|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den) (?!Jahr\b)[A-ZÄÖÜ][\wß-]*) \d{1,4}(?:[a-z]| [a-k])?(?![\w%])(?:-\d{1,4}[a-z]?)?(?!\.\d|,\d|\. (?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember))",
    re.I,
)
# what a text must hold for the pattern beside it to match; looked for before the pattern is run
_STREETS_FR = ("rue", "avenue", "av.", "boul", "bd", "chemin", "all\u00e9e", "place", "impasse", "quai", "route", "c\u00f4te", "mont\u00e9e")
_STREETS_ES = ("calle", "c/", "avda.", "avenida", "av.", "plaza", "pl.", "paseo", "camino", "ronda", "traves\u00eda")
_STREETS_DE = ("strasse ", "str. ", "weg ", "gasse ", "allee ", "ring ", "ufer ", "damm ", "steig ", "platz ", "pfad ", "markt ")
_NUMBERED_DE = re.compile(r"(?:strasse|str\.|weg|gasse|allee|ring|ufer|damm|steig|platz|pfad|markt) \d")
_LOCATED_DE = re.compile(r"(?:A[mMnNuU]|I[mMnN]|Z[uU]|U[nN])[a-zA-Z]* (?:[dD][eE][rRmMnN] )?[^\W\d_][\w-]* \d")
_AT = re.compile(r"[\[({]\s?(?:at|AT|arroba)\s?[\])}]|\s(?:at|AT)\s[A-Za-z0-9-]+\s(?:dot|DOT)\s")


def _any_in(pieces: tuple[str, ...], text: str) -> bool:
    for p in pieces:
        if p in text:
            return True
    return False


def _around(pattern: re.Pattern, flat: str, spots: Iterable[tuple[int, int]], before: int, after: int) -> Iterator[re.Match]:
    """Matches of pattern that lie around the spots (start, end), which are in order; each stretch is read once and ends at a blank."""
    begin = end = -1
    for a, z in spots:
        if a - before > end:
            if end >= 0:
                yield from pattern.finditer(flat, begin, end)
            begin = max(0, a - before)
        blank = _BLANK.search(flat, z + after)
        end = blank.start() if blank else len(flat)
    if end >= 0:
        yield from pattern.finditer(flat, max(0, begin), end)


_STREET_BEFORE = re.compile(r"(?:plaza|place|rue|avenue|av\.|boul\.|calle|avda\.|chemin|platz|street|st\.|mount|lake|camp|fort|paseo|camino|weg)(?: (?:de la|de|des|du))? $", re.I)
_PLACE_AFTER = re.compile(
    r" (?:Street|St\b|Avenue|Ave\b|Road|Rd\b|Drive|Lane|Crescent|Cres\b|Court|Place|Way|Park|Bridge|Clinic|School|Hall|Centre|Center|Hospital|Library|Tools|Inc\b|Ltd\b|Bros\b|& Sons|Harbour|Creek|Bay|campaign|friends|team)"
)


@dataclass(frozen=True)
class NameLexicon:
    """Given names, and the beginnings and endings of family names; all bounded in number.

    rest (kind, name, run) holds the names beyond the bound, each with the first run of
    letters by which it is joined with the texts.
    """

    given: tuple[str, ...]
    starts: tuple[str, ...]
    ends: tuple[str, ...]
    whole: tuple[str, ...]
    rest: DataFrame | None = field(default=None, compare=False)


def shared_affixes(words: list[str], share: float = 0.01, sure: float = 0.95, longest: int = 7) -> set[str]:
    """Beginnings that at least ``share`` of the words have, each as long as nearly all its words agree."""
    few = max(3, int(len(words) * share))
    out = set()
    for start, n in Counter(w[:3] for w in words).items():
        if n < few:
            continue
        while len(start) < longest:
            longer, m = Counter(w[: len(start) + 1] for w in words if w.startswith(start)).most_common(1)[0]
            if m < sure * n or len(longer) == len(start):
                break
            start = longer
        out.add(start)
    return out


def _family_parts(surname: str) -> list[str]:
    parts = (re.sub(r"^(?:o['’]|mc|mac|d['’])", "", p) for p in re.split(r"[-\s]", surname.lower()))
    return [p for p in parts if len(p) > 4]


def learn_names(people: DataFrame, given_col: str, surname_col: str, most: int = 20_000) -> NameLexicon:
    """A lexicon from a table of people.

    The beginnings and endings are learned from at most ``most`` distinct family names,
    by hash order.  Names beyond ``most`` of either kind are not collected but stay in
    ``rest``, so every listed name is found.
    """

    def distinct(col: str) -> DataFrame:
        return people.select(F.initcap(F.trim(col)).alias("x")).where("x is not null and x <> ''").distinct()

    def first(col: str) -> tuple[list[str], bool]:
        read = [r["x"] for r in distinct(col).orderBy(F.xxhash64("x"), "x").limit(most + 1).collect()]
        return sorted(read[:most]), len(read) > most

    (given, more_given), (surnames, more_family) = first(given_col), first(surname_col)
    given = [x for x in given if len(x) > 1]
    parts = [p for x in surnames for p in _family_parts(x)]
    starts, ends = shared_affixes(parts), {e[::-1] for e in shared_affixes([p[::-1] for p in parts])}

    by_affix = re.compile(rf"(?:{'|'.join(map(re.escape, sorted(starts)))})[a-z]{{0,9}}(?:{'|'.join(map(re.escape, sorted(ends)))})") if starts and ends else re.compile(r"(?!)")

    def apart(p: str) -> bool:
        """Is the name none that its beginning and ending give?"""
        return not by_affix.fullmatch(p)

    whole = sorted({p for p in parts if apart(p)})
    # hyphenated names may have more parts than there are names
    held_given, held_whole = set(given), set(whole[:most])

    def beyond(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                if kind == "given":
                    left = [x for x in names if len(x) > 1 and x not in held_given]
                else:
                    left = [p for x in names for p in _family_parts(x) if p not in held_whole and apart(p)]
                runs = [_LETTERS.findall(_caseless(x.translate(_FOLD))) for x in left]
                kept = [(kind, x, r[0]) for x, r in zip(left, runs) if r]
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.string()) for i in range(3)], ["kind", "name", "run"])

        return run

    rest = None
    for kind, col, more in (("given", given_col, more_given), ("whole", surname_col, more_family or len(whole) > most)):
        if more:
            listed = distinct(col).mapInArrow(beyond(kind), "kind string, name string, run string").distinct()
            rest = listed if rest is None else rest.unionByName(listed)
    return NameLexicon(tuple(given), tuple(sorted(starts)), tuple(sorted(ends)), tuple(whole[:most]), rest)


def _met(texts: DataFrame, text_col: str, names: NameLexicon) -> DataFrame:
    """texts with _rest: the names beyond the lexicon whose first run of letters a text holds, as kind and name."""
    kinds = "array<struct<kind:string,name:string>>"
    if names.rest is None:
        return texts.withColumn("_rest", F.lit(None).cast(kinds))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                # prefixes that the pattern of family names allows before a listed one
                for w in {x for w in _LETTERS.findall(_caseless(text.translate(_FOLD))) for x in (w, w[2:] if w.startswith("mc") else w, w[3:] if w.startswith("mac") else w)}:
                    row.append(i)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(words, pa.string())], ["_key", "run"])

    keyed = texts.withColumn("_key", F.sha2(text_col, 256))
    held = keyed.where(F.col(text_col).isNotNull()).select("_key", F.col(text_col).alias("_t")).dropDuplicates(["_key"]).mapInArrow(runs, "_key string, run string")
    met = held.join(names.rest, "run").groupBy("_key").agg(F.collect_set(F.struct("kind", "name")).alias("_rest"))
    return keyed.join(met, "_key", "left").drop("_key")


def _finder(finder: Finder, names: NameLexicon, texts: list, rest: list) -> Finder:
    """The finder of a batch: finder, or one of the names that its texts can hold if any is beyond the lexicon."""
    extra = {(m["kind"], m["name"]) for r in rest if r for m in r}
    if not extra:
        return finder
    words = {w for t in texts if t for w in _LETTERS.findall(_caseless(t.translate(_FOLD)))}
    given = [x for x in names.given if (r := _LETTERS.findall(_caseless(x))) and r[0] in words]
    pick = lambda kind: {x.translate(_FOLD) for k, x in extra if k == kind}
    return Finder(replace(names, given=tuple(sorted({*given, *pick("given")})), whole=tuple(sorted({*names.whole, *pick("whole")}))))


_NAME_REACH = 28  # characters around a word of a name in which the rest of it lies


class Finder:
    def __init__(self, names: NameLexicon):
        alt = lambda xs: "|".join(map(re.escape, sorted(xs, key=lambda x: (-len(x), x))))
        token = []
        if names.starts and names.ends:
            token.append(rf"(?:{alt(names.starts)})[a-z]{{0,9}}?(?:{alt(names.ends)})")
        if names.whole:
            token.append(alt(names.whole))
        given = rf"(?:{alt(names.given)})" if names.given else r"(?!)"
        one = rf"(?:O['’]|D['’]|Mc|Mac)?(?:{'|'.join(token)})(?![a-z])" if token else r"(?!)"
        family = rf"{one}(?:-{one})?"
        bound = rf"(?:(?:von der|von|van der|van|de la|Ní|Nic|Ó|Mac) )?{family}"
        with_given = rf"(?:(?:von der|von|van der|van|de la|del|de|da|di|du|Ní|Nic|Ó|Mac) )?{family}"
        initial = r"[A-ZÀ-Ý]\.(?:-?[A-Z]\.)?"
        self.name = re.compile(
            rf"(?<![A-Za-zÀ-ÿ@.\-_/'’])(?:"
            rf"(?P<reversed>{bound}, {given}(?: {initial})?(?![A-Za-z]))"
            rf"|(?P<full>{given}(?: {initial})* {with_given})"
            rf"|(?P<initial>(?:{initial} )+{bound})"
            rf"|(?P<family>{bound})"
            rf"|(?P<given>{given})(?![A-Za-z])"
            rf")(?![A-Za-zÀ-ÿ0-9_@]|\.[a-z]|-[a-z])",
            re.I,
        )
        self.hints = bool(token or names.given)
        # a name of several runs of letters is looked up by its first and last
        runs = [_LETTERS.findall(_caseless(x)) for x in (*names.given, *names.whole)]
        self._given = {r[k] for r in runs if r for k in (0, -1)}
        self._family = re.compile(rf".*?(?:{'|'.join(token)})$") if token else re.compile(r"(?!)")
        self._plain: set[str] = set()

    def _names(self, flat: str) -> Iterator[re.Match]:
        """Matches of the pattern of names, looked for around the words that look like one."""
        if not self.hints:
            return
        spots = []
        # words that look like no name are remembered, up to a bound
        for w in set((_ASCII_LETTERS if flat.isascii() else _LETTERS).findall(flat)) - self._plain:
            low = _caseless(w)
            if low not in self._given and not self._family.match(low):
                self._plain.add(w)
                continue
            at = flat.find(w)
            while at >= 0:  # a longer word that holds it only widens what is read
                spots.append((at, at + len(w)))
                at = flat.find(w, at + len(w))
        if len(self._plain) > 200_000:
            self._plain.clear()
        if spots:
            spots.sort()
            yield from _around(self.name, flat, spots, _NAME_REACH, _NAME_REACH)

    def find(self, text: str, lang: str = "") -> list[tuple[int, int, str]]:
        """(start, end, kind), in order, not overlapping."""
        if not text:
            return []
        flat = _folded(text)
        digits = bool(_DIGIT.search(flat))
        low = _caseless(flat) if digits else ""
        found: list[tuple[int, int, str]] = []

        def free(a: int, z: int) -> bool:
            return all(z <= x or a >= y for x, y, _ in found)

        def take(a: int, z: int, kind: str) -> None:
            if free(a, z):
                found.append((a, z, kind))

        for m in EMAIL.finditer(flat) if "@" in flat or _AT.search(flat) else ():
            take(m.start(), m.end(), "email")
        numbers = [d.span() for d in _NUMBER.finditer(flat)] if digits else []
        for pattern, found_in in (
            (ADDRESS_EN, _around(ADDRESS_EN, flat, numbers, 28, 110)), (ADDRESS_FR, _around(ADDRESS_FR, flat, numbers, 1, 120) if digits and _any_in(_STREETS_FR, low) else ()),
            (ADDRESS_ES, ADDRESS_ES.finditer(flat) if digits and _any_in(_STREETS_ES, low) else ()), (ADDRESS_DE, ADDRESS_DE.finditer(flat) if digits and (_any_in(_STREETS_DE, low) and _NUMBERED_DE.search(low) or _LOCATED_DE.search(flat)) else ()),
        ):
            for m in found_in:
                a, z = m.span()
                if pattern is ADDRESS_DE and not m.group()[:1].isupper():
                    continue
                take(a, z, "address")
        for digit in _ID_DIGIT.finditer(flat) if digits else ():
            for label in ID_LABEL.finditer(flat, max(0, digit.start() - _ID_REACH), digit.start()):
                if m := ID_VALUE.match(flat, label.end()):
                    take(m.start(), m.end(), "id_number")
        for m in _around(PHONE, flat, (d.span() for d in _PHONE_DIGITS.finditer(flat)), _PHONE_BEFORE, _PHONE_AFTER) if digits else ():
            if not NOT_PHONE.search(flat[max(0, m.start() - 40) : m.start()]) and not (m.start() > 1 and flat[m.start() - 1] in "-$€£#" ):
                take(m.start(), m.start() + _phone_end(m.group()), "phone")
        for m in self._names(flat):
            a, z = m.span()
            words = m.group()
            kind = m.lastgroup
            if kind in ("family", "given", "initial", "reversed") and not words[:1].isupper():
                continue
            if kind in ("family", "initial") and (_STREET_BEFORE.search(flat[max(0, a - 24) : a]) or _PLACE_AFTER.match(flat[z : z + 14])):
                continue
            if kind == "given" and (_PLACE_AFTER.match(flat[z : z + 14]) or not (words.istitle() or words.isupper()) or (lang in ("es", "it", "pt") and words == "Una")):
                continue
            if kind == "full" and words[:1].isupper() and not re.search(r"[A-ZÀ-Ý]", words[1:]) and len(words.split()) == 2:
                # a capitalised given name before a word in lower case that only looks like a family name
                z = a + len(words.split()[0])
            take(a, z, "name")
        return sorted(found)


def personal_data(df: DataFrame, id_col: str, text_col: str, names: NameLexicon, lang_col: str | None = None) -> DataFrame:
    """(id_col, char_start, char_end, pii_kind, entity, cue) of every occurrence; cue is f or m where a title before a name tells, else empty."""
    lang = F.lower(F.substring(F.coalesce(F.col(lang_col), F.lit("")), 1, 2)) if lang_col else F.lit("")
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang__")).where(F.col("_text").isNotNull())
    slim, held = _met(slim, "_text", names), replace(names, rest=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Finder(held)
        for batch in batches:
            finder = _finder(usual, held, batch.column(1).to_pylist(), batch.column(3).to_pylist())
            row, out = [], []
            for i, (text, lang) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for a, z, kind in finder.find(text, lang):
                    row.append(i)
                    out.append((a, z, kind, text[a:z], gender_cue(text[max(0, a - 12) : a]) if kind == "name" else ""))
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), (), (), ()), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *cols], ["_id", "char_start", "char_end", "pii_kind", "entity", "cue"])

    kind = df.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, char_start int, char_end int, pii_kind string, entity string, cue string").withColumnRenamed("_id", id_col)


def with_placeholders(df: DataFrame, id_col: str, text_col: str, names: NameLexicon, lang_col: str | None = None) -> DataFrame:
    """df with text_col's entities as [KIND_n], n counting the distinct entities of a kind within the text; no shuffle."""
    lang = F.lower(F.substring(F.coalesce(F.col(lang_col), F.lit("")), 1, 2)) if lang_col else F.lit("")
    shaped, held = _met(df.withColumn("_lang__", lang), text_col, names), replace(names, rest=None)
    at, lang_at, rest_at = (shaped.columns.index(c) for c in (text_col, "_lang__", "_rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Finder(held)
        for batch in batches:
            finder = _finder(usual, held, batch.column(at).to_pylist(), batch.column(rest_at).to_pylist())
            out = []
            for text, lang in zip(batch.column(at).to_pylist(), batch.column(lang_at).to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                numbers: dict[tuple[str, str], int] = {}
                parts, last = [], 0
                for a, z, kind in finder.find(text, lang):
                    key = (kind, normal_entity(kind, text[a:z]))
                    n = numbers.setdefault(key, 1 + sum(k == kind for k, _ in numbers))
                    parts += [text[last:a], f"[{kind.upper()}_{n}]"]
                    last = z
                out.append("".join(parts) + text[last:])
            cols = batch.columns
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return shaped.mapInArrow(run, shaped.schema).drop("_lang__", "_rest")


def normal_entity(kind: str, entity: str) -> str:
    """What decides that two findings are one entity."""
    flat = entity.translate(_FOLD).lower().strip()
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z]", "", flat)
    if kind == "email":
        return re.sub(r"\s", "", re.sub(r"\s?[\[({]?\s?\bdot\b\s?[\])}]?\s?", ".", re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?", "@", flat)))
    if kind == "name" and ", " in flat:
        family, given = flat.split(", ", 1)
        flat = f"{given} {family}"
    return re.sub(r"\s+", " ", flat)


@dataclass(frozen=True)
class Script:
    """What words are invented from: the beginning, the middle, and the ends of words for men or unknown people and for women.

    ``whole`` scripts keep the number of characters, drawn from middle; the others keep none.
    """

    first: tuple[str, ...]
    middle: tuple[str, ...]
    ends: tuple[str, ...]
    feminine: tuple[str, ...]
    whole: bool = False


# Syllables and letters of invented names by script, named as Unicode names its letters.
_LATIN = Script(
    ("Ba", "Ce", "Di", "Fo", "Gu", "Ha", "Ke", "Li", "Mo", "Nu", "Pa", "Re", "Si", "To", "Va", "We"),
    ("bra", "den", "fil", "gor", "lan", "mer", "nis", "pol", "rud", "sta", "tin", "vok"),
    ("dorf", "ley", "man", "rup", "ster", "vale", "wood", "yard"),
    ("a", "ina", "ella"),
)
_SCRIPTS = {
    "LATIN": _LATIN,
    "CYRILLIC": Script(tuple("Ба Ве Го Да Же Ки Лу Ма Не По Ра Си То Фе Ха Че".split()), tuple("бра вел гор дан лам мер ник пол руд ста тим вод".split()), tuple("ман род тер вик лан сен дар мир".split()), ("а", "ина", "ья")),
    "GREEK": Script(tuple("Βα Γε Δι Ζο Θα Κε Λι Μα Νε Πο Ρα Σι Το Φε Χα Ψι".split()), tuple("βρα δεν γιλ λαν μερ νιδ πολ ρου στα τιν φον κορ".split()), tuple("ος ης ας ιδης ακος ιος ωνης ελης".split()), ("α", "ινα", "ελια")),
    "ARABIC": Script((), tuple("ابتجحدرزسشعفقكلمنهوي"), (), ("ة",), True),
    "HEBREW": Script((), tuple("אבגדהוזחטיכלמנסעפצקרשת"), (), ("ה",), True),
    "DEVANAGARI": Script((), tuple("का कि गो चे जा ता दी ना पु बा मो या रा ला वी शा सु हे".split()), (), ("ी",), True),
    "THAI": Script((), tuple("กขคงจชดตทนบปพมยรลวสอ"), (), ("า",), True),
    "HANGUL": Script((), tuple("가나다라마바사아자차하강남동민박선영준현"), (), ("희", "미"), True),
    "HIRAGANA": Script((), tuple("あいうえかきくけこさしすたちつなにのはひふまみもやゆらりる"), (), ("こ", "み"), True),
    "KATAKANA": Script((), tuple("アイウエカキクケコサシスタチツナニノハヒフマミモヤユラリル"), (), ("コ", "ミ"), True),
    "CJK": Script((), tuple("文明国志伟强平东海山林江河石云光天成立永新春安宁德仁义正方金玉田川"), (), ("芳", "丽", "娟"), True),
}
# Ends of given names that are mostly women's, and ends of family names that tell men from women, by script.
_WOMEN = {"LATIN": ("a", "ine", "elle", "ette"), "CYRILLIC": ("а", "я"), "GREEK": ("α", "η", "ω"), "ARABIC": ("ة", "اء"), "HEBREW": ("ה",), "DEVANAGARI": ("ी", "ा"), "HANGUL": ("희", "미", "숙"), "HIRAGANA": ("こ", "み"), "KATAKANA": ("コ", "ミ"), "CJK": ("芳", "丽", "娟", "娜", "静", "婷", "子", "美")}
_FAMILY_ENDS = ("ская", "ский", "цкая", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын", "dóttir", "sson", "ová", "skaya", "skiy")
# Titles that tell a woman from a man.
_CUE = re.compile(r"(?:^|[^\w])(?:(?P<f>mrs|ms|miss|mme|madame|frau|sra|señora|doña|г-жа|госпожа|κα|κυρία)|(?P<m>mr|herrn?|sr|señor|don|monsieur|m|г-н|господин|κ|κύριος))\.?\s$", re.I)


def gender_cue(before: str) -> str:
    """f or m if the text before a name ends in a title that tells, else empty."""
    found = _CUE.search(before)
    return "" if not found else "f" if found["f"] else "m"


def script_of(word: str) -> str:
    """The script of the word's first letter, as Unicode names it."""
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split()[0].split("-")[0]
    return "LATIN"


def is_woman(given: str) -> bool:
    """By the end of a given name, where no title tells."""
    return given.endswith(_WOMEN.get(script_of(given), ("\0",)))


_PARTICLES = {"von", "van", "de", "la", "der", "del", "da", "di", "du", "ní", "nic", "ó", "mac"}
_PART = re.compile(r"([\s,.\-]+)")


def _is_part(w: str) -> bool:
    return len(w) > 1 and w[0].isalpha() and w.lower() not in _PARTICLES


def name_parts(entity: str) -> list[str]:
    """The parts of a name that get a surrogate of their own, folded."""
    return sorted({w.translate(_FOLD).lower() for w in _PART.split(entity) if _is_part(w)})


def _stream(key: bytes, kind: str, label: str, attempt: int) -> Iterator[int]:
    k = 0
    while True:
        yield from hmac.new(key, f"{kind}\x00{label}\x00{attempt}\x00{k}".encode(), hashlib.sha256).digest()
        k += 1


def _word(key: bytes, kind: str, w: str, feminine: bool, attempt: int) -> str:
    """An invented word in the script of w; each attempt has one more syllable or letter to choose from."""
    low = w.lower()
    s = _stream(key, kind, low, attempt)
    draw = lambda xs: xs[(next(s) << 8 | next(s)) % len(xs)]
    script = _SCRIPTS.get(script_of(w), _LATIN)
    if script.whole:
        made = "".join(draw(script.middle) for _ in range(max(1, min(len(w), 4) - feminine) + attempt))
        return made + (draw(script.feminine) if feminine else "")
    made = draw(script.first) + "".join(draw(script.middle) for _ in range(1 + attempt))
    kept = next((e for e in _FAMILY_ENDS if low.endswith(e) and len(low) > len(e) + 1), None)
    return made + draw(script.middle) + (kept if kept else draw(script.feminine) if feminine else draw(script.ends))


_PREFIX = re.compile(r"(?:[OoDd]['’]|Mc|Mac)(?=[A-Z])")


def _cased(made: str, w: str) -> str:
    """made in the letter case of w, behind w's O', D', Mc or Mac."""
    if prefix := _PREFIX.match(w):
        return prefix.group() + _cased(made, w[prefix.end() :])
    return made.upper() if w.isupper() and len(w) > 1 else made.lower() if w.islower() else made


def part_surrogate(key: bytes, part: str, attempt: int = 0, gender: str = "") -> str:
    """The invented word of a name's part; gender f makes a woman's given name, anything else none."""
    return _word(key, "name", part, gender == "f", attempt)


# Alphabets whose letters stand for names as initials.
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def _initial(key: bytes, letter: str) -> str:
    """Another letter of the same alphabet; different letters get different ones."""
    low = letter.lower()
    for alphabet in _ALPHABETS:
        if low in alphabet:
            rank = lambda c: hmac.new(key, f"initial\x00{c}".encode(), hashlib.sha256).digest()
            made = sorted(alphabet, key=rank)[alphabet.index(low)]
            return made.upper() if letter.isupper() else made
    return letter


# Pieces of addresses that stay, and country codes.
_EMAIL_KEPT = ("at", "dot", "arroba", "punto", "punkt", "example", "invalid", "com", "org", "net", "test")
_ADDRESS_KEPT = re.compile(rf"(?:{_TYPE}|{_DIR}|Unit|Suite|Ste|Apt|Apartment|Floor|Fl|Room|rue|avenue|av|boul|boulevard|bd|chemin|allée|place|impasse|quai|route|côte|montée|calle|avda|avenida|plaza|pl|paseo|camino|ronda|travesía|des|de|del|du|la|los|las|bis|ter|quater|app|apt|bureau|suite|unité|étage|est|ouest|nord|sud|am|im|an|der|in|zum|zur|auf|dem|unter|den|str|th|st|nd|rd|izq|dcha|núm)", re.I)
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|allee|ring|ufer|damm|steig|platz|pfad|markt)$", re.I)
_COUNTRY = re.compile(r"[+＋]\s?(?:[17１７]|\d\d)")


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, parts: dict[str, str] | None = None) -> str:
    """A keyed stand-in of the same kind, format, script of digits and letter case; parts are the settled words of a name's parts."""

    def word(w: str, feminine: bool) -> str:
        return _cased(_word(key, kind, w, feminine, attempt), w)

    if kind == "name":
        out = []
        for w in _PART.split(entity):
            if _is_part(w):
                low = w.translate(_FOLD).lower()
                out.append(_cased(parts[low] if parts else part_surrogate(key, low, attempt), w))
            else:
                out.append(_initial(key, w) if len(w) == 1 and w.isalpha() else w)
        return "".join(out)
    s = _stream(key, kind, normal_entity(kind, entity), attempt)
    if kind == "email":
        return re.sub(r"[A-Za-z]+|\d", lambda m: m.group() if m.group().lower() in _EMAIL_KEPT else (str(next(s) % 10) if m.group().isdigit() else word(m.group() + str(next(s)), False)), entity)

    def digit(m: re.Match) -> str:
        zero = ord(m.group()) - int(m.group())
        return chr(zero + next(s) % 10)

    country = _COUNTRY.match(entity) if kind == "phone" else None
    head = country.group() if country else ""
    out = head + re.sub(r"\d", digit, entity[len(head) :])
    if kind == "id_number":
        out = re.sub(r"[A-Z]", lambda m: chr(65 + next(s) % 26), out)
        out = re.sub(r"[a-z]", lambda m: chr(97 + next(s) % 26), out)
    if kind == "address":

        def street(m: re.Match) -> str:
            w = m.group()
            if _ADDRESS_KEPT.fullmatch(w):
                return w
            end = _STREET_END.search(w)
            end = end.group() if end and end.start() else ""
            made = word(w[: len(w) - len(end)] + str(next(s)), False)
            return made + end

        out = re.sub(r"[^\W\d_]{2,}", street, out)
    return out


def _mapped(f: Callable, kind: str) -> Callable:
    """A column function that runs f row by row over Arrow batches."""
    made = pa.map_(pa.string(), pa.string()) if kind.startswith("map") else pa.string()

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*row) for row in zip(*(c.to_pylist() for c in columns))], made)

    return F.arrow_udf(run, kind)


def _settle(rows: DataFrame, by: list[str], make, idle: int = 12) -> DataFrame:
    """rows with attempt and surrogate such that no two entities (by) of a kind share one and none is another real one; raises if that cannot be reached.

    An entity keeps its surrogate against those of later attempts; ``idle`` rounds in
    which no fewer entities collide end the search.
    """
    from spanlake.llm.common import join_large
    from spanlake.session import checkpointed

    spark = rows.sparkSession
    folded = _mapped(normal_entity, "string")
    real = checkpointed(rows.select("pii_kind", F.col(by[1]).alias("s")).distinct().withColumn("real", F.lit(True)), spark)
    rows = checkpointed(rows.withColumn("attempt", F.lit(0)).withColumn("surrogate", make("attempt")), spark)
    least, still = None, 0
    while True:
        seen = rows.select(*by, "attempt", folded(F.col("pii_kind"), F.col("surrogate")).alias("s")).distinct()
        rank = F.row_number().over(Window.partitionBy("pii_kind", "s").orderBy("attempt", *by[1:]))
        # spellings of one entity keep one surrogate, so an entity is as bad as its worst
        ranked = join_large(seen.withColumn("rank", rank), real, ["pii_kind", "s"], "left")
        bad = checkpointed(ranked.where("rank > 1 or real").select(*by, F.lit(1).alias("again")).distinct(), spark)
        n = bad.count()
        if not n:
            return rows
        least, still = (n, 0) if least is None or n < least else (least, still + 1)
        if still >= idle:
            raise ValueError(f"{n} entities have no surrogate of their own in their format")
        again = join_large(rows, bad, by, "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        rows = checkpointed(again.withColumn("surrogate", F.when(F.col("again").isNull(), F.col("surrogate")).otherwise(make("attempt"))).drop("again"), spark)


def placed_parts(entity: str) -> dict[str, str]:
    """The parts of a name with their place: given, family, or unknown where it stands alone."""
    flat = entity.translate(_FOLD)
    if ", " in flat:
        family, given = flat.split(", ", 1)
        return {p: "given" for p in name_parts(given)} | {p: "family" for p in name_parts(family)}
    words = [w for w in _PART.split(flat) if _is_part(w)]
    if len(words) < 2:
        alone = "family" if re.match(r"[^\W\d_]\.", flat) else "unknown"
        return {w.lower(): alone for w in words}
    return {words[0].lower(): "given"} | {w.lower(): "family" for w in words[1:]}


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(pii_kind, normal, entity, surrogate) for each distinct spelling.

    The surrogates of different entities are held against each other, and against
    the real ones, over all entities; those that collide are hashed again until none
    do, and if none can be found, as there are more entities than values of their
    format, it raises.  A part of a name is a given name if it mostly stands in that
    place, and a woman's by the titles before the names it leads (column cue, if found
    has it) or else by its end; it has one surrogate wherever it stands.
    """
    from spanlake.llm.common import join_large
    from spanlake.session import checkpointed

    secret = key.encode()
    normal = _mapped(normal_entity, "string")
    placed = _mapped(lambda e: list(placed_parts(e).items()), "map<string,string>")
    make = _mapped(lambda kind, entity, attempt: surrogate(secret, kind, entity, attempt), "string")
    invent = _mapped(lambda part, gender, attempt: part_surrogate(secret, part, attempt, gender), "string")
    named = _mapped(lambda entity, parts: surrogate(secret, "name", entity, 0, dict(parts or {})), "string")
    by_end = _mapped(lambda part: "f" if is_woman(part) else "", "string")

    cue = F.col("cue") if "cue" in found.columns else F.lit("")
    spelled = found.groupBy("pii_kind", "entity").agg(F.count_if(cue == "f").alias("f"), F.count_if(cue == "m").alias("m"))
    rows = checkpointed(spelled.withColumn("normal", normal(F.col("pii_kind"), F.col("entity"))), found.sparkSession)
    names = rows.where("pii_kind = 'name'").select("pii_kind", "entity", "normal", "f", "m")
    each = names.select("entity", "f", "m", F.explode(placed(F.col("entity"))).alias("part", "place"))
    given = F.count_if(F.col("place") == "given") > F.count_if(F.col("place") == "family")
    told = F.sum(F.when(F.col("place") == "given", F.col("f") - F.col("m")))
    role = each.groupBy("part").agg(given.alias("given"), F.coalesce(told, F.lit(0)).alias("told"))
    gender = F.when(~F.col("given"), "").when(F.col("told") > 0, "f").when(F.col("told") < 0, "m").otherwise(by_end(F.col("part")))
    parts = _settle(role.select(F.lit("name").alias("pii_kind"), "part", gender.alias("gender")), ["pii_kind", "part"], lambda attempt: invent(F.col("part"), F.col("gender"), F.col(attempt)))
    words = join_large(each, parts.select("part", "surrogate"), "part").groupBy("entity").agg(F.map_from_entries(F.collect_set(F.struct("part", "surrogate"))).alias("parts"))
    names = join_large(names, words, "entity", "left").select("pii_kind", "entity", "normal", named(F.col("entity"), F.col("parts")).alias("surrogate"))
    rest = _settle(rows.where("pii_kind <> 'name'").drop("f", "m"), ["pii_kind", "normal"], lambda attempt: make(F.col("pii_kind"), F.col("entity"), F.col(attempt)))
    columns = ["pii_kind", "normal", "entity", "surrogate"]
    return names.select(*columns).unionByName(rest.select(*columns))


def shape(text: str) -> str:
    """What a surrogate keeps: runs of digits, of capitals and of other letters of a script, and all else as it is."""
    out = []
    for c in text.translate(_FOLD):
        x = "0" if c.isdigit() else "A" if c.isupper() else script_of(c)[0].lower() if c.isalpha() else "" if unicodedata.combining(c) or unicodedata.category(c)[0] == "M" else c
        if x and (not out or out[-1] != x):
            out.append(x)
    return "".join(out)


def surrogate_problems(table: DataFrame) -> DataFrame:
    """(pii_kind, shared, real, other_form): entities of a kind whose surrogate another has, surrogates that are real entities, and those of another form."""
    from spanlake.llm.common import join_large

    normal, form = _mapped(normal_entity, "string"), _mapped(shape, "string")
    rows = table.withColumn("s", normal(F.col("pii_kind"), F.col("surrogate")))
    shared = rows.groupBy("pii_kind", "s").agg(F.countDistinct("normal").alias("n"))
    real = join_large(shared, table.select("pii_kind", F.col("normal").alias("s")).distinct().withColumn("real", F.lit(1)), ["pii_kind", "s"], "left")
    one = real.groupBy("pii_kind").agg(F.count_if(F.col("n") > 1).alias("shared"), F.count("real").alias("real"))
    other = rows.groupBy("pii_kind").agg(F.count_if(form(F.col("entity")) != form(F.col("surrogate"))).alias("other_form"))
    return one.join(other, "pii_kind")


def with_surrogates(df: DataFrame, id_col: str, text_col: str, found: DataFrame, key: str) -> DataFrame:
    """(id_col, text_col) with each occurrence replaced by its surrogate; ids must be unique."""
    from spanlake.llm.common import join_large

    table = surrogates(found, key).drop("normal")
    spans = join_large(found, table, ["pii_kind", "entity"]).groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end", "surrogate"))).alias("_spans"))
    text = F.col(text_col)

    def step(state: Column, span: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, span["char_start"] - state["at"]), span["surrogate"])
        return F.struct(piece.alias("out"), span["char_end"].alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))
    joined = join_large(df.select(id_col, text_col), spans, id_col, "left")
    return joined.select(id_col, F.when(F.col("_spans").isNull(), text).otherwise(done).alias(text_col))
