"""Scalar text functions as Column expressions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
SPACE = r"[ \t\r\n\f\x0B]"


def collapse(x: Column) -> Column:
    """Blank runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def normal(x: Column) -> Column:
    return F.lower(collapse(x))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def word_set(x: Column) -> Column:
    """Distinct lower-case words of a-z and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z']+"), F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; null if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def overlaps(a: Column, b: Column, above: float = 0.7) -> Column:
    return F.coalesce(containment(a, b) > above, F.lit(False))


def opening(x: Column, n: int = 60) -> Column:
    return F.substring(normal(x), 1, n)


def last_index(x: Column, piece: str) -> Column:
    """0-based start of the last occurrence of piece, -1 if there is none."""
    at = F.instr(F.reverse(x), piece[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(x) - at - (len(piece) - 1))


def trim_quote(x: Column, most: int = 700) -> Column:
    """Cut at the last sentence break within ``most``, or the last space if that lies in the first third."""
    window = F.substring(x, 1, most)
    stop = F.greatest(*(last_index(window, p) for p in (". ", "! ", "? ")))
    cut = F.when(stop < most // 3, last_index(window, " ")).otherwise(stop)
    return F.when((F.length(x) <= most) | (cut <= 0), x).otherwise(F.rtrim(F.substring(x, F.lit(1), cut + 1)))


def drop_heading(x: Column, least_words: int = 6, longest: int = 61) -> Column:
    """Drop a short line ending in a colon at the end, if enough words stay."""
    blanks = r"[ \t\r\n]+$"
    whole = F.regexp_replace(x, blanks, "")
    last = F.substring_index(whole, "\n", -1)
    ends = F.contains(whole, F.lit("\n")) & last.endswith(":") & (F.length(last) <= longest)
    short = F.regexp_replace(F.left(whole, F.length(whole) - F.length(last)), blanks, "")
    words = F.size(F.filter(F.split(short, SPACE + "+"), lambda w: w != ""))
    return F.when(ends & (words >= least_words), short).otherwise(x)


def slug(x: Column, strict: bool = False) -> Column:
    """Lower case, other characters than a-z 0-9 become one hyphen, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out == "", F.raise_error(F.concat(F.lit("cannot make a slug of "), x))).otherwise(out) if strict else out


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


def pretty_name(x: Column) -> Column:
    """McIlroy, O'Brien and hyphened names from any letter case."""

    def part(p: Column) -> Column:
        low = F.lower(p)
        rest = capitalised(F.substring(low, F.lit(3), F.length(low)))
        return (
            F.when(low.startswith("mc") & (F.length(low) > 2), F.concat(F.lit("Mc"), rest))
            .when(low.startswith("o'") & (F.length(low) > 2), F.concat(F.lit("O'"), rest))
            .otherwise(capitalised(low))
        )

    def token(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "-"), part), "-")

    return F.array_join(F.transform(F.filter(F.split(x, SPACE + "+"), lambda t: t != ""), token), " ")


def title_case(x: Column) -> Column:
    """A capital after anything that is not a letter, all else lower."""
    pieces = F.regexp_extract_all(x, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, capitalised), "")


def listing_surname(x: Column) -> Column:
    return F.when(F.instr(x, ",") == 0, F.raise_error(F.concat(F.lit("no comma in "), x))).otherwise(F.trim(F.split(x, ",", 2)[0]))


def listing_given(x: Column) -> Column:
    return F.trim(F.split(x, ",", 2)[1])


def person_id(municipality: Column, office: Column, surname: Column, given: Column) -> Column:
    return F.concat_ws("-", municipality, office, slug(surname), slug(given))


def display_name(surname: Column, given: Column) -> Column:
    return F.trim(F.concat_ws(" ", pretty_name(given), pretty_name(surname)))


def initials(name: Column, most: int = 2) -> Column:
    words = F.filter(F.split(name, SPACE + "+"), lambda w: w != "")
    return F.substring(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""), 1, most)


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def unwrap_lines(x: Column) -> Column:
    """Hard line breaks become spaces."""
    return F.trim(F.regexp_replace(x, SPACE + r"*\n" + SPACE + "*", " "))


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts' concatenation."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def search_tokens(x: Column, least: int = 2) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes of at least ``least`` characters; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9']+"), F.lit(0)), lambda t: F.length(t) >= least)


def search_score(quote: Column, terms: Column, official: Column) -> Column:
    """Ten for each term in the quote, one more for an official source."""
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(quote), t)))
    return F.lit(10) * hits + F.when(official, F.lit(1)).otherwise(F.lit(0))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", F.format_number(n, 0), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def repaired(raw: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def glued_words(x: Column) -> Column:
    """How often a small letter or full stop runs into a capital, as where a line break was lost."""
    return F.regexp_count(x, F.lit(r"[a-z][.!?][A-Z][a-z]"))
