"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import config as V

#: White space as Unicode has it.
WS = r"(?U)\s+"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _found(c: Column, pattern: str) -> Column:
    """Whether the pattern is in c, with the classes of Unicode only where they are needed: each costs a look at a letter's
    category."""
    return F.when(is_ascii(c), c.rlike(pattern)).otherwise(_blank(c).rlike("(?U)" + pattern))


def normalize_text(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, null is the empty text."""
    odd = F.contains(c, F.lit("  "))
    for blank in "\t\n\v\f\r":
        odd = odd | F.contains(c, F.lit(blank))
    return F.trim(F.when(is_ascii(c) & ~odd, c).otherwise(F.regexp_replace(_blank(c), WS, " ")))  # most texts need no search


@cache
def _folds() -> dict[str, str]:
    """Lower-case letters that case folding still changes, by the rule that says what it makes of them."""
    letters = (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in letters if c.lower() == c != c.casefold()}


@cache
def _fold_class() -> str:
    """The letters of _folds but sharp s and final sigma as a class of ranges: one by one, each costs a test a character."""
    runs: list[list[int]] = []
    for c in sorted(ord(x) for x in _folds() if x not in "ßς"):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]"


def casefold(c: Column, of: Column | None = None) -> Column:
    """c as case folding has it: lower case, and beyond that letters such as sharp s and final sigma as their equals.

    Lower case is all that ASCII needs. of is a column that c is made of and that is ASCII only if c is; its test is
    cheaper where c is dear, since nothing but a projection evaluates c once."""
    low = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    rest = {k: v for k, v in _folds().items() if k not in "ßς"}
    table = F.create_map(*[F.lit(x) for kv in rest.items() for x in kv])
    folded = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.when(is_ascii(c if of is None else of), F.lower(c)).when(low.rlike(_fold_class()), folded).otherwise(low)


def normalize_title(c: Column) -> Column:
    return casefold(normalize_text(c), _blank(c))


def word_count(c: Column) -> Column:
    t = normalize_text(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def paper_key(id_: Column, title: Column) -> Column:
    """id:<id>, or title:<title> where there is no id."""
    i = normalize_text(id_)
    return F.when(i != "", F.concat(F.lit("id:"), i)).otherwise(F.concat(F.lit("title:"), normalize_title(title)))


def merge_title(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces; hyphens are deleted, not opened."""
    kept = F.regexp_replace(F.lower(_blank(c)), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, WS, " "))


def normalize_doi(c: Column) -> Column:
    d = F.lower(F.trim(_blank(c)))
    for prefix in ("https://doi.org/", "http://doi.org/"):
        d = F.replace(d, F.lit(prefix), F.lit(""))
    return F.trim(d)


def dedup_key(doi: Column, title: Column, id_: Column) -> Column:
    """doi:, else title:, else id:."""
    d, t = normalize_doi(doi), merge_title(title)
    return (
        F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("title:"), t))
        .otherwise(F.concat(F.lit("id:"), _blank(id_.cast("string"))))
    )


def normalize_relation(c: Column) -> Column:
    """Lower case, spaces and hyphens as underscores, a leading are_ or were_ in the singular."""
    r = F.translate(casefold(normalize_text(c), _blank(c)), "- ", "__")
    return F.regexp_replace(F.regexp_replace(r, "^are_", "is_"), "^were_", "was_")


def graph_relation(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_blank(c))), WS, "_")


def normalize_year(c: Column) -> Column:
    """int(value), or null: blanks around an integer are fine, fractions in text are not."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def has_text(c: Column, but: str = "") -> Column:
    """Whether c holds anything but white space and the given marks; one search, which mostly ends at the first letter."""
    return _blank(c).rlike(r"(?U)[^\s" + re.escape(but) + "]")


def is_generic_phrase(c: Column) -> Column:
    """Nothing at all, a generic term, or one that a vague qualifier begins, in one search over the words."""
    generic, vague = _any_of(V.GENERIC_TERMS), _any_of(V.VAGUE_QUALIFIERS)
    return _found(F.lower(c), rf"(?s)\A\s*+(?:(?:{vague}\s++(?:.*\s)?)?{generic})?\s*+\z")


def more_words(c: Column, n: int) -> Column:
    """word_count(c) > n, without making the words."""
    return _found(c, rf"\A\s*+(?:\S++\s++){{{n}}}\S")


def bound(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f uses it; keeps generated code small."""
    return F.element_at(F.transform(F.array(c), f), 1)


#: What the id of an entity loses at its ends.
MARKS = " .,:;\"'"


def canonicalize_entity(c: Column) -> Column:
    """The id of an entity: trimmed of quotes and stops, without one leading article, in lower case, aliases resolved,
    without the first of the suffixes that fits if more than one word is there. It is empty only where has_text(c, MARKS)
    is false."""
    key = casefold(F.btrim(normalize_text(c), F.lit(MARKS)), _blank(c))
    alias = F.create_map(*[F.lit(x) for kv in V.ALIASES.items() for x in kv])

    def bare(k: Column) -> Column:
        out = F.when(F.startswith(k, F.lit("the ")), F.substring(k, 5, 1 << 30))
        return out.when(F.startswith(k, F.lit("an ")), F.substring(k, 4, 1 << 30)).when(F.startswith(k, F.lit("a ")), F.substring(k, 3, 1 << 30)).otherwise(k)

    def settle(k: Column) -> Column:
        out = F.when(alias[k].isNotNull(), alias[k])
        for suffix in V.STRIP_SUFFIXES:  # words are parted by single spaces here, so what stands before one is a word
            out = out.when(F.endswith(k, F.lit(suffix)), F.substring(k, F.lit(1), F.length(k) - len(suffix)))
        return out.otherwise(k)

    return bound(bound(key, bare), settle)


def display_label(entity: Column, surface: Column) -> Column:
    return F.when(entity.isin(*V.UPPER_VOCAB), F.upper(entity)).otherwise(F.coalesce(surface, entity))


def numbers(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))))


def has_conflicting_numbers(a: Column, b: Column) -> Column:
    x, y = numbers(a), numbers(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def is_risky_generic_merge(a: Column, b: Column) -> Column:
    """Whether the side with fewer different words has only generic head words."""
    words = lambda c: F.array_distinct(F.split(normalize_text(c), " "))
    x, y = words(a), words(b)
    shorter = F.when(F.size(x) <= F.size(y), x).otherwise(y)
    return F.size(F.array_except(shorter, F.array(*[F.lit(w) for w in V.GENERIC_HEAD_WORDS]))) == 0


def longer_shorter(a: Column, b: Column) -> tuple[Column, Column]:
    """By code points; both null where the lengths are equal."""
    n, m = F.length(a), F.length(b)
    return F.when(n > m, a).when(n < m, b), F.when(n > m, b).when(n < m, a)


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a space on both sides. A padded word that is no longer than n gives
    itself once for the least such n and nothing for greater ones."""

    def of_word(w: Column) -> Column:
        padded, size = F.concat(F.lit(" "), w, F.lit(" ")), F.length(w) + 2

        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))
            return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

        none = F.array().cast("array<string>")
        return F.concat(grams(low), *[F.when(size > n - 1, grams(n)).otherwise(none) for n in range(low + 1, high + 1)])

    return F.flatten(F.transform(F.filter(F.split(F.lower(normalize_text(c)), " "), lambda w: w != ""), of_word))


def clean_json_text(c: Column) -> Column:
    """A reply without the code fence around it."""
    t = F.btrim(_blank(c), F.lit(" \t\n\r"))
    bare = F.btrim(F.regexp_replace(F.btrim(t, F.lit("`")), r"(?s)^(.*?)json", "$1"), F.lit(" \t\n\r"))
    return F.when(F.startswith(t, F.lit("```")), bare).otherwise(t)


def parse_quads(raw: Column) -> Column:
    """The array of quadruples in a reply; anything but a JSON list gives an empty one."""
    from graphloom.schemas import ddl

    t = clean_json_text(raw)
    empty = F.array().cast(ddl("llm_quads"))
    return F.when(F.startswith(t, F.lit("[")), F.coalesce(F.from_json(t, ddl("llm_quads")), empty)).otherwise(empty)


def render_prompt(template: str, year: Column, abstract: Column) -> Column:
    """A template with {year} and {abstract}; doubled braces are single ones."""
    out: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find(m), m) for m in ("{{", "}}", "{year}", "{abstract}") if m in rest]
        if not spots:
            out.append(F.lit(rest))
            break
        at, mark = min(spots)
        out.append(F.lit(rest[:at]))
        out.append({"{{": F.lit("{"), "}}": F.lit("}"), "{year}": F.coalesce(year.cast("string"), F.lit("None")), "{abstract}": F.coalesce(abstract, F.lit("None"))}[mark])
        rest = rest[at + len(mark) :]
    return F.concat(*out) if out else F.lit("")


def valid_entity(c: Column) -> Column:
    """Not empty, at most 8 words, and not beginning with one of the barred phrases (no word boundary is asked for)."""
    t = F.lower(normalize_text(c))
    barred = t.rlike("^(" + "|".join(V.INVALID_PREFIXES) + ")")
    return (_blank(c) != "") & (word_count(c) <= 8) & ~barred


def confidence_label(p: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(V.CONFIDENCE_BANDS):
        out = F.when(p >= least, name).otherwise(out)
    return out


def percent(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count * 100.0, total), F.lit(0.0))
