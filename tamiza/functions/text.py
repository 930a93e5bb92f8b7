"""Scalar text operators as Column expressions.

Java's regular expressions differ from Python's in what `\\s` and `\\b` cover, so
every pattern here uses `(?U)` and the explicit white-space class WS.
All functions return NULL for NULL unless their docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same set as Python's str.isspace over the BMP.
WS = r"[\s\x1c-\x1f\x85]"

#: Token alphabets used by the different stages; fixed values.
ASCII_WORD = r"[a-z]+"
LATIN_WORD = r"[A-Za-zÀ-ÿ]+"
SPANISH_WORD = r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ]+"
SPANISH_LOWER_WORD = r"(?iu)[a-záéíóúüñ]+"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f refers to it."""
    return F.transform(F.array(x), f)[0]


def sub(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(to))


def strip(x: Column, chars: str | None = None) -> Column:
    """Python's str.strip; chars: a regex class body instead of white space."""
    c = WS if chars is None else f"[{chars}]"
    return sub(x, rf"(?U)\A{c}+|{c}+\z", "")


def collapse(x: Column) -> Column:
    return sub(x, rf"(?U){WS}+", " ")


def is_blank(x: Column) -> Column:
    """True for NULL and for white space only."""
    return F.coalesce(~x.rlike(rf"(?U)[^\s\x1c-\x1f\x85]"), F.lit(True))


def blank_to_null(x: Column) -> Column:
    return F.when(~is_blank(x), x)


def first_non_blank(*cols: Column) -> Column:
    """The first column that holds text; "" if none does."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def fold_rules(x: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Ordered regex rules over the running text, one reference each."""
    for pattern, to in rules:
        x = sub(x, pattern, to)
    return x


# ---- normalisers (G1 to G8) -------------------------------------------------


def normalize_b(x: Column) -> Column:
    """Collapse, strip, no white space before closing punctuation."""
    return sub(strip(collapse(x)), rf"(?U){WS}+([.,;:!?])", "$1")


def normalize_a(x: Column) -> Column:
    """G1: as G2, then one trailing full stop goes unless it is an ellipsis."""
    return let(normalize_b(x), lambda t: F.when(t.endswith(".") & ~t.endswith("..."), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


def normalize_spaces(x: Column) -> Column:
    """G3."""
    return strip(collapse(x))


def normalize_controls(x: Column) -> Column:
    """Control characters and no-break spaces become plain spaces."""
    return strip(collapse(sub(x, "[\\x00-\\x1f\\x7f-\\x9f\\xa0]", " ")))


def sanitize(x: Column) -> Column:
    """NULL becomes ""; byte-order marks go, controls become spaces."""
    t = F.replace(F.coalesce(x, F.lit("")), F.lit("﻿"), F.lit(""))
    return strip(collapse(sub(t, "[\\x00-\\x1f\\x7f-\\x9f]", " ")))


def clean_runs(x: Column) -> Column:
    """Long punctuation runs and the spaces around them."""
    return strip(
        fold_rules(
            x,
            [
                ("[\\x00-\\x1f\\x7f-\\x9f]", " "),
                (r"\.{4,}", "..."),
                (r"\?{4,}", "?"),
                (r"!{4,}", "!"),
                (rf"(?U){WS}+", " "),
                (rf"(?U){WS}+([.,;:])", "$1"),
            ],
        )
    )


def trailing_dots(x: Column) -> Column:
    """G7."""
    return sub(x, r"\.{2,}\z", ".")


def strip_only_period(x: Column) -> Column:
    """A final full stop goes if it is the only one of the text."""
    return let(x, lambda t: F.when((F.regexp_count(t, F.lit(r"\.")) == 1) & t.endswith("."), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


# ---- accents (G9, G10) ------------------------------------------------------


@lru_cache
def _one_to_one(form: str, keep: str = "") -> tuple[str, str]:
    """Characters of the BMP that are one character without their marks."""
    a, b = [], []
    for cp in range(0x80, 0xFFFE):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3 or ch in keep:
            continue
        bare = "".join(c for c in unicodedata.normalize(form, ch) if not unicodedata.category(c).startswith("M"))
        if len(bare) == 1 and bare != ch:
            a.append(ch)
            b.append(bare)
    return "".join(a), "".join(b)


def strip_accents(x: Column) -> Column:
    """Canonical decomposition without marks (ñ becomes n)."""
    a, b = _one_to_one("NFD")
    return sub(F.translate(x, a, b), r"\p{Mn}+", "")


def strip_accents_keep_enye(x: Column) -> Column:
    """Compatibility decomposition without marks, ñ and Ñ stay."""
    a, b = _one_to_one("NFKD", "ñÑ")
    return sub(F.translate(x, a, b), r"\p{M}+", "")


def match_form(x: Column) -> Column:
    """Lower case without accents, the form lexicons are matched in."""
    return strip_accents(F.lower(x))


# ---- the rest of §2.7 -------------------------------------------------------

#: Ranges removed as emoji; fixed values. They reach far beyond emoji, as they always did.
EMOJI = r"[\x{24C2}-\x{1F251}\x{2600}-\x{2B55}\x{10000}-\x{10FFFF}\x{200D}\x{231A}\x{23CF}\x{23E9}\x{3030}\x{FE0F}]+"


def remove_emoji(x: Column) -> Column:
    """Every run becomes one space; NULL becomes ""."""
    return sub(F.coalesce(x, F.lit("")), EMOJI, " ")


def capitalize_sentences(x: Column) -> Column:
    """First character, and ASCII letters after a sentence end."""
    t = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))
    for c in "abcdefghijklmnopqrstuvwxyz":
        t = sub(t, rf"(?U)(?<=[.!?])({WS}*){c}", f"$1{c.upper()}")
    return t


def case_variants(pattern: str, to: str, upper: bool = True) -> list[tuple[str, str]]:
    """A plain word rule as ordered exact-case rules: ALL UPPER (optional), Capitalised, anything else."""
    cap = lambda s: s[:1].upper() + s[1:].lower()
    any_case = lambda c: f"[{c.lower()}{c.upper()}]" if c.isalpha() else c
    first, rest = pattern[:1], pattern[1:]
    rules = []
    if upper:
        rules.append((rf"(?U)\b{pattern.upper()}\b", to.upper()))
    rules.append((rf"(?U)\b{first.upper()}{''.join(map(any_case, rest))}\b", cap(to)))
    rules.append((rf"(?iuU)\b{pattern}\b", to))
    return rules


def alnum_signature(x: Column) -> Column:
    """G14."""
    return F.lower(sub(x, "[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+", ""))


def is_safe_replacement(a: Column, b: Column) -> Column:
    """Same letters and digits."""
    return alnum_signature(a) == alnum_signature(b)


def consonant_skeleton(x: Column) -> Column:
    """G16."""
    return sub(x, "(?iu)[aeiouáéíóúü]+", "")


def has_accent(x: Column) -> Column:
    """G17."""
    return x.rlike("(?iu)[áéíóú]")


def tokens(x: Column, alphabet: str = ASCII_WORD) -> Column:
    """All runs of the alphabet; NULL gives no tokens."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(alphabet), F.lit(0))


def words(x: Column) -> Column:
    """Python's str.split()."""
    return F.filter(F.split(strip(F.coalesce(x, F.lit(""))), rf"(?U){WS}+"), lambda w: w != "")


def n_words(x: Column) -> Column:
    """G19."""
    return F.size(words(x))


def clip_for_model(x: Column, most: int = 2000, least: int = 2, mark: str = "[CORTO_O_VACIO]") -> Column:
    """The request text of the external normaliser; short texts get the mark."""
    return let(strip(F.coalesce(x, F.lit(""))), lambda t: F.when(F.length(t) < least, F.lit(mark)).otherwise(F.substring(t, 1, most)))


def rating_value(num: Column, text: Column | None = None) -> Column:
    """Whole part of a number; else the first digits of the text."""
    n = num.cast("string").try_cast("double").try_cast("int")
    if text is None:
        return n
    return F.coalesce(n, F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int"))


def has_keywords(toks: Column, norm: Column, word_set: Iterable[str], phrases: Iterable[str] = ()) -> Column:
    """A word as token, or a phrase as substring."""
    c = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in sorted(word_set)]))
    for p in phrases:
        c = c | norm.contains(p)
    return c


def has_phrase(norm: Column, phrases: Iterable[str]) -> Column:
    """A phrase between word boundaries."""
    import re

    return norm.rlike(r"(?U)\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(phrases)) + r")\b")


def cloud_words(x: Column, min_len: int = 3) -> Column:
    """Words for a word cloud; ñ splits words as in the original rule."""
    t = sub(strip_accents_keep_enye(F.lower(F.coalesce(x, F.lit("")))), rf"(?U)[^a-z\s\x1c-\x1f\x85]", " ")
    return F.filter(words(t), lambda w: F.length(w) >= min_len)
