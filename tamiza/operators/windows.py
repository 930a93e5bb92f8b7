"""Predicates over windows of a token array (X1 to X4) and the phrase tests built on them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiza.functions.text import WS
from tamiza.lexicons import emotion as lx


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def contrast_pattern(words: Iterable[str]) -> str:
    return r"(?iuU)\b(?:" + "|".join(w.replace(" ", f"{WS}+") for w in words) + r")\b"


def where(t: Column, test) -> Column:
    """Positions, from 0, whose token passes the test."""
    return F.filter(F.transform(t, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def negations(t: Column) -> Column:
    """X1."""
    return where(t, lambda x: x.isin(*lx.NEGATIONS))


def negated(i: Column, neg: Column) -> Column:
    """A negation one to three tokens before."""
    return F.exists(neg, lambda n: (i - n).between(1, 3))


def negation_after(i: Column, neg: Column, window: int = 6) -> Column:
    """X3."""
    return F.exists(neg, lambda n: (n - i).between(1, window))


def reported(i: Column, rep: Column) -> Column:
    """A reporting term one to four tokens before; rep holds the positions of such terms."""
    return F.exists(rep, lambda r: (i - r).between(1, 4))


def plain_count(t: Column, neg: Column, words: Iterable[str]) -> Column:
    """How many tokens are among the words and not negated."""
    return F.size(F.filter(where(t, lambda x: x.isin(*words)), lambda i: ~negated(i, neg)))


def follows(t: Column, i: Column, phrase: str) -> Column:
    """The phrase starts at token i."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())])


def any_first_plain(t: Column, neg: Column, phrases: Iterable[str]) -> Column:
    """Some phrase's first occurrence has no negated word; its later occurrences don't count."""
    table = F.array(*[F.array(*map(F.lit, p.split())) for p in phrases])

    def test(p: Column) -> Column:
        n = F.size(p)
        at = F.get(F.filter(where(t, lambda x: x == p[0]), lambda i: F.slice(t, i + 1, n) == p), F.lit(0))
        # A negation reaches the three tokens behind it.
        return F.coalesce(~F.exists(neg, lambda g: (g + 1 <= at + n - 1) & (g + 3 >= at)), F.lit(False)) & at.isNotNull()

    return F.exists(table, test)
