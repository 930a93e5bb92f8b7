"""Repair of wrongly decoded columns by scored recoding."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiza.functions.text import collapse, let, strip, sub

# Characters that speak for and against readable Spanish.
REWARDED = "áéíóúñüÁÉÍÓÚÑÜ"
SUSPICIOUS = "�ÃÂâ£¢¤¥¦¨ªº¡¿"
#: Opening marks and ordinals are good Spanish; strict scoring doesn't hold them against a text.
STRICT_SUSPICIOUS = "�ÃÂâ£¢¤¥¦¨"

# Fixed values, replaced in this order; the last one drops what is left of a pair.
SEQUENCES = [
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã\xad", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã¼", "ü"), ("Ã\x81", "Á"), ("Ã\x89", "É"), ("Ã\x8d", "Í"), ("Ã\x93", "Ó"), ("Ã\x9a", "Ú"), ("Ã\x91", "Ñ"), ("Ã\x9c", "Ü"),
    ("â\x80\x99", "’"), ("â\x80\x9c", '"'), ("â\x80\x9d", '"'), ("â\x80\x94", "-"), ("â\x80\x93", "-"), ("â\x80¦", "..."), ("â\x80¢", "-"), ("Â", ""),
]
PAGES = ("latin-1", "cp1252", "cp850", "cp437")


def score(x: Column, strict: bool = False) -> Column:
    """E1 (and E2, whose word bonus never came about): rewarded less suspicious characters."""
    count = lambda chars: F.length(x) - F.length(sub(x, f"[{chars}]", ""))
    return count(REWARDED) - count(STRICT_SUSPICIOUS if strict else SUSPICIOUS)


@lru_cache
def _table(page_from: str, page_to: str) -> tuple[str, str, str]:
    """Characters of one page, what their bytes are in another, and a class of all that can be recoded."""
    a, b, same = [], [], []
    for i in range(256):
        try:
            x, y = bytes([i]).decode(page_from), bytes([i]).decode(page_to)
        except UnicodeDecodeError:
            continue
        same.append(x)
        if x != y:
            a.append(x)
            b.append(y)
    cls = "".join(f"\\x{{{ord(c):x}}}" for c in same)
    return "".join(a), "".join(b), cls


def recode(x: Column, page_from: str, page_to: str) -> Column:
    """The text's bytes in one page read in another or as utf-8; NULL where that fails."""
    if page_to == "utf-8":
        a, b, cls = _table(page_from, "latin-1")
        latin = F.translate(x, a, b) if a else x
        # The guard comes first: encoding throws on characters the page lacks.
        bytes_ = F.when(x.rlike(rf"\A[{cls}]*\z"), F.encode(latin, "ISO-8859-1"))
        return F.try_validate_utf8(bytes_.cast("string"))
    a, b, cls = _table(page_from, page_to)
    return F.when(x.rlike(rf"\A[{cls}]*\z"), F.translate(x, a, b) if a else x)


def best(x: Column, options: list[Column], strict: bool = False) -> Column:
    """The best scored; the text itself wins ties, then the earlier option."""
    every = F.array(*[F.when(o.isNotNull(), F.struct(score(o, strict).alias("s"), F.lit(-i).alias("i"), o.alias("c"))) for i, o in enumerate([x, *options])])
    return F.array_max(F.array_compact(every))["c"]


def options(x: Column) -> list[Column]:
    """E5: sixteen readings in a fixed order, utf-8 first for each page."""
    return [recode(x, p, q) for p in PAGES for q in ("utf-8", *[o for o in PAGES if o != p])]


def sequences(x: Column) -> Column:
    """E7."""
    for a, b in SEQUENCES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _finish(x: Column) -> Column:
    return strip(collapse(sub(sequences(x), "[\\x00-\\x1f\\x7f-\\x9f]", " ")))


def _bare(x: Column) -> Column:
    return sub(F.translate(x, "\xa0", " "), "[﻿�]", "")


def sanitize_gated(x: Column, strict: bool = False) -> Column:
    """Two readings, tried only where a suspicious character stands."""

    def run(t: Column) -> Column:
        tried = best(t, [recode(t, "latin-1", "utf-8"), recode(t, "cp1252", "cp850")], strict)
        return F.when(t.rlike(f"[{STRICT_SUSPICIOUS if strict else SUSPICIOUS}]"), tried).otherwise(t)

    return _finish(let(_bare(x), run))


def sanitize_all(x: Column, strict: bool = False) -> Column:
    """Sixteen readings, always tried; plain ASCII reads the same in all of them and is left alone."""
    return _finish(let(_bare(x), lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), best(t, options(t), strict)).otherwise(t)))


def every_string(df: DataFrame, f) -> DataFrame:
    """F on every string column."""
    return df.select(*[f(df[c.name]).alias(c.name) if isinstance(c.dataType, T.StringType) else df[c.name] for c in df.schema.fields])


def changed_cells(before: DataFrame, f) -> DataFrame:
    """(column, changed): cells that f changes."""
    cols = [c.name for c in before.schema.fields if isinstance(c.dataType, T.StringType)]
    one = before.agg(*[F.count_if(~before[c].eqNullSafe(f(before[c]))).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in cols])).alias("v")).select("v.*")
