"""Visually identical text with different characters.

Texts that hold none of the characters in question are already in the common
form and never leave their scan. The others are cut into pieces (letters with
their marks, and what stands between), and only the pieces in question are
exploded to positioned code points: a broadcast join gives each its decomposition
or look-alike, combining marks are ordered by class behind their base, a second
broadcast join composes base and marks again, and pieces and texts are rebuilt.

The common form: full-width, half-width and mathematical letters, joined letters
and foreign spaces become plain ones; zero-width characters, direction marks and
soft hyphens go (but not the joiner inside emoji sequences); base and mark become
one character, in canonical order; letters of another script become Latin if they
stand in a Latin word, or if the whole word consists of letters that look Latin;
circled letters become letters within words. Foreign words, emoji, typographic
signs, raised and lowered signs, fractions, tabs and line breaks stay. Which
characters have another form, and what it is, is taken from Unicode's own data;
only the look-alikes of Latin letters are listed. Korean, and signs composed of
several bases, are left as they are.

Defined cases: NULL stays NULL; empty and blank texts stay (foreign spaces become
plain); repeated texts are normalised once and come out alike; very long texts
are whole; an empty table gives an empty result. Input columns stay, whatever
their names; one named like the result is replaced.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
_FOREIGN = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}"
_EMOJI = r"\p{So}\x{FE0F}\x{1F3FB}-\x{1F3FF}"
_JOINER = rf"(?<![{_EMOJI}])\x{{200D}}|\x{{200D}}(?![{_EMOJI}])"
_CIRCLED = r"\x{24B6}-\x{24E9}"
_LETTERS = rf"[\p{{L}}\p{{Mn}}{_CIRCLED}\x{{200D}}{_INVISIBLE}]+"
_PIECE = rf"{_LETTERS}|[^\p{{L}}\p{{Mn}}{_CIRCLED}\x{{200D}}{_INVISIBLE}]+"

# Letters that look like Latin ones in any context.
ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "օ": "o", "ս": "u", "հ": "h",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z", "Ꭵ": "i", "Ꮷ": "d",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "ɡ": "g", "ɑ": "a",
}
# Letters that pass for Latin ones only among Latin letters.
ALIKE_INSIDE = {"α": "a", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "ϲ": "c", "ϳ": "j", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r", "ո": "n", "ց": "g"}


#: Kinds of compatibility forms that look like the plain character.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>"}


def _decomposed(ch: str) -> str:
    """What a character consists of; itself where its compatibility form looks different."""
    if unicodedata.category(ch) == "Zs":
        return " "
    name, of = unicodedata.name(ch, ""), unicodedata.decomposition(ch)
    if not of or "HANGUL" in name or 0xAC00 <= ord(ch) <= 0xD7A3:
        return ch
    tag = of.split()[0]
    if tag in _SAME_LOOK or tag == "<compat>" and name.startswith(("LATIN", "ARMENIAN SMALL LIGATURE")):
        whole = unicodedata.normalize("NFKD", ch)
        if " " not in whole:
            return whole
        return chr(int(of.split()[1], 16)) if tag == "<wide>" else ch
    whole = unicodedata.normalize("NFD", ch)
    # What consists of several bases (vowel signs of Indian scripts) is one character already.
    return ch if any(not unicodedata.combining(c) for c in whole[1:]) and unicodedata.normalize("NFC", ch) == ch else whole


def plain_form(ch: str) -> str:
    """The common form of a single character that stands alone; invisible ones and look-alikes aside."""
    return unicodedata.normalize("NFC", _decomposed(ch))


@cache
def _all() -> list[str]:
    return [chr(o) for o in range(0x80, sys.maxunicode + 1) if not 0xD800 <= o <= 0xDFFF]


def _ranges(chars: list[str]) -> str:
    """A class body of the characters, in order."""
    spans: list[list[int]] = []
    for o in map(ord, chars):
        if spans and spans[-1][1] == o - 1:
            spans[-1][1] = o
        else:
            spans.append([o, o])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in spans)


def _questionable() -> str:
    own = _ranges([c for c in _all() if c > "\xff" and plain_form(c) != c])
    listed = _ranges(sorted({**ALIKE, **ALIKE_INSIDE}))
    # Characters below U+0100, which most are, are settled by the first class.
    return rf"[\x{{A0}}\x{{AD}}]|(?=[^\x00-\xFF])(?:[{own}{listed}{_CIRCLED}{_FOREIGN}{_INVISIBLE}[\p{{M}}&&[^\x{{FE00}}-\x{{FE0F}}]]]|{_JOINER})"


#: A text or piece with one of these may have to change.
QUESTIONABLE = _questionable()


def characters(spark: SparkSession) -> DataFrame:
    """(ch, plain, inside): what a character becomes, in decomposed form, and what it becomes in a Latin word. Bounded by Unicode: a few thousand rows."""
    rows = {}
    for ch in _all():
        d = _decomposed(ch)
        if d != ch:
            rows[ch] = [d, d]
    for a, b in _HIDDEN:
        for o in range(a, b + 1):
            rows[chr(o)] = ["", ""]
    for ch, to in {**ALIKE, **ALIKE_INSIDE}.items():
        rows[ch] = [rows.get(ch, [ch])[0], to]
    for o in range(0x24B6, 0x24EA):
        rows[chr(o)] = [chr(o), unicodedata.normalize("NFKD", chr(o))]
    for ch, (plain, _) in rows.items():  # accented foreign letters: their base is looked up again
        if len(plain) > 1 and plain[0] in ALIKE | ALIKE_INSIDE:
            rows[ch][1] = (ALIKE | ALIKE_INSIDE)[plain[0]] + plain[1:]
    return spark.createDataFrame([(k, p, i) for k, (p, i) in rows.items()], "ch string, plain string, inside string")


_HIDDEN = [tuple(int(x, 16) for x in (m[0] or m[2], m[1] or m[2])) for m in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}|\\x\{(\w+)\}", _INVISIBLE)]


def compositions(spark: SparkSession) -> DataFrame:
    """(parts, whole): base with marks in canonical order, and the one character for it."""
    rows = []
    for ch in _all():
        if unicodedata.decomposition(ch)[:1] not in ("", "<") and (d := unicodedata.normalize("NFD", ch)) != ch and unicodedata.normalize("NFC", d) == ch:
            rows.append((d, ch))
    return spark.createDataFrame(rows, "parts string, whole string")


def _marks() -> list[tuple[str, int]]:
    return [(c, unicodedata.combining(c)) for c in _all() if unicodedata.combining(c)]


def _code_points(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?s)."), F.lit(0))


def normal_forms(texts: DataFrame) -> DataFrame:
    """(key, form) for a table of distinct (key, text) whose texts are QUESTIONABLE."""
    spark = texts.sparkSession
    cut = texts.select("key", F.regexp_extract_all("text", F.lit(f"(?s){_PIECE}"), F.lit(0)).alias("pieces")).repartition("key")
    piece = cut.select("key", F.posexplode("pieces").alias("at", "piece")).filter(F.col("piece").rlike(QUESTIONABLE))
    latin = F.col("piece").rlike(r"\p{IsLatin}")
    alike = "".join(ALIKE)
    inside = "".join(ALIKE | ALIKE_INSIDE)
    base = F.regexp_replace("piece", rf"[\p{{Mn}}\x{{200D}}{_INVISIBLE}]", "")
    circled = base.rlike(rf"[{_CIRCLED}].*[{_CIRCLED}]|\p{{L}}[{_CIRCLED}]")
    # Accented foreign letters count by their base, so they are split before the test.
    foreign_accented = "".join(ch for o in range(0x370, 0x530) if (d := unicodedata.normalize("NFD", ch := chr(o))) != ch and d[0] in inside)
    all_alike = base.rlike(rf"\A[{alike}{foreign_accented}]+\z") | circled & base.rlike(rf"\A[{alike}{foreign_accented}{_CIRCLED}\p{{IsLatin}}]+\z")
    some_alike = latin & base.rlike(rf"[{inside}{foreign_accented}]")
    point = piece.select("key", "at", (some_alike | all_alike).alias("latin"), F.posexplode(_code_points(F.col("piece"))).alias("i", "ch"), "piece")
    # The joiner stays between emoji: pieces of letters hold it only next to letters, or alone between emoji.
    lone = F.col("piece") == "‍"
    to = point.join(F.broadcast(characters(spark)), "ch", "left")
    ch = F.when((F.col("ch") == "‍") & ~lone, F.lit("")).when(F.col("latin"), F.coalesce("inside", "ch")).otherwise(F.coalesce("plain", "ch"))
    part = to.select("key", "at", "i", F.posexplode_outer(_code_points(ch)).alias("j", "c")).withColumn("c", F.coalesce("c", F.lit("")))
    ccc = spark.createDataFrame(_marks(), "c string, ccc int")
    part = part.join(F.broadcast(ccc), "c", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    starter = F.sum(F.when((F.col("ccc") == 0) & (F.col("c") != ""), 1).otherwise(0)).over(Window.partitionBy("key", "at").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("base", starter)
    cluster = part.groupBy("key", "at", "base").agg(F.array_sort(F.collect_list(F.struct("ccc", "i", "j", "c"))).alias("cs"))
    chars = F.filter(F.transform("cs", lambda s: s["c"]), lambda c: c != "")
    cluster = cluster.select("key", "at", "base", F.array_join(chars, "").alias("s"))
    whole = F.broadcast(compositions(spark))
    one, two = whole.select(F.col("parts").alias("s"), F.col("whole").alias("w1")), whole.select(F.col("parts").alias("s2"), F.col("whole").alias("w2"))
    cluster = cluster.withColumn("s2", F.substring("s", 1, 2)).join(F.broadcast(one), "s", "left").join(F.broadcast(two), "s2", "left")
    composed = F.coalesce("w1", F.when(F.col("w2").isNotNull(), F.concat("w2", F.expr("substring(s, 3)"))), "s")
    fixed = cluster.groupBy("key", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", composed.alias("c")))), lambda x: x["c"]), "").alias("fixed"))
    pieces = fixed.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "fixed"))).alias("fix"))
    joined = cut.join(pieces, "key", "left")
    return joined.select("key", F.array_join(F.transform("pieces", lambda p, i: F.coalesce(F.try_element_at("fix", i), p)), "").alias("form"))


def _mended(touched: DataFrame) -> DataFrame:
    """(row, form) of (row, text) whose texts are QUESTIONABLE; equal texts are mended once."""
    touched = touched.withColumn("key", F.md5("text"))
    forms = normal_forms(touched.groupBy("key").agg(F.first("text").alias("text")))
    return touched.join(forms, "key").select("row", "text", "form")


def normalize(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """df with the common form of a text column."""
    rows = df.select(F.struct(*[df[c] for c in df.columns if c != form]).alias("row"), df[text].alias("text"))
    asked = F.coalesce(F.col("text").rlike(QUESTIONABLE), F.lit(False))
    clean = rows.filter(~asked).select("row", F.col("text").alias("form"))
    out = clean.unionByName(_mended(rows.filter(asked)).select("row", "form"))
    return out.select("row.*", F.col("form").alias(form))


def differing(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """The rows of df whose common form is another text, with that form."""
    rows = df.select(F.struct(*[df[c] for c in df.columns if c != form]).alias("row"), df[text].alias("text"))
    out = _mended(rows.filter(F.col("text").rlike(QUESTIONABLE))).filter(F.col("form") != F.col("text"))
    return out.select("row.*", F.col("form").alias(form))
