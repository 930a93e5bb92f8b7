"""Corpus statistics and the repairs mined from them.

Statistics are exploded and counted with map-side combination; rules come out as
tables. Texts are then rewritten row by row; only the token pairs that occur in
a rule are looked up, by a broadcast map of checked size or, beyond it, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamiza.functions.lineage import written
from tamiza.functions.text import LATIN_WORD, SPANISH_WORD, collapse, fold_rules, let, strip, strip_only_period
from tamiza.lexicons import rules as lx

_HAS_VOWEL = "[aeiouáéíóúü]"
#: Mined rules up to this many are broadcast; more are joined.
MOST_BROADCAST = 200_000


def token_lists(df: DataFrame, columns: list[str], alphabet: str = LATIN_WORD) -> DataFrame:
    """(t): the tokens of every cell of the columns, lower case; NULL cells have none."""
    cells = F.array(*[F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(alphabet), F.lit(0)) for c in columns])
    return df.select(F.explode(cells).alias("t"))


def word_counts(df: DataFrame, columns: list[str], alphabet: str = LATIN_WORD, valid_only: bool = False) -> DataFrame:
    """(token, n) over all columns together; valid_only: D8's vocabulary tokens."""
    t = token_lists(df, columns, alphabet).select(F.explode("t").alias("token"))
    if valid_only:
        t = t.filter(~F.col("token").isin(*lx.DOMAIN_TERMS) & (F.length("token") >= 3) & F.col("token").rlike(_HAS_VOWEL))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def pairs(t: Column) -> Column:
    """Adjacent pairs of a token array."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.struct(a.alias("t1"), b.alias("t2")))


def pair_counts(df: DataFrame, columns: list[str], alphabet: str = LATIN_WORD, stopwords: list[str] | None = None, longest: tuple[int, int] | None = None) -> DataFrame:
    """(t1, t2, n) of adjacent tokens within a cell, without stopwords."""
    stop = lx.SPLIT_STOPWORDS if stopwords is None else stopwords
    p = token_lists(df, columns, alphabet).select(F.explode(pairs(F.col("t"))).alias("p")).select("p.t1", "p.t2")
    if stop:
        p = p.filter(~F.col("t1").isin(*stop) & ~F.col("t2").isin(*stop))
    if longest:
        p = p.filter((F.length("t1") <= longest[0]) & (F.length("t2") <= longest[1]))
    return p.groupBy("t1", "t2").agg(F.count("*").alias("n"))


def regex_pair_counts(df: DataFrame, column: str) -> DataFrame:
    """(pair, n) of non-overlapping short-word pairs, lower case, one space between."""
    found = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(?U)\b[A-Za-zÀ-ÿ]{1,4}[\s\x1c-\x1f\x85]+[A-Za-zÀ-ÿ]{2,10}\b"), F.lit(0))
    return df.select(F.explode(found).alias("p")).select(F.lower(collapse(F.col("p"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def suspicious_characters(df: DataFrame, column: str) -> DataFrame:
    """(ch, n)."""
    x = F.coalesce(F.col(column), F.lit(""))
    one = df.agg(*[F.coalesce(F.sum(F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(lx.SUSPICIOUS_CHARACTERS)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(f"c{i}").alias("n")) for i, c in enumerate(lx.SUSPICIOUS_CHARACTERS)])).alias("v")).select("v.*")


def no_vowel_tokens(df: DataFrame, column: str, detailed: bool = False) -> DataFrame:
    """(token, n) of tokens of four letters or more without a vowel, as written; detailed: ñ counts as a vowel, domain terms are left out, and of each row the first five count."""
    vowels = "[aeiouáéíóúüñAEIOUÁÉÍÓÚÜ]" if detailed else "[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]"
    toks = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(LATIN_WORD), F.lit(0))
    own = F.filter(toks, lambda w: (F.length(w) >= 4) & ~w.rlike(vowels) & (~F.lower(w).isin(*lx.DOMAIN_TERMS) if detailed else F.lit(True)))
    return df.select(F.explode(F.slice(own, 1, 5) if detailed else own).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(token)."""
    t = token_lists(df, columns).select(F.explode("t").alias("token"))
    return t.filter((F.length("token") >= 3) & ~F.col("token").isin(*lx.DOMAIN_TERMS)).distinct()


def missing_letter_pairs(df: DataFrame, column: str, vocab: DataFrame, id_col: str = "id_review") -> DataFrame:
    """(id, t1, t2, candidate): short pairs that one letter joins into a known word; the first such letter counts."""
    return missing_letters_at(df, column, vocab, F.col(id_col)).drop("at")


def missing_letters_at(df: DataFrame, column: str, vocab: DataFrame, key: Column) -> DataFrame:
    """(id, at, t1, t2, candidate): as missing_letter_pairs, with the key of the row and the pair's place among the row's short pairs."""
    found = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(?U)\b[A-Za-zÀ-ÿ]{1,4}[\s\x1c-\x1f\x85]+[A-Za-zÀ-ÿ]{2,10}\b"), F.lit(0))
    p = df.select(key.alias("id"), F.posexplode(found).alias("at", "p")).select("id", "at", F.split(collapse(F.col("p")), " ").alias("w"))
    p = p.select("id", "at", F.col("w")[0].alias("t1"), F.col("w")[1].alias("t2")).filter(~F.lower("t1").isin(*lx.DOMAIN_TERMS) & ~F.lower("t2").isin(*lx.DOMAIN_TERMS))
    letters = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(lx.LETTERS_MISSING)])
    distinct = p.select(F.lower("t1").alias("l1"), F.lower("t2").alias("l2")).distinct()
    cand = distinct.select("l1", "l2", F.explode(letters).alias("x")).select("l1", "l2", "x.i", F.concat("l1", "x.c", "l2").alias("token"))
    best = cand.join(vocab, "token", "left_semi").groupBy("l1", "l2").agg(F.min_by("token", "i").alias("candidate"))
    return p.join(best, (F.lower("t1") == F.col("l1")) & (F.lower("t2") == F.col("l2"))).select("id", "at", "t1", "t2", "candidate")


def _joined(pair: DataFrame, words: DataFrame, letters: list[str]) -> DataFrame:
    """Pairs with every letter between that makes a counted word: t1, t2, n, i, token, freq."""
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(letters)])
    cand = pair.select("t1", "t2", "n", F.explode(options).alias("x")).select("t1", "t2", "n", "x.i", F.concat("t1", "x.c", "t2").alias("token"))
    return cand.join(words.select("token", F.col("n").alias("freq")), "token")


def mined_letter_rules(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """(t1, t2, n, word, freq): torn pairs and the most frequent word that one letter makes of them."""
    words = word_counts(df, columns, SPANISH_WORD).filter(F.col("n") >= least)
    pair = pair_counts(df, columns, SPANISH_WORD, lx.LETTER_STOPWORDS, (15, 8)).filter(F.col("n") >= least)
    first = F.row_number().over(Window.partitionBy("t1", "t2").orderBy(F.desc("freq"), "i"))
    return _joined(pair, words, lx.LETTERS_TO_TRY).withColumn("k", first).filter("k = 1").select("t1", "t2", "n", F.col("token").alias("word"), "freq")


def mined_split_rules(df: DataFrame, columns: list[str], pair_least: int = 2, word_least: int = 2, ratio: float = 2.0, fragment_most: int = 3) -> DataFrame:
    """D7's table: (t1, t2, word): rare fragments whose join is a word at least `ratio` times as frequent as the pair."""
    token = word_counts(df, columns)
    words = token.filter(~F.col("token").isin(*lx.DOMAIN_TERMS) & (F.length("token") >= 3) & F.col("token").rlike(_HAS_VOWEL) & (F.col("n") >= word_least))
    pair = pair_counts(df, columns).filter((F.col("n") >= pair_least) & ~F.col("t1").isin(*lx.DOMAIN_TERMS) & ~F.col("t2").isin(*lx.DOMAIN_TERMS))
    pair = pair.filter((F.length("t1") <= 4) & F.length("t2").between(2, 10))
    often = token.filter(F.col("n") > fragment_most)
    pair = pair.join(often.select(F.col("token").alias("t1")), "t1", "left_anti").join(often.select(F.col("token").alias("t2")), "t2", "left_anti")
    good = _joined(pair, words, lx.LETTERS_TO_INSERT).filter((F.length("token") >= 4) & (F.col("freq") >= F.col("n") * ratio))
    first = F.row_number().over(Window.partitionBy("t1", "t2").orderBy(F.desc("freq"), "i"))
    return good.withColumn("k", first).filter("k = 1").select("t1", "t2", F.col("token").alias("word"))


def _rewriter(pattern: str, keep_case: bool, rules: dict[str, str]):
    import re

    compiled = re.compile(pattern, re.UNICODE)

    def one(m) -> str:
        a, b = m.group(1), m.group(2)
        to = rules.get(f"{a.lower()} {b.lower()}")
        if to is None:
            return m.group(0) if not keep_case else f"{a} {b}"
        return to.capitalize() if keep_case and a[0].isupper() else to

    return lambda t: compiled.sub(one, t)


_SPLIT = r"\b([A-Za-zÀ-ÿ]{1,4})[ \t]+([A-Za-zÀ-ÿ]{2,10})\b"


def rewrite_pairs(df: DataFrame, column: str, rules: DataFrame, name: str | None = None) -> DataFrame:
    """Left to right, non-overlapping; a replacement starts with a capital if the pair did. Up to MOST_BROADCAST rules travel with the tasks; beyond that only the rules of a row's own pairs do."""
    name = name or column
    got = rules.select(F.concat_ws(" ", "t1", "t2").alias("k"), "word").limit(MOST_BROADCAST + 1).collect()
    if len(got) <= MOST_BROADCAST:
        table = df.sparkSession.sparkContext.broadcast({r["k"]: r["word"] for r in got})

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            f = _rewriter(_SPLIT, True, table.value)
            for s in parts:
                yield s.map(lambda t: None if t is None else f(t))

        return df.withColumn(name, run(F.col(column)))
    # The row numbers are read twice: written once, so that both readings have the same.
    keyed = written(df.withColumn("__row", F.monotonically_increasing_id()))
    own = keyed.select("__row", F.explode(F.array_distinct(F.transform(pairs(F.regexp_extract_all(F.lower(column), F.lit(LATIN_WORD), F.lit(0))), lambda p: F.concat_ws(" ", p["t1"], p["t2"])))).alias("k"))
    mine = own.join(rules.select(F.concat_ws(" ", "t1", "t2").alias("k"), "word"), "k").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "word"))).alias("__rules"))

    @F.pandas_udf("string")
    def each(s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rewriter(_SPLIT, True, dict(r) if r is not None else {})(t) for t, r in zip(s, m)], dtype=object)

    return keyed.join(mine, "__row", "left").withColumn(name, each(F.col(column), F.col("__rules"))).drop("__row", "__rules")


def clean_split_words(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Strip, D7, G8, collapse; NULL stays."""
    rows = rewrite_pairs(df.withColumn(column, strip(F.col(column))), column, rules)
    return rows.withColumn(column, strip(collapse(let(F.col(column), strip_only_period))))


#: What Java's regex stands for by an `i`, `k` or `s` in any case, besides lower().
_FOLDED = str.maketrans("ıİK\u017f", "iiks")


@cache
def _word_run() -> str:
    """Runs of what Java's Unicode \\w holds: letters, marks, decimal digits, letter numbers, connectors, joiners."""
    import sys
    import unicodedata

    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in _IN_WORDS or c in (0x200C, 0x200D) or 0x24B6 <= c <= 0x24E9:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]+"


_IN_WORDS = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"))


def _in_turn(run: str, rules: dict[tuple[str, str], tuple[tuple, str]]):
    """A function of a text: the rules one after the other by rank, each wherever its pair stands by then. rules: (t1, t2) to (rank, word)."""
    import re

    words = re.compile(run)

    def one(t: str) -> str:
        last: tuple = ()
        while True:
            w = [(m.start(), m.end(), m[0].translate(_FOLDED).lower()) for m in words.finditer(t)]
            hits = [rules.get((a[2], b[2])) if t[a[1] : b[0]].isspace() else None for a, b in zip(w, w[1:])]
            rank = min((h[0] for h in hits if h and h[0] > last), default=None)
            if rank is None:
                return t
            out, at, i = [], 0, 0
            while i < len(hits):
                if hits[i] and hits[i][0] == rank:
                    out += [t[at : w[i][0]], hits[i][1]]
                    at = w[i + 1][1]
                    i += 1
                i += 1
            t, last = "".join(out) + t[at:], rank

    return one


def _own_rules(keyed: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """(__row, __rules): the rules whose pair stands in the row, or may once other rules of the row have made a word of theirs."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)), lambda x: F.lower(F.translate(x, "ıİK\u017f", "iiks"))))
    has = written(keyed.select("__row", F.explode(words).alias("w")))
    a, b = has.withColumnRenamed("w", "t1"), has.withColumnRenamed("w", "t2")
    new = found = written(rules.join(a, "t1").join(b, ["__row", "t2"]).select("__row", "t1", "t2", "n", "word"))
    while not new.isEmpty():
        made = new.select("__row", F.col("word").alias("w")).distinct()
        has = written(has.unionByName(made).distinct())
        a, b = has.withColumnRenamed("w", "t1"), has.withColumnRenamed("w", "t2")
        later = rules.join(made.withColumnRenamed("w", "t1"), "t1").join(b, ["__row", "t2"]).select("__row", "t1", "t2", "n", "word")
        later = later.unionByName(rules.join(made.withColumnRenamed("w", "t2"), "t2").join(a, ["__row", "t1"]).select("__row", "t1", "t2", "n", "word"))
        new = written(later.distinct().join(found.select("__row", "t1", "t2"), ["__row", "t1", "t2"], "left_anti"))
        found = found.unionByName(new)
    return found.groupBy("__row").agg(F.collect_list(F.struct("t1", "t2", "n", "word")).alias("__rules"))


def _ranked(rules) -> dict[tuple[str, str], tuple[tuple, str]]:
    return {(r["t1"], r["t2"]): ((-r["n"], r["t1"], r["t2"]), r["word"]) for r in rules}


def apply_letter_rules(df: DataFrame, column: str, rules: DataFrame, name: str | None = None) -> DataFrame:
    """D6 applied: the mined pairs, wherever they stand in the text, become their word as it is; most frequent pairs first, after the fixed rules. However many rules there are, all apply alike; up to MOST_BROADCAST travel with the tasks, beyond that only a row's own do."""
    name = name or column
    run_of = _word_run()
    fixed = fold_rules(F.col(column), [("(?iuU)" + p, to) for p, to in lx.LETTERS])
    rules = rules.select("t1", "t2", "n", "word")
    got = rules.limit(MOST_BROADCAST + 1).collect()
    rows = df.withColumn("__was", F.col(column)).withColumn("__t", fixed)
    if len(got) <= MOST_BROADCAST:
        table = df.sparkSession.sparkContext.broadcast(_ranked(got))

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            f = _in_turn(run_of, table.value)
            for s in parts:
                yield s.map(lambda t: None if t is None else f(t))

        rows = rows.withColumn("__t", run(F.col("__t")))
    else:
        keyed = written(rows.withColumn("__row", F.monotonically_increasing_id()))

        @F.pandas_udf("string")
        def each(s: pd.Series, m: pd.Series) -> pd.Series:
            return pd.Series([t if t is None or r is None else _in_turn(run_of, _ranked(r))(t) for t, r in zip(s, m)], dtype=object)

        rows = keyed.join(_own_rules(keyed, "__t", rules), "__row", "left").withColumn("__t", each(F.col("__t"), F.col("__rules"))).drop("__row", "__rules")
    t = F.col("__t")
    return rows.withColumn(name, F.when(t != F.col("__was"), strip(collapse(t))).otherwise(t)).drop("__was", "__t")


def examples(df: DataFrame, group: Column, text: Column, order: Column, most: int = 5) -> DataFrame:
    """The first texts of each group in order; a group of any size is reduced on the map side by rank within partitions."""
    rows = df.select(group.alias("group"), text.alias("text"), order.alias("order"))
    w = Window.partitionBy("group").orderBy("order", "text")
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("group", "k", "text")


def top_counts(counts: DataFrame, most: int, *tie: str) -> DataFrame:
    """The most frequent; ties in the order of the tie columns."""
    return counts.orderBy(F.desc("n"), *tie).limit(most)
