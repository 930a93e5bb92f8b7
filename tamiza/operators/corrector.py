"""Ordered rule correction with a change list (D1 to D5, D10 to D14), questions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiza.functions.text import WS, capitalize_sentences, case_variants, clean_runs, collapse, fold_rules, let, match_form, n_words, remove_emoji, strip, sub, tokens, trailing_dots
from tamiza.lexicons import rules as lx
from tamiza.operators.windows import any_of

Rules = list[tuple[str, str]]

#: A pattern with one of these is a regex of its own, anything else a plain word.
_META = "\\^$()|+*?[{"


def java(pattern: str) -> str:
    """A rule's pattern in Java's dialect, with Python's white space and word boundaries."""
    if not any(c in pattern for c in _META):
        pattern = rf"\b{pattern}\b"
    return "(?U)" + pattern.replace(r"\s", WS)


def apply_rules(x: Column, rules: Rules) -> Column:
    """struct(text, changes); every rule that fires adds one change. Texts no rule can touch skip the fold."""
    steps = F.array(*[F.struct(F.lit(java(p)).alias("p"), F.lit(to).alias("r")) for p, to in rules])
    none = lambda t: F.struct(t.alias("text"), F.array().cast("array<string>").alias("changes"))

    def step(s: Column, r: Column) -> Column:
        hit = F.rlike(s["text"], r["p"])
        text = F.when(hit, F.regexp_replace(s["text"], r["p"], r["r"])).otherwise(s["text"])
        return F.struct(text.alias("text"), F.when(hit, F.concat(s["changes"], F.array(F.concat(F.lit("→"), r["r"])))).otherwise(s["changes"]).alias("changes"))

    if not rules:
        return none(x)
    whole = "(?U)" + "|".join(f"(?:{java(p)[4:]})" for p, _ in rules)
    return let(x, lambda t: F.when(t.rlike(whole), F.aggregate(steps, none(t), step)).otherwise(none(t)))


ALL_RULES: Rules = [*lx.TORN_WORDS, *lx.SPELLING, *lx.CONTEXTS, *lx.ABBREVIATIONS]


def correct(df: DataFrame, text: str = "final_clean_text", id_col: str = "id_review", manual: DataFrame | None = None) -> DataFrame:
    """D3: df with text corrected, `text_pre_v7`, `cambios` and fresh lengths. manual: (id, text) replaces whole texts; a table of hand-made corrections. NULL text reads `nan`, as it always did."""
    was = F.coalesce(F.col(text), F.lit("nan"))
    rows = df.withColumn("text_pre_v7", F.col(text))
    fixed = apply_rules(F.lower(remove_emoji(was)), ALL_RULES)
    rows = rows.withColumn("__f", fixed)
    out = capitalize_sentences(clean_runs(F.col("__f.text")))
    changes = F.col("__f.changes")
    if manual is not None:
        one = manual.select(F.col(manual.columns[0]).alias("__id"), F.col(manual.columns[1]).alias("__manual")).dropDuplicates(["__id"])
        rows = rows.join(one, F.col(id_col) == F.col("__id"), "left")
        out = F.when(F.col("__manual").isNotNull(), clean_runs(F.col("__manual"))).otherwise(out)
        changes = F.when(F.col("__manual").isNotNull(), F.array(F.lit("Manual exacto"))).otherwise(changes)
    rows = rows.withColumn("cambios", changes).withColumn(text, trailing_dots(out))
    rows = rows.withColumn("clean_length_chars", F.length(text)).withColumn("clean_length_words", n_words(F.col(text)))
    return rows.drop("__f", "__id", "__manual")


def change_report(corrected: DataFrame, id_col: str = "id_review") -> DataFrame:
    """(id, cambios) of the rows that changed."""
    return corrected.filter(F.size("cambios") > 0).select(F.col(id_col).alias("id"), F.array_join("cambios", " | ").alias("cambios"))


def _cased(rules: Iterable[tuple[str, str]], upper: bool) -> Rules:
    return [v for p, to in rules for v in _variants(p, to, upper)]


def _variants(pattern: str, to: str, upper: bool) -> Rules:
    """G13 for patterns with white-space classes: the case of the match decides that of the replacement."""
    if r"\s" not in pattern:
        return case_variants(pattern, to, upper)
    cap = to[:1].upper() + to[1:]
    body = lambda f: "".join(f(c) if c.isalpha() else c for c in pattern.replace(r"\s+", "\x00")).replace("\x00", f"{WS}+")
    first = pattern[0].upper() + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern[1:].replace(r"\s+", "\x00")).replace("\x00", f"{WS}+")
    out = [(rf"(?U)\b{body(str.upper)}\b", to.upper())] if upper else []
    return [*out, (rf"(?U)\b{first}\b", cap), (rf"(?iuU)\b{body(str)}\b", to)]


def safe_corrections(x: Column) -> Column:
    """struct(text, n): case of the first letter kept; n counts what each rule replaces in the text as the rules before it left it. Texts no rule can touch skip the fold."""
    rules = [(rf"(?iuU)\b{p.replace(chr(92) + 's', WS)}\b", _cased([(p, to)], False)) for p, to in lx.SAFE]
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a[0]).alias("p1"), F.lit(a[1]).alias("r1"), F.lit(b[0]).alias("p2"), F.lit(b[1]).alias("r2")) for p, (a, b) in rules])
    whole = "(?iuU)" + "|".join(p.removeprefix("(?iuU)") for p, _ in rules)
    none = lambda t: F.struct(t.alias("text"), F.when(t.isNotNull(), F.lit(0)).alias("n"))

    def step(s: Column, r: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(s["text"], r["p1"], r["r1"]), r["p2"], r["r2"])
        return F.struct(text.alias("text"), (s["n"] + F.regexp_count(s["text"], r["p"])).alias("n"))

    return let(x, lambda t: F.when(t.rlike(whole), F.aggregate(steps, none(t), step)).otherwise(none(t)))


def letter_repair(x: Column, more: Rules | None = None) -> Column:
    """Fixed rules, then mined ones; spaces collapse only if something changed."""
    rules = [("(?iuU)" + p, to) for p, to in lx.LETTERS] + (more or [])
    return let(x, lambda t: let(fold_rules(t, rules), lambda n: F.when(n != t, strip(collapse(n))).otherwise(n)))


def encoding_words(x: Column, contextual: bool = False) -> Column:
    """D10."""
    return fold_rules(x, _cased(lx.ENCODING_WORDS_CONTEXTUAL if contextual else lx.ENCODING_WORDS, True))


def short_expansions(x: Column) -> Column:
    """Whatever the case of the match."""
    return fold_rules(x, [(rf"(?iuU)\b{p}\b", to) for p, to in lx.SHORT_EXPANSIONS])


def chat_expansions(x: Column) -> Column:
    """`x` stays after `muy`; short capitals start a capital only where a sentence starts."""
    rules: Rules = []
    for short, to in lx.CHAT_EXPANSIONS:
        guard = r"(?<!\b[mM][uU][yY]\s{1,8})" if short == "x" else ""
        cap = to[:1].upper() + to[1:]
        if len(short) <= 2:
            rules += [(rf"(?U)(?:(?<=\A)|(?<=[.!?]{WS}{{0,8}})){guard}\b{short.upper()}\b", cap), (rf"(?U){guard}\b{short.upper()}\b", to)]
        else:
            rules += [(rf"(?U){guard}\b{short.upper()}\b", to.upper())]
            rules += [(rf"(?U){guard}\b{short[0].upper()}{''.join(f'[{c}{c.upper()}]' for c in short[1:])}\b", cap)]
        if len(short) == 2:
            rules += [(rf"(?U){guard}\b{short[0].upper()}{short[1]}\b", cap)]
        rules += [(rf"(?iuU){guard}\b{short}\b", to)]
    return fold_rules(x, rules)


def compr_context(x: Column) -> Column:
    """The torn word `compr` by its neighbours."""
    alt = "|".join
    s = f"{WS}+"
    rules = []
    for word, to in (("COMPR", str.upper), ("Compr", str.capitalize), ("(?i:compr)", str)):
        rules.append((0, rf"(?U)\b((?iu:{alt(lx.COMPR_NOUN)})){s}{word}\b", f"$1 {to('compra')}"))
        rules.append((1, rf"(?U)\b((?iu:{alt(lx.COMPR_CLITICS)})){s}((?iu:{alt(lx.COMPR_OBJECTS)})){s}{word}\b", f"$1 $2 {to('compré')}"))
        rules.append((2, rf"(?U)\b((?iu:{alt(lx.COMPR_OBJECTS)})){s}{word}\b", f"$1 {to('compré')}"))
        rules.append((3, rf"(?U)\b{word}{s}((?iu:{alt(lx.COMPR_DETERMINERS)}))\b", f"{to('compré')} $1"))
        rules.append((4, rf"(?U)\b((?iu:yo)){s}{word}\b", f"$1 {to('compré')}"))
    return fold_rules(x, [(p, to) for _, p, to in sorted(rules, key=lambda r: r[0])])


def confusables(x: Column) -> Column:
    """D14, after D13."""
    return fold_rules(compr_context(x), _cased(lx.CONFUSABLES, True))


def clean_questions(x: Column) -> Column:
    """Question marks of texts that ask nothing become full stops. NULL and texts of dots only become ""."""
    ask = sorted({_bare(w) for w in lx.INTERROGATIVES})
    good = sorted({_bare(w) for w in lx.AFFIRMATIONS})

    def run(t: Column) -> Column:
        norm = match_form(t)
        words = F.array_distinct(tokens(norm))
        asks = F.arrays_overlap(words, F.array(*map(F.lit, ask))) | norm.rlike(rf"(?U)\bpor{WS}+que\b")
        short = (F.size(words) <= 3) | F.arrays_overlap(words, F.array(*map(F.lit, good)))
        out = F.when(~t.rlike("[?¿]") | asks, t).when(short, sub(t, "[?¿]", ".")).otherwise(sub(t, "[?¿]{3,}", "."))
        return let(strip(out), lambda s: F.when(s.rlike(rf"(?U)\A(?:\.|{WS})+\z"), F.lit("")).otherwise(s))

    return let(F.coalesce(x, F.lit("")), run)


def _bare(w: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")


def is_ambiguous(x: Column) -> Column:
    """Torn patterns, or a token of four letters or more without a vowel."""
    torn = any_of(x.rlike("(?iuU)" + p.replace(r"\s", WS)) for p in lx.AMBIGUOUS)
    toks = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))
    return torn | F.exists(toks, lambda w: (F.length(w) >= 4) & ~w.rlike("[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]") & ~F.lower(w).isin(*lx.ALLOWED_NO_VOWEL))


def resolve_ambiguous(df: DataFrame, other: DataFrame, text: str = "final_clean_text", id_col: str = "id_review", *, order: str) -> DataFrame:
    """Ambiguous texts take the text the other phase has for their id; of several the last by `order`, a column of that phase, counts. `replaced` tells where."""
    one = other.filter(F.coalesce(F.col(id_col) != "", F.lit(False)))
    one = one.groupBy(F.col(id_col).alias("__id")).agg(F.max_by(F.col(text), F.struct(order, text)).alias("__to"))
    rows = df.join(one, F.col(id_col) == F.col("__id"), "left")
    use = F.coalesce(is_ambiguous(F.col(text)) & (F.col("__to") != "") & (F.col("__to") != F.col(text)), F.lit(False))
    return rows.withColumn("replaced", use).withColumn(text, F.when(F.col("replaced"), F.col("__to")).otherwise(F.col(text))).drop("__id", "__to")
