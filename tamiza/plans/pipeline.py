"""The stages in their order, each a pure function of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiza.functions.lineage import written
from tamiza.functions.text import SPANISH_LOWER_WORD, first_non_blank, is_blank, normalize_a, normalize_b
from tamiza.lexicons import rules as lx
from tamiza.operators import corrector, emotion, encoding, fuzzy, intensity, repair


def annotate(df: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Corrector, emotion, intensity, incongruence: row-local, no shuffle but for a table of manual texts."""
    rows = corrector.correct(df, manual=manual)
    return intensity.with_intensity(emotion.with_emotion(rows))


def run_summary(annotated: DataFrame) -> DataFrame:
    """One row of counts of an annotated table."""
    n = F.greatest(F.count("*"), F.lit(1))
    flagged = F.count_if(F.coalesce("flag_incongruencia", F.lit(False)))
    levels = [F.count_if(F.col("intensity") == k).alias(f"n_level_{k}") for k in (1, 2, 3, 4)]
    return annotated.agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("final_clean_text"))).alias("n_blank"), *levels, flagged.alias("n_flagged"), F.round(flagged * 100.0 / n, 2).alias("flagged_pct"))


def mined_repair(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Statistics over the corpus, then the rewrite."""
    return repair.clean_split_words(df, target, repair.mined_split_rules(df, columns))


#: A word of a corpus counts as known from so many occurrences per million tokens.
KNOWN_PER_MILLION = 20.0


def _shares(df: DataFrame, columns: list[str], per_million: float) -> DataFrame:
    """(word, n, share) of the words with `per_million` occurrences per million tokens or more."""
    n = repair.word_counts(df, columns, SPANISH_LOWER_WORD)
    whole = float(n.agg(F.sum("n")).collect()[0][0] or 1)  # one number
    return n.filter(F.col("n") * 1e6 >= per_million * whole).select(F.col("token").alias("word"), "n", (F.col("n") / whole).alias("share"))


def known_words(df: DataFrame, columns: list[str], per_million: float = KNOWN_PER_MILLION) -> DataFrame:
    """(word, n): words with at least `per_million` occurrences per million tokens, a share of the corpus and so the same words at every size.

    Below 1e6 / per_million tokens (50 000 by default) one occurrence reaches the bound: so small a corpus can't tell a
    rare word from a misspelling, and all its words are known.
    """
    return _shares(df, columns, per_million).select("word", "n")


def corpus_lexicon(df: DataFrame, columns: list[str], per_million: float = KNOWN_PER_MILLION) -> DataFrame:
    """(word, zipf): log10 of occurrences per billion words of the corpus itself, of its known_words; stands in where no lexicon is given."""
    return _shares(df, columns, per_million).select("word", F.log10(F.col("share") * 1e9).alias("zipf"))


def _contextual_form(x):
    """The four rewrites that come before any statistics."""
    return corrector.confusables(corrector.chat_expansions(corrector.encoding_words(normalize_b(x), contextual=True)))


def contextual_counts(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """(token, n) of the rewritten raw texts."""
    rows = df.filter(~is_blank(F.col(text))).select(_contextual_form(F.col(text)).alias("t"))
    return repair.word_counts(rows, ["t"], SPANISH_LOWER_WORD)


def contextual_clean(df: DataFrame, lexicon: DataFrame, text: str = "raw_text", to: str = "final_clean_text") -> DataFrame:
    """D10, D12, D15, D14, D16 to D18 in their order, from the raw text; blank texts leave the target as it is."""
    lexicon = written(lexicon)  # read at every step; it may be counted from a corpus
    rows = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__t", F.when(~is_blank(F.col(text)), corrector.chat_expansions(corrector.encoding_words(normalize_b(F.col(text)), contextual=True))))
    rows = fuzzy.merge_split_words(rows, "__t", lexicon)
    rows = written(rows.withColumn("__t", corrector.confusables(F.col("__t"))))  # its words decide how it is rewritten
    dictionary = written(fuzzy.frequency_dictionary(contextual_counts(df, text), lexicon))  # the corpus is counted once
    words = repair.word_counts(rows, ["__t"], SPANISH_LOWER_WORD).select("token")
    fixed = fuzzy.replace_tokens(rows, "__t", fuzzy.token_corrections(words, dictionary, lexicon), ["__row"])
    out = F.when(F.col("__t").isNotNull(), normalize_b(F.col("__t"))).otherwise(F.col(to) if to in df.columns else F.lit(None).cast("string"))
    return fixed.withColumn(to, out).drop("__row", "__t")


def deep_audit(df: DataFrame, dictionary: DataFrame, to: str = "final_clean_text", sources: tuple[str, ...] = ("text_after_sarcasm", "final_clean_text", "clean_text", "raw_text")) -> DataFrame:
    """P2, D10, D11, D19, G1 from the first text that is not blank. dictionary: (word, n); protected terms are known words."""
    rows = df if "final_clean_text_original" in df.columns else df.withColumn("final_clean_text_original", F.col(to))
    base = first_non_blank(*[F.col(c) for c in sources])
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__t", F.when(base != "", corrector.short_expansions(corrector.encoding_words(base)))))
    known = dictionary.unionByName(df.sparkSession.createDataFrame([(t, 1) for t in lx.PROTECTED_TERMS], "word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    tokens = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("__t", F.lit("")), F.lit(SPANISH_LOWER_WORD), F.lit(0)))).alias("token")).distinct()
    fixed = fuzzy.replace_tokens(rows, "__t", fuzzy.spellcheck_corrections(tokens, known), ["__row"])
    return fixed.withColumn(to, F.coalesce(normalize_a(F.col("__t")), F.col(to))).drop("__row", "__t")


def sanitize_table(df: DataFrame, strict: bool = False, all_pages: bool = False) -> DataFrame:
    """Every string column."""
    f = encoding.sanitize_all if all_pages else encoding.sanitize_gated
    return encoding.every_string(df, lambda c: f(c, strict))


def revision_report(df: DataFrame, text: str = "final_clean_text", columns: tuple[str, ...] = ("final_clean_text", "clean_text", "text_after_sarcasm"), id_col: str = "id_review") -> DataFrame:
    """(id, kind, k, finding): of each row the first five torn pairs and the first five tokens without vowels, in the order of the text."""
    key = F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"))  # a row's own, as ids may repeat
    numbered = df.select(key.alias("key"), text)  # before the pairs are dealt out, so that all of a row have its number
    torn = repair.missing_letters_at(numbered, text, repair.vocabulary(df, list(columns)), F.col("key"))
    torn = torn.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(" ", "t1", "t2", F.lit("→"), "candidate").alias("p")))), 1, 5)["p"].alias("f"))
    torn = torn.select("id.id", "f")
    own = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.rlike("[aeiouáéíóúüñAEIOUÁÉÍÓÚÜ]") & ~F.lower(w).isin(*lx.DOMAIN_TERMS))
    bare = df.select(F.col(id_col).alias("id"), F.slice(own, 1, 5).alias("f")).filter(F.size("f") > 0)
    both = torn.select("id", F.lit("torn_pair").alias("kind"), "f").unionByName(bare.select("id", F.lit("no_vowel").alias("kind"), "f"))
    return both.select("id", "kind", F.posexplode("f").alias("k", "finding"))


def counters(before: DataFrame, after: str, text: str, hit: str | None = None) -> DataFrame:
    """One row of a stage's counters: rows with text are processed, the others skipped; `after` is the column with the new text, `hit` a flag column whose true rows are counted as detected."""
    full = ~is_blank(F.col(text))
    changed = full & ~F.col(text).eqNullSafe(F.col(after))
    detected = [F.count_if(full & F.coalesce(F.col(hit), F.lit(False))).alias("detected")] if hit else []
    return before.agg(F.count("*").alias("rows"), F.count_if(full).alias("processed"), F.count_if(~full).alias("skipped"), F.count_if(changed).alias("changed"), *detected)
