"""Sarcasm: loose detection and cleaning, strict score, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiza.functions.text import has_keywords, is_blank, let, match_form, normalize_a, strip, sub, tokens
from tamiza.lexicons import sarcasm as lx
from tamiza.operators.windows import contrast_pattern

CONTRAST = contrast_pattern(lx.CONTRASTS)
CUE = contrast_pattern(lx.CUES) + "|/s"
STRICT_CUE = contrast_pattern(lx.STRICT_CUES)
TAG = r"(?iuU)(?<!\w)/s(?!\w)|\b(?:" + "|".join(lx.TAGS) + r")\b"
IRONY = "(?iu)" + "|".join(lx.IRONY)
QUOTED = "(?iu)[\"'“”](?:" + "|".join(lx.QUOTED) + ")[\"'“”]"
_EDGES = r" ,.;:\-"


def _good(norm: Column) -> Column:
    return has_keywords(tokens(norm), norm, lx.POSITIVE_LOOSE, lx.POSITIVE_PHRASES)


def _bad(norm: Column) -> Column:
    return has_keywords(tokens(norm), norm, lx.NEGATIVE, lx.NEGATIVE_PHRASES)


def loose_reason(text: Column) -> Column:
    """Reasons joined by "+", empty if the text isn't suspected."""

    def run(n: Column) -> Column:
        both = _good(n) & _bad(n) & n.rlike(CONTRAST)
        return F.array_join(F.array_compact(F.array(F.when(n.rlike(CUE), F.lit("cue")), F.when(both, F.lit("positivo_vs_negativo")))), "+")

    return let(match_form(F.coalesce(text, F.lit(""))), run)


def without_cues(text: Column) -> Column:
    """On the text as it is, so accented cues stay."""
    return sub(text, CUE, "")


def cleaned(text: Column) -> Column:
    """struct(text, outcome); of a contrast the side that means it stays."""

    def run(t: Column) -> Column:
        at = F.regexp_extract(t, "(?s)" + r"\A(.*?)" + CONTRAST.replace("(?:", "(", 1), 2)

        def split(word: Column) -> Column:
            before = F.regexp_extract(t, r"(?s)\A(.*?)" + CONTRAST, 1)
            after = t.substr(F.length(before) + F.length(word) + 1, F.length(t))
            return F.struct(strip(before, _EDGES).alias("b"), F.when(word == "", F.lit("")).otherwise(strip(after, _EDGES)).alias("a"))

        def choose(s: Column) -> Column:
            b, a = match_form(s["b"]), match_form(s["a"])
            keep_a = _bad(a) & (_good(b) | ~_bad(b))
            keep_b = _bad(b) & _good(a)
            text_ = F.when(s["a"] == "", t).when(keep_a, normalize_a(s["a"])).when(keep_b, normalize_a(s["b"])).otherwise(t)
            name = F.when(s["a"] == "", F.lit("cues_removed")).when(keep_a, F.lit("kept_after_contrast")).when(keep_b, F.lit("kept_before_contrast")).otherwise(F.lit("contrast_kept_full"))
            return F.struct(text_.alias("text"), name.alias("outcome"))

        return let(let(at, split), choose)

    return let(normalize_a(without_cues(text)), run)


def clean(df: DataFrame, text: str = "final_clean_text") -> DataFrame:
    """Suspected texts cleaned, the others normalised, blank ones left; `sarcasm_reason` and `sarcasm_outcome` tell."""
    t = F.col(text)
    rows = df.withColumn("sarcasm_reason", F.when(is_blank(t), F.lit("")).otherwise(loose_reason(t)))
    rows = rows.withColumn("__c", F.when(F.col("sarcasm_reason") != "", cleaned(t)))
    out = F.when(is_blank(t), t).when(F.col("sarcasm_reason") != "", F.col("__c.text")).otherwise(normalize_a(t))
    return rows.withColumn("sarcasm_outcome", F.col("__c.outcome")).withColumn(text, out).drop("__c")


def strict(text: Column) -> Column:
    """struct(score, reason)."""

    def run(n: Column) -> Column:
        t = tokens(n)
        hits = F.array_intersect(t, F.array(*map(F.lit, lx.NEGATIVE)))
        bad = F.size(F.array_except(hits, F.array(*map(F.lit, lx.TECHNICAL)))) > 0
        cue = n.rlike(STRICT_CUE) & bad
        parts = [
            (n.rlike(TAG), 4, "tag"),
            (n.rlike(IRONY), 4, "frase_sarcastica"),
            (cue, 2, "cue"),
            (cue & has_keywords(t, n, lx.POSITIVE_STRICT, lx.POSITIVE_PHRASES), 1, "positivo"),
            (cue & n.rlike(CONTRAST), 1, "contraste"),
            (cue & n.rlike(QUOTED), 1, "comillas_positivas"),
        ]
        score = sum((F.when(c, p).otherwise(0) for c, p, _ in parts), F.lit(0))
        return F.struct(score.alias("score"), F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in parts])), "+").alias("reason"))

    return let(match_form(F.coalesce(text, F.lit(""))), run)


def candidates(df: DataFrame, text: str = "final_clean_text", id_col: str = "id_review", least: int = lx.REPORT_FROM) -> DataFrame:
    """K9: (score, id, rating_num, rating, reason, text) from `least` on, best first."""
    rows = df.filter(~is_blank(F.col(text))).withColumn("__s", strict(F.col(text))).filter(F.col("__s.score") >= least)
    cols = [F.col("__s.score").alias("score"), F.col(id_col).alias("id_review"), "rating_num", "rating", F.col("__s.reason").alias("reason"), F.col(text).alias("text")]
    out = rows.select(*cols)
    return out.orderBy(*[F.col(c).desc() for c in out.columns])


def is_true(x: Column) -> Column:
    """P11."""
    return F.coalesce(F.lower(strip(x)).isin("true", "1", "si", "yes"), F.lit(False))


def _full(c: str) -> Column:
    return ~is_blank(F.col(c))


def audit(df: DataFrame) -> DataFrame:
    """One row of counts, P16 equalities included."""
    same = lambda a, b: F.count_if(_full(a) & _full(b) & (F.col(a) == F.col(b)))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(is_true(F.col("possible_sarcasm"))).alias("possible_true"),
        same("final_clean_text", "text_after_sarcasm").alias("final_equals_after"),
        same("final_clean_text", "clean_text_updated_after_sarcasm").alias("final_equals_updated"),
        same("final_clean_text", "clean_text_original_pre_sarcasm").alias("final_equals_original"),
        same("text_after_sarcasm", "clean_text_updated_after_sarcasm").alias("after_equals_updated"),
    )


def audit_values(df: DataFrame) -> DataFrame:
    """Counts of the non-empty values of action, status and final action."""
    cols = ["sarcasm_action", "sarcasm_review_status", "sarcasm_action_final"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), strip(F.col(c)).alias("value")) for c in cols])).alias("v")).select("v.*")
    return long.filter(F.coalesce(F.col("value") != "", F.lit(False))).groupBy("column", "value").agg(F.count("*").alias("n"))


def non_empty_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n)."""
    columns = columns or lx.COLUMNS
    one = df.agg(*[F.count_if(_full(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("v")).select("v.*")


def consistency(df: DataFrame) -> DataFrame:
    """Mismatches between the flag and what it should entail."""
    flag = is_true(F.col("possible_sarcasm"))
    status, action = (F.coalesce(strip(F.col(c)), F.lit("")) for c in ("sarcasm_review_status", "sarcasm_action"))
    return df.agg(
        F.count_if(flag & (status != "requiere revisión manual")).alias("true_status"),
        F.count_if(flag & (action != "revisar")).alias("true_action"),
        F.count_if(~flag & (status != "") & (status != "sin revisión")).alias("false_status"),
        F.count_if(~flag & (action != "") & (action != "conservar")).alias("false_action"),
    )


def to_transform(df: DataFrame) -> DataFrame:
    """Flagged rows whose final action is to transform."""
    return df.filter((F.lower("possible_sarcasm") == "true") & (F.lower("sarcasm_action_final") == "transformar"))
