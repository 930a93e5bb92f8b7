"""Intensity 1 to 4 and incongruence with the rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiza.functions.text import has_phrase, is_blank, let, match_form, rating_value, strip, tokens
from tamiza.lexicons import emotion as lx
from tamiza.operators.emotion import CONTRAST, catastrophe
from tamiza.operators.windows import any_first_plain, any_of, negated, negations, plain_count, where


def override(t: Column, neg: Column) -> Column:
    """What makes a text extreme by itself."""
    phrases = any_first_plain(t, neg, [*lx.LEGAL, *lx.FINANCIAL, *lx.LOYALTY])
    curse = where(t, lambda x: x.isin(*lx.PROFANITY) | any_of(x.startswith(s) for s in lx.PROFANITY_STEMS))
    return catastrophe(t, neg, after=False) | phrases | F.exists(curse, lambda i: ~negated(i, neg))


def score(text: Column, norm: Column, t: Column, neg: Column) -> Column:
    """Struct of score and saturation."""
    bit = lambda c: c.cast("int")
    strong = plain_count(t, neg, lx.INTENSIFIERS)

    def total(k: Column) -> Column:
        points = (
            strong
            + plain_count(t, neg, lx.ABSOLUTES)
            + plain_count(t, neg, lx.DETERMINERS)
            + bit(k["upper"])
            + bit(k["multi"])
            + bit(k["long"])
            - bit(has_phrase(norm, lx.MITIGATORS))
            - bit(has_phrase(norm, lx.DOUBTS))
            - bit(norm.rlike(CONTRAST) & (plain_count(t, neg, lx.INTENSITY_POSITIVE) > 0))
        )
        full = (strong >= 2) & ((k["upper"] & k["multi"]) | k["long"])
        return F.struct(points.alias("score"), full.alias("saturated"))

    marks = F.struct(text.rlike(r"(?U)\b[A-Z]{3,}\b").alias("upper"), text.rlike(r"!!|\?\?").alias("multi"), text.rlike(r"([^\n])\1{2,}").alias("long"))
    return let(marks, total)


def intensity(text: Column, rating: Column, emotion: Column, rating_text: Column | None = None) -> Column:
    """struct(intensity, override, saturated, score); a blank text is 2 and nothing else counts."""
    blank = F.struct(F.lit(2).alias("intensity"), F.lit(False).alias("override"), F.lit(False).alias("saturated"), F.lit(0).alias("score"))

    def of_norm(norm: Column) -> Column:
        def of_tokens(t: Column) -> Column:
            return let(negations(t), lambda neg: let(F.struct(override(t, neg).alias("o"), score(text, norm, t, neg).alias("s")), levels))

        return let(tokens(norm), of_tokens)

    def levels(k: Column) -> Column:
        o, s = k["o"], k["s"]["score"]
        r, e = rating_value(rating, rating_text), F.coalesce(strip(emotion), F.lit(""))
        first = F.when(o | k["s"]["saturated"] | (s >= lx.SATURATION), 4).when(s < 0, 1).when(s == 0, 2).otherwise(3)
        by_rating = [
            lambda x: F.when((r == 3) & (x == 4) & ~o, F.when(s > 0, 3).otherwise(2)).otherwise(x),
            lambda x: F.when(r.isin(4, 5) & (x == 1), 2).otherwise(x),
            lambda x: F.when((r == 1) & (x == 3) & (s < 2), 2).otherwise(x),
            lambda x: F.when((e == "Enojo") & (x < 3) & (s > 0), 3).otherwise(x),
            lambda x: F.when((e == "Asco") & (x < 3), 3).otherwise(x),
            lambda x: F.when((e == "Sorpresa") & (x == 2) & (s > 0), 3).otherwise(x),
        ]
        level = first
        for f in by_rating:
            level = let(level, f)
        return F.struct(level.alias("intensity"), o.alias("override"), k["s"]["saturated"].alias("saturated"), s.alias("score"))

    return F.when(is_blank(text), blank).otherwise(let(match_form(text), of_norm))


def incongruences(emotion: Column, level: Column, rating: Column, norm: Column, points: Column) -> Column:
    """Reasons joined by "; ", empty if there are none."""
    e, r = strip(emotion), rating
    yes = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array(
        yes((e == "Alegría") & (r <= 2), "alegria_rating_bajo"),
        F.when(e.isin("Enojo", "Tristeza", "Asco", "Miedo") & (r == 5), F.concat(F.lower(e), F.lit("_rating_alto"))),
        yes((e == "Neutral") & (r == 1) & has_phrase(norm, lx.INTENSITY_POSITIVE), "neutral_positivo_rating_bajo"),
        yes((e == "Neutral") & (r == 5) & has_phrase(norm, lx.NEUTRAL_COMPLAINTS), "neutral_negativo_rating_alto"),
        yes((level == 1) & (r == 5), "intensidad_baja_rating_alto"),
        yes((level == 4) & (r <= 2), "intensidad_alta_rating_bajo"),
        yes((e == "Enojo") & level.isin(1, 2) & ~has_phrase(norm, lx.MITIGATORS) & ~has_phrase(norm, lx.DOUBTS), "enojo_intensidad_baja"),
        yes((e == "Alegría") & (level == 4) & ~has_phrase(norm, lx.LOYALTY) & (points < lx.SATURATION), "alegria_intensidad_extrema"),
    )
    return F.when(is_blank(emotion), F.lit("")).otherwise(F.array_join(F.array_compact(reasons), "; "))


def with_intensity(df: DataFrame, text: str = "final_clean_text", rating: str = "rating_num", rating_text: str | None = "rating", emotion: str = "emotion") -> DataFrame:
    """Adds intensity, flag_incongruencia and incongruencia_motivo."""
    shown = F.col(rating_text) if rating_text else None
    rows = df.withColumn("__k", intensity(F.col(text), F.col(rating), F.col(emotion), shown))
    norm = match_form(F.coalesce(F.col(text), F.lit("")))
    why = incongruences(F.col(emotion), F.col("__k.intensity"), rating_value(F.col(rating), shown), norm, F.col("__k.score"))
    rows = rows.withColumn("intensity", F.col("__k.intensity")).withColumn("incongruencia_motivo", why).withColumn("flag_incongruencia", F.col("incongruencia_motivo") != "")
    return rows.drop("__k")
