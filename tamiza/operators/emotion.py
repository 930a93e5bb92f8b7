"""Emotion correction by token-window rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiza.functions.text import WS, let, match_form, rating_value, strip, tokens
from tamiza.lexicons import emotion as lx
from tamiza.operators.windows import any_of, contrast_pattern, follows, negated, negation_after, negations, plain_count, reported, where

CONTRAST = contrast_pattern(lx.CONTRASTS)


def label(model_label: Column) -> Column:
    """X11: model label to emotion; unknown ones are Neutral."""
    pairs = [F.lit(x) for kv in lx.LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), model_label), F.lit("Neutral"))


def focus(norm: Column) -> Column:
    """The clause that carries the judgement."""

    def pick(p: Column) -> Column:
        before, tail = strip(F.get(p, F.lit(0))), strip(F.element_at(p, -1))
        one = F.when(F.length(tail) >= F.length(before), tail).otherwise(before)
        many = F.when(tail != "", tail).when(before != "", before).otherwise(norm)
        return F.when(F.size(p) == 1, norm).when(F.size(p) == 2, one).otherwise(many)

    return let(F.split(norm, CONTRAST), pick)


def strong_negative(t: Column, neg: Column) -> Column:
    """X6."""
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    said = any_of(joined.contains(f" {p} ") for p in lx.STRONG_NEGATIVE if "no" in p.split())
    others = [p for p in lx.STRONG_NEGATIVE if "no" not in p.split()]
    starts = sorted({p.split()[0] for p in others})
    quiet = F.exists(where(t, lambda x: x.isin(*starts)), lambda i: any_of(follows(t, i, p) for p in others) & ~negated(i, neg))
    seconds = [p.split()[1] for p in lx.NEGATABLE]
    reflexive = F.exists(where(t, lambda x: x == "se"), lambda i: F.coalesce(F.get(t, i + 1).isin(*seconds), F.lit(False)) & ~negated(i, neg) & ~negation_after(i, neg))
    return said | quiet | reflexive


def catastrophe(t: Column, neg: Column, after: bool = True) -> Column:
    """X7; after=False is the intensity rules' version, in which a later negation changes nothing."""
    rep = where(t, lambda x: x.isin(*lx.REPORTING))
    stem = lambda x: any_of(x.startswith(s) for s in lx.CATASTROPHE_STEMS)
    word = F.exists(where(t, lambda x: x.isin(*lx.CATASTROPHES)), lambda i: ~negated(i, neg) & ~reported(i, rep))
    calm = lambda i: ~negated(i, neg) & ~reported(i, rep) & (~negation_after(i, neg) if after else F.lit(True))
    return word | F.exists(where(t, stem), calm)


def negative_signals(t: Column, neg: Column) -> Column:
    """Struct of negatives and of positives that come from negated negatives. Each adjective near hardware counts once, taken from left to right."""
    key = where(t, lambda x: x.isin(*lx.NEGATIVE))
    adj = F.filter(where(t, lambda x: x.isin(*lx.NEGATIVE_ADJECTIVES)), lambda j: ~negated(j, neg))

    def step(counted: Column, i: Column) -> Column:
        free = F.filter(adj, lambda j: (j - i).between(-3, 3) & ~F.array_contains(counted, j))
        return F.when(F.size(free) > 0, F.concat(counted, F.slice(free, 1, 1))).otherwise(counted)

    more = F.size(F.aggregate(where(t, lambda x: x.isin(*lx.HARDWARE)), key, step)) - F.size(key)
    turned = F.size(F.filter(key, lambda i: negated(i, neg)))
    return F.struct((F.size(key) - turned + more).alias("negative"), turned.alias("turned"))


def corrected_emotion(text: Column, base: Column, rating: Column) -> Column:
    """The first rule that fits, by rating band and base emotion. NULL text gives ""."""

    def of_norm(norm: Column) -> Column:
        def of_tokens(t: Column) -> Column:
            def of_neg(neg: Column) -> Column:
                signals = F.struct(
                    negative_signals(t, neg).alias("s"),
                    plain_count(t, neg, lx.POSITIVE).alias("p"),
                    strong_negative(t, neg).alias("strong"),
                    catastrophe(t, neg).alias("cat"),
                    F.arrays_overlap(t, F.array(*map(F.lit, lx.SADNESS))).alias("sad"),
                    F.arrays_overlap(t, F.array(*map(F.lit, lx.POSITIVE))).alias("word"),
                    norm.rlike(CONTRAST).alias("contrast"),
                )
                return let(signals, lambda s: decide(norm, s))

            return let(negations(t), of_neg)

        return let(tokens(focus(norm)), of_tokens)

    def decide(norm: Column, s: Column) -> Column:
        n, p = s["s"]["negative"], s["p"] + s["s"]["turned"]
        strong, cat, con = s["strong"], s["cat"], s["contrast"]
        high = F.when(cat, "Enojo").when(strong, "Neutral").when((n >= 2) | ((n >= 1) & con), "Neutral").when(p > 0, "Alegría").otherwise(base)
        low = F.when(cat, "Enojo").when(strong | (n > 0), F.when(s["sad"], "Tristeza").otherwise("Enojo")).when(base.isin("Enojo", "Tristeza"), base).otherwise("Neutral")
        mid = F.when(p > n, "Alegría").when(strong | (n > p), "Neutral").when(base.isin("Sorpresa", "Miedo"), base).otherwise("Neutral")
        ask = norm.rlike("(?U)" + lx.POSITIVE_QUESTION.format(ws=WS))
        cue = norm.rlike("(?U)" + lx.SURPRISE.format(ws=WS))
        free = (
            F.when((base == "Neutral") & (cat | (strong & (n > 0))), "Enojo")
            .when((base == "Neutral") & (p > 0), "Alegría")
            .when(base.isin("Tristeza", "Miedo") & (n > 0), "Enojo")
            .when(base.isin("Tristeza", "Miedo") & (p > 0) & con, "Alegría")
            .when((base == "Alegría") & strong, "Enojo")
            .when((base == "Alegría") & (n > p), "Neutral")
            .when((base == "Sorpresa") & (ask | (~cue & s["word"])), "Alegría")
            .when((base == "Asco") & strong, "Enojo")
            .otherwise(base)
        )
        r = rating_value(rating)
        return F.when(r.isin(4, 5), high).when(r.isin(1, 2), low).when(r == 3, mid).otherwise(free)

    norm = match_form(text)
    empty = F.coalesce(norm == "", F.lit(True)) | strip(norm).isin("nan", "none", "null")
    return F.when(empty, F.lit("")).otherwise(let(norm, of_norm))


def with_emotion(df: DataFrame, text: str = "final_clean_text", base: str = "base_emotion", rating: str = "rating_num", name: str = "emotion") -> DataFrame:
    return df.withColumn(name, corrected_emotion(F.col(text), F.col(base), F.col(rating)))
