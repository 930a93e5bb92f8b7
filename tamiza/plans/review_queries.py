"""Queries of the cleaning, labelling and repair operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.functions import text as tx
from tamiza.operators import analytics as an
from tamiza.operators import corrector, emotion, encoding, external, fuzzy, intensity, repair, sarcasm
from tamiza.plans import pipeline
from tamiza.plans.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _complete(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "complete")


def _emotion(s: SparkSession, d: str) -> DataFrame:
    return emotion.with_emotion(spread(_complete(s, d).select("id_review", "final_clean_text", "rating_num", "rating", "base_emotion")))


def emotion_correction(s: SparkSession, d: str) -> DataFrame:
    return _emotion(s, d).select("id_review", "rating_num", "base_emotion", "emotion")


def intensity_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _emotion(s, d)
    k = intensity.intensity(F.col("final_clean_text"), F.col("rating_num"), F.col("emotion"), F.col("rating"))
    return rows.select("id_review", "rating_num", "rating", "emotion", k.alias("k")).select("id_review", "rating_num", "rating", "emotion", "k.intensity", "k.override", "k.saturated", "k.score")


def intensity_distribution(s: SparkSession, d: str) -> DataFrame:
    return an.share(intensity.with_intensity(_emotion(s, d)), "intensity")


def incongruence_flags(s: SparkSession, d: str) -> DataFrame:
    return intensity.with_intensity(_emotion(s, d)).select("id_review", "rating_num", "rating", "intensity", "flag_incongruencia", "incongruencia_motivo")


def _scalar(tbl: str, column: str, f) -> Query:
    return lambda s, d: spread(table(s, d, tbl).select("id_review", column)).select("id_review", f(F.col(column)).alias("out"))


def correct_corpus(s: SparkSession, d: str) -> DataFrame:
    rows = corrector.correct(spread(table(s, d, "corrected").select("id_review", "final_clean_text")))
    return rows.select("id_review", "final_clean_text", F.array_join("cambios", " | ").alias("cambios"), "clean_length_chars", "clean_length_words")


def correction_report(s: SparkSession, d: str) -> DataFrame:
    return corrector.change_report(corrector.correct(spread(table(s, d, "corrected").select("id_review", "final_clean_text"))))


def ambiguous_resolution(s: SparkSession, d: str) -> DataFrame:
    phase2 = table(s, d, "corrected").groupBy("id_review").agg(F.max("text_pre_v7").alias("final_clean_text"))
    return corrector.resolve_ambiguous(table(s, d, "complete").select("id_review", "final_clean_text"), phase2, order="final_clean_text")


def sarcasm_score(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "corrected").select("id_review", "final_clean_text")).select("id_review", sarcasm.strict(F.col("final_clean_text")).alias("k")).select("id_review", "k.score", "k.reason")


def sarcasm_clean(s: SparkSession, d: str) -> DataFrame:
    return sarcasm.clean(spread(table(s, d, "corrected").select("id_review", "final_clean_text")))


def sarcasm_candidates_ranked(s: SparkSession, d: str) -> DataFrame:
    return sarcasm.candidates(table(s, d, "corrected"))


_VOCAB = ["final_clean_text", "clean_text", "text_after_sarcasm"]


def missing_letter_pairs(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "corrected")
    return repair.missing_letter_pairs(df, "final_clean_text", repair.vocabulary(df, _VOCAB))


def mined_repair(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "corrected")
    return repair.clean_split_words(df.select("id_review", "final_clean_text"), "final_clean_text", repair.mined_split_rules(df, _VOCAB))


def letter_repair_mined(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "corrected")
    return repair.apply_letter_rules(df.select("id_review", "final_clean_text"), "final_clean_text", repair.mined_letter_rules(df, _VOCAB))


def annotated_reviews(s: SparkSession, d: str) -> DataFrame:
    """The flagship path over whole reviews: corrector, emotion, intensity, incongruence."""
    return pipeline.annotate(spread(_complete(s, d).select("id_review", "final_clean_text", "rating", "rating_num", "base_emotion"))).select("id_review", "final_clean_text", "emotion", "intensity", "flag_incongruencia", "incongruencia_motivo")


def contextual_clean(s: SparkSession, d: str) -> DataFrame:
    df = spread(table(s, d, "raw_reviews").select("id_review", "raw_text"))
    return pipeline.contextual_clean(df, pipeline.corpus_lexicon(table(s, d, "complete"), ["final_clean_text"])).select("id_review", "final_clean_text")


def deep_audit(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "corrected").select("id_review", "text_after_sarcasm", "final_clean_text", "clean_text", "raw_text")
    return pipeline.deep_audit(df, pipeline.known_words(table(s, d, "complete"), ["final_clean_text"])).select("id_review", "final_clean_text")


def edit1_by_ratio(s: SparkSession, d: str) -> DataFrame:
    """Every word of the corpus, without accents, with the words one edit away that are ten times as frequent or more; a bound in counts would lose words as the corpus grows."""
    n = repair.word_counts(table(s, d, "corrected").select(tx.match_form(F.col("final_clean_text")).alias("t")), ["t"], tx.ASCII_WORD)
    return fuzzy.near_frequent(n, 10)


def _struct(tbl: str, column: str, f, *fields: str) -> Query:
    return lambda s, d: spread(table(s, d, tbl).select("id_review", column)).select("id_review", f(F.col(column)).alias("k")).select("id_review", *[f"k.{x}" for x in fields])


QUERIES: dict[str, Query] = {
    "emotion_correction": emotion_correction,
    "intensity_rows": intensity_rows,
    "intensity_distribution": intensity_distribution,
    "incongruence_flags": incongruence_flags,
    "normalize_a": _scalar("raw_reviews", "raw_text", tx.normalize_a),
    "normalize_b": _scalar("raw_reviews", "raw_text", tx.normalize_b),
    "normalize_controls": _scalar("raw_reviews", "raw_text", tx.normalize_controls),
    "sanitize_text": _scalar("raw_reviews", "raw_text", tx.sanitize),
    "clean_runs": _scalar("raw_reviews", "raw_text", tx.clean_runs),
    "strip_trailing_period": _scalar("raw_reviews", "raw_text", tx.strip_only_period),
    "accent_strip": _scalar("corrected", "final_clean_text", tx.match_form),
    "accent_strip_raw": _scalar("raw_reviews", "raw_text", tx.match_form),
    "remove_emoji": _scalar("raw_reviews", "raw_text", tx.remove_emoji),
    "capitalize_sentences": _scalar("raw_reviews", "raw_text", tx.capitalize_sentences),
    "alnum_signature": _scalar("raw_reviews", "raw_text", tx.alnum_signature),
    "length_metrics": lambda s, d: table(s, d, "raw_reviews").select("id_review", F.length("raw_text").alias("n_chars"), tx.n_words(F.col("raw_text")).alias("n_words")),
    "rating_value": lambda s, d: table(s, d, "complete").select("id_review", "rating", "rating_num", tx.rating_value(F.col("rating_num"), F.col("rating")).alias("value")),
    "first_text": lambda s, d: table(s, d, "corrected").select("id_review", tx.first_non_blank(*[F.col(c) for c in ("text_after_sarcasm", "final_clean_text", "clean_text", "raw_text")]).alias("out")),
    "clip_for_model": _scalar("raw_reviews", "raw_text", tx.clip_for_model),
    "correct_corpus": correct_corpus,
    "correction_report": correction_report,
    "safe_corrections": _struct("corrected", "final_clean_text", corrector.safe_corrections, "text", "n"),
    "letter_repair": _scalar("corrected", "final_clean_text", corrector.letter_repair),
    "letter_repair_mined": letter_repair_mined,
    "encoding_words": _scalar("corrected", "final_clean_text", corrector.encoding_words),
    "short_expansions": _scalar("corrected", "final_clean_text", corrector.short_expansions),
    "chat_expansions": _scalar("corrected", "final_clean_text", corrector.chat_expansions),
    "confusables": _scalar("corrected", "final_clean_text", corrector.confusables),
    "question_mark_clean": _scalar("raw_reviews", "raw_text", corrector.clean_questions),
    "ambiguous_flags": _scalar("complete", "final_clean_text", corrector.is_ambiguous),
    "ambiguous_resolution": ambiguous_resolution,
    "sarcasm_score": sarcasm_score,
    "sarcasm_clean": sarcasm_clean,
    "sarcasm_candidates_ranked": sarcasm_candidates_ranked,
    "sarcasm_audit": lambda s, d: sarcasm.audit(table(s, d, "corrected")),
    "sarcasm_audit_values": lambda s, d: sarcasm.audit_values(table(s, d, "corrected")),
    "sarcasm_consistency": lambda s, d: sarcasm.consistency(table(s, d, "corrected")),
    "sarcasm_to_transform": lambda s, d: sarcasm.to_transform(table(s, d, "corrected")).select("id_review", "sarcasm_action_final"),
    "non_empty_counts": lambda s, d: sarcasm.non_empty_counts(table(s, d, "corrected")),
    "mojibake_score": _scalar("raw_reviews", "raw_text", encoding.score),
    "mojibake_map": _scalar("raw_reviews", "raw_text", encoding.sequences),
    "mojibake_fix": _scalar("raw_reviews", "raw_text", encoding.sanitize_gated),
    "mojibake_fix_all_pages": _scalar("raw_reviews", "raw_text", encoding.sanitize_all),
    "mojibake_changed_cells": lambda s, d: encoding.changed_cells(table(s, d, "raw_reviews"), encoding.sanitize_gated),
    "word_counts": lambda s, d: repair.word_counts(table(s, d, "corrected"), _VOCAB),
    "vocabulary": lambda s, d: repair.vocabulary(table(s, d, "corrected"), _VOCAB),
    "bigram_counts": lambda s, d: repair.pair_counts(table(s, d, "corrected"), _VOCAB),
    "regex_pair_counts": lambda s, d: repair.regex_pair_counts(table(s, d, "corrected"), "final_clean_text"),
    "top_pairs": lambda s, d: repair.top_counts(repair.regex_pair_counts(table(s, d, "corrected"), "final_clean_text"), 20, "pair"),
    "no_vowel_tokens": lambda s, d: repair.no_vowel_tokens(table(s, d, "corrected"), "final_clean_text"),
    "no_vowel_tokens_detailed": lambda s, d: repair.no_vowel_tokens(table(s, d, "corrected"), "final_clean_text", True),
    "suspicious_characters": lambda s, d: repair.suspicious_characters(table(s, d, "raw_reviews"), "raw_text"),
    "mined_letter_rules": lambda s, d: repair.mined_letter_rules(table(s, d, "corrected"), _VOCAB),
    "mined_split_rules": lambda s, d: repair.mined_split_rules(table(s, d, "corrected"), _VOCAB),
    "mined_repair": mined_repair,
    "missing_letter_pairs": missing_letter_pairs,
    "annotated_reviews": annotated_reviews,
    "run_summary": lambda s, d: pipeline.run_summary(_complete(s, d)),
    "contextual_counts": lambda s, d: pipeline.contextual_counts(table(s, d, "raw_reviews")),
    "contextual_clean": contextual_clean,
    "deep_audit": deep_audit,
    "edit1_by_ratio": edit1_by_ratio,
    "revision_report": lambda s, d: pipeline.revision_report(table(s, d, "corrected")),
    "sanitize_table": lambda s, d: pipeline.sanitize_table(table(s, d, "raw_reviews").drop("captured_at", "loaded_at")),
    "llm_batches": lambda s, d: external.batches(table(s, d, "raw_reviews").groupBy("id_review").agg(F.max("raw_text").alias("raw_text")), "raw_text").select("bucket", "batch", "lote"),
    "change_log": lambda s, d: table(s, d, "corrected").filter(~F.col("final_clean_text").eqNullSafe(F.col("final_clean_text_original"))).select(F.col("id_review").alias("ID"), F.col("final_clean_text_original").alias("ANTES"), F.col("final_clean_text").alias("DESPUES")),
}
