"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiza.plans import fixture_queries, problem_queries, report_queries, review_oracles, review_queries, rule_oracles, rules_view

#: Queries of the rules, which run over the rules view as well.
RULES = (
    "correct_corpus correction_report safe_corrections letter_repair letter_repair_mined encoding_words short_expansions chat_expansions confusables question_mark_clean ambiguous_flags ambiguous_resolution "
    "sarcasm_score sarcasm_clean sarcasm_candidates_ranked mojibake_map mojibake_fix mojibake_fix_all_pages no_vowel_tokens no_vowel_tokens_detailed regex_pair_counts mined_letter_rules mined_split_rules mined_repair "
    "missing_letter_pairs revision_report contextual_counts annotated_reviews deep_audit capitalize_sentences clean_runs incongruence_flags"
).split()

QUERIES = {**review_queries.QUERIES, **report_queries.QUERIES, **problem_queries.QUERIES, **fixture_queries.QUERIES}
ORACLES = {**review_oracles.ORACLES, **report_queries.ORACLES, **problem_queries.ORACLES, **rule_oracles.ORACLES, **fixture_queries.ORACLES}


def _over_view(name: str):
    return lambda spark, sf_dir: QUERIES[name](spark, rules_view.RulesView(sf_dir))


QUERIES |= {f"rules_{n}": _over_view(n) for n in RULES}
ORACLES |= {f"rules_{n}": rules_view.over(ORACLES[n]) for n in RULES if n in ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected, labelled and graded reviews, counted by intensity."""
    return review_queries.intensity_distribution(spark, sf_dir)
