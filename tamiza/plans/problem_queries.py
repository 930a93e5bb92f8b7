"""Queries of the general data-quality problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.operators import strict_load
from tamiza.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.rejects(table(spark, sf_dir, "csv_records")).select("record_id", "reason").distinct()


def p4_loaded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.load_strict(table(spark, sf_dir, "csv_records"), "raw_laptops_ml.csv", strict_load.REVIEWS)


def p4_loaded_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.load_strict(table(spark, sf_dir, "csv_records"), "reporte_correcciones_v7.csv", strict_load.CORRECTIONS)


def p4_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects and loaded rows per file."""
    bad = strict_load.rejects(table(spark, sf_dir, "csv_records"))
    return bad.groupBy("file_name", "reason").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_loaded_reviews": p4_loaded_reviews,
    "p4_loaded_corrections": p4_loaded_corrections,
    "p4_reject_counts": p4_reject_counts,
}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_JUDGED = f"""
WITH r AS (
  SELECT record_id, file_name, record,
    regexp_full_match(record, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted,
    list_transform(regexp_extract_all(',' || record, ',({_FIELD})', 1, 's'),
      lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
  FROM csv_records),
j AS (
  SELECT *, CASE
    WHEN record IS NULL THEN 'column_count'
    WHEN NOT quoted THEN 'quoting'
    WHEN file_name = 'raw_laptops_ml.csv' AND len(f) <> 12 THEN 'column_count'
    WHEN file_name = 'reporte_correcciones_v7.csv' AND len(f) <> 2 THEN 'column_count'
    WHEN file_name = 'raw_laptops_ml.csv' AND NOT (
      regexp_full_match(f[1], 'SHOP_[0-9]{{4,}}')
      AND (f[2] = '' OR (regexp_full_match(f[2], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(f[2] AS date) IS NOT NULL))
      AND regexp_full_match(f[5], 'Calificación [1-5] de 5')
      AND f[6] IN ('', 'Alegría', 'Tristeza', 'Enojo', 'Sorpresa', 'Asco', 'Miedo', 'Neutral')
      AND regexp_full_match(f[7], '[1-4]?')
      AND regexp_full_match(f[9], 'ML_PROD_[0-9]{{3}}')) THEN 'invalid_value'
    WHEN file_name = 'reporte_correcciones_v7.csv' AND NOT (
      regexp_full_match(f[1], 'SHOP_[0-9]{{4,}}')
      AND len(list_filter(string_split(f[2], ' | '), lambda p: NOT (p = 'Manual exacto' OR regexp_matches(p, '^→[^\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{3000}}]')))) = 0) THEN 'invalid_value'
  END AS reason FROM r)
"""

ORACLES: dict[str, str] = {
    "p4_found": _JUDGED + "SELECT DISTINCT record_id, reason FROM j WHERE reason IS NOT NULL",
    "p4_reject_counts": _JUDGED + "SELECT file_name, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_loaded_corrections": _JUDGED + "SELECT record_id AS _offset, f[1] AS id, f[2] AS cambios FROM j WHERE reason IS NULL AND file_name = 'reporte_correcciones_v7.csv'",
    "p4_loaded_reviews": _JUDGED
    + """SELECT record_id AS _offset, f[1] AS id_review, try_cast(nullif(f[2], '') AS date) AS timestamp, f[3] AS raw_text, f[4] AS clean_text,
  f[5] AS rating, f[6] AS emotion, try_cast(nullif(f[7], '') AS integer) AS intensity, f[8] AS source, f[9] AS product_id,
  f[10] AS category, f[11] AS marca, f[12] AS modelo FROM j WHERE reason IS NULL AND file_name = 'raw_laptops_ml.csv'""",
}
