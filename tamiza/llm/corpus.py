"""What several operators need of the review tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.llm import mojibake
from tamiza.plans.tables import spread, table


def texts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """(tbl, id_review, text) of the named tables and their text columns."""
    parts = [spread(table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "id_review", F.col(c).alias("text"))) for t, c in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def review_pmi(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Mutual information of adjacent characters over both tables of problem 3."""
    rows = texts(spark, sf_dir, raw_reviews="raw_text", corrected="final_clean_text")
    return mojibake.mutual_information(mojibake.pair_counts(rows, rows["text"]))
