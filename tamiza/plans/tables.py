"""The tables queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiza.plans import rules_view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if isinstance(sf_dir, rules_view.RulesView) and name in rules_view.TABLES:
        return rules_view.frame(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, over all cores: a table of fewer splits than cores is dealt out again, any other stays as it is read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
