"""Mixing sources to target weights.

Tokens are added up per source; a source's rate is its target size by its own
size, at most its cap; each document then comes out floor(rate) times and once
more with probability equal to the fraction, decided by a hash of its id and the
seed, so a rerun of a lost task gives the same copies. No shuffle but the sums.

Defined cases: NULL texts have size 0; documents of NULL source and of sources
without target are left out (the total counts every document that has a source);
ids that repeat are documents of their own with equal draws; a target of 0 gives
no copies; a source without documents is reported with size 0 and its shortfall;
an empty table gives reports of size 0. Input columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_pct, max_repeats, size, total, want, rate, met) of (source, size) and the targets. As many rows as targets."""
    whole = Window.partitionBy()  # sizes and targets have one row per source
    own = sizes.withColumn("total", F.sum("size").over(whole))
    out = targets.join(own, "source", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("total", F.coalesce(F.max("total").over(whole), F.lit(0)))
    want = F.col("total") * F.col("target_pct") / 100
    most = F.col("size") * F.col("max_repeats")
    rate = F.when(F.col("size") > 0, F.least(want / F.col("size"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return out.select("source", "target_pct", "max_repeats", "size", "total", want.alias("want"), rate.alias("rate"), (most >= want).alias("met"))


def by_source(sized: DataFrame, size: str = "size") -> DataFrame:
    """(source, size) over all documents with a source, each once."""
    return sized.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum(size).alias("size"))


def mix(df: DataFrame, rate: DataFrame, id_col: str, seed: int = 7) -> DataFrame:
    """df's documents of target sources with `copies`, 0 left out: how often each comes out."""
    # One row per target; targets are a table of the caller's settings, not of the data.
    r = rate.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("__u")
    rows = df.select(F.struct(*[c for c in df.columns if c != "copies"]).alias("__row"), F.col("source").alias("__source"), u).join(F.broadcast(r), "__source")
    n = F.floor("__rate") + F.when(F.col("__u") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return rows.withColumn("__n", n.cast("int")).filter("__n > 0").select("__row.*", F.col("__n").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in `copy`."""
    return mixed.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copies")


def report(mixed: DataFrame, rate: DataFrame, size: str = "size") -> DataFrame:
    """Per target source: its rate, whether the target can be met, the size that came out and its actual share."""
    got = mixed.groupBy(F.col("source").alias("__source")).agg(F.sum(F.col(size) * F.col("copies")).alias("__out"), F.max("copies").alias("__most"))
    out = rate.join(got, F.col("source") == F.col("__source"), "left").withColumn("size_out", F.coalesce("__out", F.lit(0)))
    share = F.round(F.try_divide(F.col("size_out") * 100.0, F.sum("size_out").over(Window.partitionBy())), 3)
    return out.select("source", "target_pct", "max_repeats", "size", "rate", "met", "size_out", F.coalesce("__most", F.lit(0)).alias("most_copies"), share.alias("actual_pct"))
