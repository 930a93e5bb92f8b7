"""Report queries: shares, cross-tables, top lists, statistics, filters, classifier metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamiza.functions.text import cloud_words, sanitize, strip


def share(df: DataFrame, column: str, of_all: bool = True) -> DataFrame:
    """A1 to A3: (value, n, pct): counts of non-null values; percent of all rows, or of the non-null ones."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # one row per value is left here
    if of_all:
        n = n.withColumn("whole", whole).filter(F.col("value").isNotNull())
    else:
        n = n.filter(F.col("value").isNotNull()).withColumn("whole", whole)
    return n.select("value", "n", F.round(F.col("n") * 100.0 / F.greatest("whole", F.lit(1)), 2).alias("pct"))


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key combination, null keys dropped."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def numeric_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, sample variance and deviation, count; one value has no variance."""
    x = F.when(~F.isnan(F.col(value)), F.col(value))
    return df.dropna(subset=[by]).groupBy(by).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("std"), F.count(x).alias("n")).orderBy(F.desc_nulls_last("mean"), by)


def kpis(df: DataFrame) -> DataFrame:
    """One row."""
    n = F.count("*")
    critical = F.count_if(F.coalesce(F.col("intensity").cast("double") == 4, F.lit(False)))
    return df.agg(n.alias("n"), critical.alias("critical"), F.coalesce(F.round(F.try_divide(critical * 100.0, n), 2), F.lit(0.0)).alias("critical_pct"))


def accuracy(df: DataFrame, real: str, pred: str) -> DataFrame:
    """A10."""
    return df.agg(F.avg(F.col(real).eqNullSafe(F.col(pred)).cast("double")).alias("accuracy"))


def per_label(df: DataFrame, real: str, pred: str) -> DataFrame:
    """A12's rows: (label, precision, recall, f1, support) over the union of labels, 0 where undefined."""
    pairs = df.groupBy(F.col(real).alias("r"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col("r").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    hit = F.when(F.col("r") == F.col("p"), F.col("n")).otherwise(0)
    rows = pairs.select(F.explode(both).alias("x"), hit.alias("hit")).select("x.*", F.when(F.col("x.support") > 0, F.col("hit")).otherwise(0).alias("tp"))
    s = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return s.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def classification_report(df: DataFrame, real: str, pred: str) -> DataFrame:
    """A12 with its summary rows: accuracy (in f1), macro avg, weighted avg."""
    rows = per_label(df, real, pred)
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0))
    macro = rows.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"), F.sum("support").alias("support"))
    acc = rows.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), w("recall").alias("f1"), F.sum("support").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def weighted_f1(df: DataFrame, real: str, pred: str) -> DataFrame:
    """A11."""
    return per_label(df, real, pred).agg(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias("weighted_f1"))


def confusion(df: DataFrame, real: str, pred: str, labels: list[str]) -> DataFrame:
    """One row per real label, one column per predicted one."""
    return df.filter(F.col(real).isin(labels)).groupBy(F.col(real).alias("real")).agg(*[F.count_if(F.col(pred) == x).alias(x) for x in labels])


def arg_max_per(counts_: DataFrame, by: str, what: str) -> DataFrame:
    """Per group the most frequent value; ties by value. Counted first, so no window is over rows."""
    return counts_.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), what))).filter("k = 1").drop("k")


def with_top(df: DataFrame, top: DataFrame, by: str, what: str, name: str) -> DataFrame:
    """Left join of each group's top value; one row per group is joined."""
    return df.join(top.select(by, F.col(what).alias(name)), by, "left")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W2, W4 (with descending order): one row per key. Aggregated, not ranked, so a hot key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def sequential_ids(df: DataFrame, order: list[str], name: str = "id_review", prefix: str = "SHOP_") -> DataFrame:
    """SHOP_0001, ... in the given order. Ranges are sorted in parallel and numbered by their offsets, so no task sees all rows."""
    spark = df.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism)
    from tamiza.functions.lineage import written

    parts = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    # The upper bits of the running id are the partition: one count per partition comes to the driver.
    sizes = {r["p"]: (r["n"], r["lo"]) for r in parts.groupBy(F.shiftright("__id", 33).alias("p")).agg(F.count("*").alias("n"), F.min("__id").alias("lo")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before - sizes[p][1]))
        before += sizes[p][0]
    off = spark.createDataFrame(rows or [(0, 0)], "__p long, __off long")
    out = parts.withColumn("__p", F.shiftright("__id", 33)).join(F.broadcast(off), "__p")  # one row per partition
    return out.withColumn(name, F.format_string(f"{prefix}%04d", F.col("__id") + F.col("__off") + 1)).drop("__id", "__p", "__off")


def top(counts_: DataFrame, most: int, *tie: str) -> DataFrame:
    """T1 to T3, T5."""
    return counts_.orderBy(F.desc("n"), *tie).limit(most)


def cloud_terms(df: DataFrame, text: str, stopwords: DataFrame, most: int = 100) -> DataFrame:
    """The most frequent words of three letters or more that are no stopwords. stopwords: (word); its accent-free forms count too."""
    from tamiza.functions.text import strip_accents_keep_enye

    low = F.lower(F.col("word"))
    stop = stopwords.select(F.explode(F.array(low, strip_accents_keep_enye(low))).alias("word")).distinct()
    w = df.select(F.explode(cloud_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return top(w.join(stop, "word", "left_anti"), most, "word")


@dataclass(frozen=True)
class ReviewFilter:
    """An empty list filters nothing."""

    brands: list[str] = field(default_factory=list)
    models: list[str] = field(default_factory=list)
    emotions: list[str] = field(default_factory=list)
    keyword: str = ""
    intensity: tuple[float, float] | None = None


def valid_intensity(df: DataFrame, column: str = "intensity") -> DataFrame:
    """Rows whose value is a number from 1 to 4."""
    return df.withColumn(column, F.col(column).cast("string").try_cast("double")).filter(F.col(column).between(1, 4))


def filtered(df: DataFrame, f: ReviewFilter) -> DataFrame:
    tests = [F.col(c).isin(v) for c, v in (("marca", f.brands), ("modelo", f.models), ("emotion", f.emotions)) if v]
    if f.keyword:
        tests.append(F.coalesce(F.col("final_clean_text").rlike(f"(?iu){f.keyword}"), F.lit(False)))
    if f.intensity:
        tests.append(F.col("intensity").between(*f.intensity))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_options(df: DataFrame, column: str, brands: list[str] | None = None) -> DataFrame:
    """P5: sorted distinct values, of the chosen brands."""
    rows = df.filter(F.col("marca").isin(brands)) if brands else df
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


#: Named selections of the dashboard.
SELECTIONS = {
    "qa": lambda: F.col("emotion").isin("Enojo", "Miedo") & (F.col("intensity") >= 3),
    "complaints": lambda: F.col("emotion").isin("Enojo", "Tristeza"),
    "sla": lambda: F.col("intensity") == 4,
    "marketing": lambda: (F.col("emotion") == "Alegría") & (F.col("intensity") == 4),
}


def alerts(df: DataFrame, most: int = 5) -> DataFrame:
    """Models with most angry or fearful reviews of intensity 3 or more."""
    return top(counts(df.filter(SELECTIONS["qa"]()), "modelo"), most, "modelo")


def preview(df: DataFrame, flag: str, text: str, order: str, most: int = 10, width: int = 60) -> DataFrame:
    """The first flagged rows, long texts cut."""
    cut = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(F.col(text))
    return df.filter(F.coalesce(F.col(flag), F.lit(False))).orderBy(order, text).limit(most).withColumn(text, cut)


def labelled_rows(df: DataFrame, text: str, label: str, least: int = 2) -> DataFrame:
    """Rows with text and label whose label occurs at least `least` times; labels are few, so they are joined as a small table."""
    rows = df.withColumn(text, strip(F.coalesce(F.col(text), F.lit("")))).withColumn(label, strip(F.coalesce(F.col(label), F.lit(""))))
    rows = rows.filter((F.length(text) > 0) & (F.length(label) > 0))
    ok = rows.groupBy(label).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(label)
    return rows.join(ok, label, "left_semi")


def stratified_split(df: DataFrame, label: str, id_col: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """R2: `fold` train or test: of each label the rows of smallest hash are its test rows, exactly the rounded share. The bound is found from counts of hash ranges, so no task orders a whole label."""
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))
    keyed = df.withColumn("__key", key).withColumn("__r", F.substring("__key", 1, 4))
    n = keyed.groupBy(label, "__r").agg(F.count("*").alias("n"))
    run = Window.partitionBy(label).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("want", F.floor(F.sum("n").over(Window.partitionBy(label)) * test + 0.5))
    edge = n.filter((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want"))).select(F.col(label).alias("__l"), F.col("__r").alias("__last"), (F.col("want") - F.col("before")).alias("__rest"))
    rows = keyed.join(edge, F.col(label) == F.col("__l"), "left")
    near = rows.filter(F.col("__r") == F.col("__last")).withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy("__key", id_col)))
    near = near.withColumn("fold", F.when(F.col("__k") <= F.col("__rest"), "test").otherwise("train")).drop("__k")
    far = rows.filter(F.coalesce(F.col("__r") != F.col("__last"), F.lit(True))).withColumn("fold", F.when(F.col("__r") < F.col("__last"), "test").otherwise("train"))
    return near.unionByName(far).select(*df.columns, "fold")


def random_sample(df: DataFrame, most: int, id_col: str, seed: int = 1) -> DataFrame:
    """A sample that a rerun gives again."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), id_col).limit(most)


def dashboard_view(df: DataFrame) -> DataFrame:
    """Sanitised text, numeric intensity from 1 to 4, intensity category."""
    rows = valid_intensity(df.withColumn("final_clean_text", sanitize(F.col("final_clean_text"))))
    return rows.withColumn("Intensidad", F.col("intensity").cast("int").cast("string"))
