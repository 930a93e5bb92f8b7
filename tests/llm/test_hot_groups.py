"""A third of all rows in one group of copies, one key, one source."""

from pyspark.sql import functions as F

from tamiza.llm import copies, lookalike, mixing, overlap, packing, sampling


def test_hot_copies(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("Peso: uno; Color: dos; Uso: tres")).otherwise(F.concat(F.lit("texto propio numero "), F.col("id").cast("string")))
    df = spark.range(6000).select(F.format_string("%05d", "id").alias("id"), hot.alias("text"))
    members, kept = copies.groups(df, "id", "text")
    assert [tuple(r) for r in kept.collect()] == [("00000", 2000)]
    assert members.count() == 1999


def test_hot_class(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit("uno dos tres cuatro cinco seis siete ocho nueve diez")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string")))), " "))
    df = spark.range(3000).select(F.col("id").alias("rec_id"), text.alias("t"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    members, links = overlap.overlaps(df, "rec_id", "t", "split")
    assert links.count() == 1
    got = overlap.link_counts(members, links)
    assert got.count() == 1000 and {r.n_links for r in got.collect()} == {500}
    assert overlap.record_pairs(members, links).count() == 250_000


def test_hot_text_is_normalised_once(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("ｈｏｌａ")).otherwise(F.concat(F.lit("á"), F.col("id").cast("string"))).alias("t"))
    got = lookalike.normalize(df, "t")
    assert got.count() == 3000 and got.filter("form = 'hola'").count() == 1000 and got.filter(F.col("form").contains("á")).count() == 2000


def test_hot_cell_and_source(spark):
    rows = spark.range(30000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("category"), F.lit("s").alias("second"))
    quota = spark.createDataFrame([("p", "a", "s", 12345)], "plan string, category string, second string, quota long")
    assert sampling.draw(rows, quota).select("id").distinct().count() == 12345
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("size"))
    rate = mixing.rates(mixing.by_source(docs), spark.createDataFrame([("s", 40, 1)], "source string, target_pct int, max_repeats int"))
    assert abs(mixing.mix(docs, rate, "doc_id").count() - 1200) < 120


def test_repeated_id_is_packed_row_by_row(spark):
    docs = spark.range(600).select(F.lit(1).alias("doc_id"), F.lit("casa perro mesa").alias("text"))
    got = packing.pack(docs, "doc_id", "text", 64, block=100)
    assert got.select("uid").distinct().count() == 600 and got.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s")).collect()[0][0] <= 64
