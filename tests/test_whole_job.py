"""Queries and operators that must do the whole job: no blank input, no cut by size."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamiza.operators import corrector, repair
from tamiza.plans import pipeline
from tamiza.streaming import clean

SMALL = "/root/testdata/sf0.001"


def test_text_queries_read_text(spark):
    """accent_strip_raw and capitalize_sentences give a text wherever the review has one."""
    texts = spark.read.parquet(f"{SMALL}/raw_reviews.parquet").filter(F.trim("raw_text") != "").count()
    for name in ("accent_strip_raw", "capitalize_sentences"):
        assert entry.queries()[name](spark, SMALL).filter(F.trim("out") != "").count() == texts


def test_near_words_at_every_size(spark, tmp_path):
    """edit1_by_ratio finds a torn word whatever the size of the corpus."""
    for times in (1, 10):
        texts = ["avis"] * 2 + ["aviso"] * 30 + ["otra"] * 4
        d = tmp_path / str(times)
        spark.createDataFrame([(t,) for t in texts * times], "final_clean_text string").write.parquet(str(d / "corrected.parquet"))
        assert [tuple(r) for r in entry.queries()["edit1_by_ratio"](spark, str(d)).collect()] == [("avis", "aviso", 1)]


def test_known_words_at_every_size(spark, tmp_path):
    """deep_audit repairs a document, and corpus_lexicon holds the same words, whatever the size of the corpus."""
    for times in (1, 6):
        corpus = spark.createDataFrame([("pantalla " * 1000,)] * (100 * times) + [("pantala",)] * times, "final_clean_text string")
        corpus.write.parquet(str(tmp_path / str(times) / "complete.parquet"))
        df = spark.createDataFrame([("r1", None, "la pantala", "", "la pantala")], "id_review string, text_after_sarcasm string, final_clean_text string, clean_text string, raw_text string")
        df.write.parquet(str(tmp_path / str(times) / "corrected.parquet"))
        assert entry.queries()["deep_audit"](spark, str(tmp_path / str(times))).collect()[0].final_clean_text == "la pantalla"
        assert [r.word for r in pipeline.corpus_lexicon(corpus, ["final_clean_text"]).collect()] == ["pantalla"]


def test_many_letter_rules(spark, monkeypatch):
    """letter_repair_mined: more than 200 rules do what each does by its own regex, broadcast or joined."""
    letters = "abcdefghijklmnop"
    rules = [(f"zz{a}{b}", "vv", 3, f"zz{a}{b}ovv") for a in letters for b in letters]
    rules += [("pesta", "as", 9, "pestañas"), ("compa", "era", 8, "compañera"), ("q", "s", 7, "qus"), ("qus", "caro", 6, "qusxcaro"), ("caro", "fin", 5, "caroxfin")]
    texts = ["las Pesta\nas y la COMPA  era", "q s caro fin", "Q\u00a0S", "q s q s s", "q-s, q  s.", "xq s", "q s1", "zzab vv zzcd\tvv", "ſq s q ſ", "q s\u0301", "nada", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame(rules, "t1 string, t2 string, n long, word string")
    order = sorted(rules, key=lambda r: (-r[2], r[0], r[1]))
    one_by_one = [(rf"(?iuU)\b{a}[\s\x1c-\x1f\x85]+{b}\b", w) for a, b, _, w in order if a[:2] != "zz" or a in ("zzab", "zzcd")]
    want = {r.i: r.t for r in df.select("i", corrector.letter_repair(F.col("t"), one_by_one).alias("t")).collect()}
    assert want[0] == "las pestañas y la compañera" and want[1] == "qusxcaro fin"
    for most in (200_000, 100):
        monkeypatch.setattr(repair, "MOST_BROADCAST", most)
        assert {r.i: r.t for r in repair.apply_letter_rules(df, "t", table).collect()} == want


def test_late_rows_of_a_stream(spark, tmp_path):
    """new_rows, windowed_counts: over several batches a row months behind the newest is kept and counted, and a repeat of an id comes out once."""
    schema = "id_review string, captured_at timestamp"
    for key, day in [("a", "2024-06-01"), ("late", "2024-03-01"), ("b", "2024-06-02"), ("a", "2024-09-01")]:
        one = spark.createDataFrame([(key, day)], "id_review string, day string").select("id_review", F.to_timestamp("day").alias("captured_at"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: clean.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    clean.write(clean.new_rows(read()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id_review for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "late"]
    q = clean.windowed_counts(read()).writeStream.format("memory").queryName("late_counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r.start)[:10], r.n) for r in spark.table("late_counts").collect()) == [("2024-03-01", 1), ("2024-06-01", 1), ("2024-06-02", 1), ("2024-09-01", 1)]
