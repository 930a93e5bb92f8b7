import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiza.functions.lineage import shared_dir, written
from tamiza.operators import analytics as an
from tamiza.operators import external, fuzzy, ml, repair, sarcasm
from tamiza.plans import pipeline
from tamiza.sources import csv as cs
from tamiza.sources import html
from tamiza.streaming import clean


def test_sarcasm_outcomes(spark):
    texts = ["Excelente, pero se traba", "Se traba, pero es excelente", "Jaja bien", "no dice nada, pero nada", "ajá claro", None, "Muy bueno. Lento, aunque bueno y lento"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.k.text, r.k.outcome) if r.k else None for r in df.select("i", sarcasm.cleaned(F.col("t")).alias("k")).collect()}
    assert got[0] == ("se traba", "kept_after_contrast") and got[1] == ("Se traba", "kept_before_contrast") and got[2] == ("bien", "cues_removed")
    assert got[3] == ("no dice nada, pero nada", "contrast_kept_full") and got[4] == ("ajá", "cues_removed")
    rows = {r.i: r for r in sarcasm.clean(df, "t").collect()}
    assert rows[0].sarcasm_reason == "positivo_vs_negativo" and rows[2].sarcasm_reason == "cue" and rows[5].t is None and rows[3].sarcasm_reason == ""


def test_strict_sarcasm(spark):
    df = spark.createDataFrame([("sí claro, un problema, pero \"genial\" bueno /s",), ("de adorno",), ("claro que si la pantalla falla nada",), ("como no, la pantalla",), (None,)], "t string")
    got = [tuple(r.k) for r in df.select(sarcasm.strict(F.col("t")).alias("k")).collect()]
    assert got == [(9, "tag+cue+positivo+contraste+comillas_positivas"), (4, "frase_sarcastica"), (2, "cue"), (0, ""), (0, "")]


def test_annotate_pipeline(spark):
    rows = [("SHOP_1", "No sirve, se traba y no enciende", "joy", 1.0, "Alegría"), ("SHOP_2", "EXCELENTE!! muy muy buenaaa", "x", 5.0, "Neutral"), ("SHOP_3", None, "x", float("nan"), "Miedo"), ("SHOP_4", "Explotó el cargador", "x", 5.0, "Neutral")]
    df = spark.createDataFrame(rows, "id_review string, final_clean_text string, rating string, rating_num double, base_emotion string")
    got = {r.id_review: r for r in pipeline.annotate(df).collect()}
    assert got["SHOP_1"].emotion == "Enojo" and got["SHOP_2"].emotion == "Alegría" and got["SHOP_2"].intensity == 4
    assert got["SHOP_3"].emotion == "" and got["SHOP_4"].emotion == "Enojo" and got["SHOP_4"].incongruencia_motivo == "enojo_rating_alto"
    assert pipeline.annotate(df.limit(0)).count() == 0


def test_edit_distance_against_brute_force(spark):
    def osa(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return int(d[-1, -1])

    rng = np.random.default_rng(0)
    words = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 6)))) for _ in range(60)})
    q = spark.createDataFrame([(w,) for w in words], "token string")
    d = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for k in (1, 2):
        got = {(r.token, r.word, r.d) for r in fuzzy.near_words(q, d, k).collect()}
        assert got == {(a, b, osa(a, b)) for a in words for b in words if osa(a, b) <= k}


def test_token_correction(spark):
    lexicon = spark.createDataFrame([("pantalla", 5.0), ("buena", 6.0), ("bueno", 6.0), ("está", 6.0), ("esta", 6.1), ("bien", 6.0), ("memoria", 4.0)], "word string, zipf double")
    corpus = spark.createDataFrame([("pantalla", 9), ("pantlla", 1), ("buenaa", 1), ("ram", 3)], "token string, n long")
    d = fuzzy.frequency_dictionary(corpus, lexicon, 100)
    fix = fuzzy.token_corrections(corpus.select("token"), d, lexicon)
    assert {tuple(r) for r in fix.collect()} == {("pantlla", "pantalla"), ("buenaa", "buena")}
    df = spark.createDataFrame([(1, "Pantlla, BUENAA; ram"), (2, None), (3, "bien")], "i int, t string")
    assert {r.i: r.t for r in fuzzy.replace_tokens(df, "t", fix, ["i"]).collect()} == {1: "Pantalla, BUENA; ram", 2: None, 3: "bien"}
    m = {r.i: r.t for r in fuzzy.merge_split_words(spark.createDataFrame([(1, "La mem ria est bien, est a"), (2, None), (3, "muy bien")], "i int, t string"), "t", lexicon).collect()}
    assert m == {1: "La mem ria está bien, está", 2: None, 3: "muy bien"} or m[1] == "La memoria está bien, está"
    assert {tuple(r) for r in fuzzy.spellcheck_corrections(spark.createDataFrame([("pntlla",), ("RAM",), ("xyzzy",)], "token string"), d).collect()} == {("pntlla", "pantalla")}


def test_external_stages(spark):
    df = spark.createDataFrame([(f"S{i}", t) for i, t in enumerate(["uno", None, " ", "falla", "x", "dos palabras"])], "id_review string, raw_text string")

    def call(t):
        if t == "falla":
            raise RuntimeError
        return t.upper()

    got = {r.id_review: r.clean_text for r in external.normalize_rows(df, "raw_text", call, wait=0).collect()}
    assert got == {"S0": "UNO", "S1": "", "S2": "", "S3": "falla", "S4": "X", "S5": "DOS PALABRAS"}
    lots = external.batches(df, "raw_text", size=2, buckets=1)
    sent = [json.loads(r.lote)["lote"] for r in lots.orderBy("batch").collect()]
    assert [[x["id"] for x in s] for s in sent] == [["S0", "S3"], ["S5"]]

    def model(lote):
        items = json.loads(lote)["lote"]
        if any(x["text"] == "falla" for x in items):
            raise RuntimeError
        return {x["id"]: x["text"].upper() for x in items}

    replies = external.ask(lots, model)
    out = {r.id_review: r.clean_text for r in external.join_replies(df, replies, "raw_text").collect()}
    assert out == {"S0": "UNO", "S1": external.SHORT, "S2": external.SHORT, "S3": external.BLOCKED, "S4": external.SHORT, "S5": "DOS PALABRAS"}
    text = spark.createDataFrame([('{"respuestas":[{"id":"a","texto_limpio":"b"},{"id":"c","texto_limpio":""}]}',), ("broken",)], "reply string")
    assert {tuple(r) for r in external.parse_replies(text).collect()} == {("a", "b"), ("c", None)}
    m = spark.createDataFrame([("hola , mundo", [(4, 1, "whitespace", [""]), (7, 5, "misspelling", ["mundos"]), (7, 5, "punctuation", ["casa"])]), (None, None)], "t string, m array<struct<offset:int,error_length:int,issue_type:string,replacements:array<string>>>")
    rows = [tuple(r.k) for r in m.select(external.apply_matches(F.col("t"), F.col("m")).alias("k")).collect()]
    assert rows == [("hola, mundo", 1, 2, 3), (None, 0, 0, 0)]
    assert {r.base_emotion for r in external.infer_emotion(df, "raw_text", lambda ts: ["joy" if t else "?" for t in ts]).collect()} == {"Alegría", "Neutral"}


@pytest.mark.parametrize("enc", ["utf-8-sig", "utf-8", "cp1252", "latin1"])
def test_csv_encodings(spark, tmp_path, enc):
    body = 'id,texto\n1,"á ""b""\nc"\n2,\n3,NA\n' + ("4,“x”\n" if enc != "latin1" else "4,\x81é\n")
    (tmp_path / "a.csv").write_bytes(body.encode(enc))
    df, used = cs.read_strings(spark, str(tmp_path / "a.csv"))
    assert used == enc and df.columns == ["id", "texto"]
    got = {r.id: r.texto for r in df.collect()}
    assert got["1"] == 'á "b"\nc' and got["2"] == "" and got["3"] == "NA" and got["4"] == ("“x”" if enc != "latin1" else "\x81é")
    typed = cs.read_typed(spark, str(tmp_path / "a.csv")) if enc != "cp1252" else None
    if typed is not None:
        assert {r.id: r.texto for r in typed.collect()}["3"] is None
    assert cs.read_typed(spark, str(tmp_path / "none.csv"), missing_ok=True) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "á"), (2, "")], "id int, t string")
    cs.write_csv(df, str(tmp_path / "out"))
    back, used = cs.read_strings(spark, str(tmp_path / "out"))
    assert used == "utf-8-sig" and back.columns == ["id", "t"] and {tuple(r) for r in back.collect()} == {("1", "á"), ("2", "")}
    path = str(tmp_path / "table")
    assert cs.replace(df, path) is None
    kept = cs.replace(df.limit(1), path, "once")
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(kept).count() == 2
    cs.replace(df.limit(0), path, "once")
    assert spark.read.parquet(kept).count() == 2 and cs.pinned_input(spark, path) == kept
    cs.append_batch(df, str(tmp_path / "b"), 1)
    cs.append_batch(df.limit(1), str(tmp_path / "b"), 1)
    assert cs.pending(df, spark.read.parquet(str(tmp_path / "b")), "id").count() == 1
    (tmp_path / "f").write_bytes(b"abc")
    assert cs.fingerprint(spark, str(tmp_path / "f")).collect()[0].fingerprint == "900150983cd2"
    with pytest.raises(ValueError):
        cs.require_columns(df, ["id", "zz"])


def test_html(spark):
    page = """<a href="/noindex/catalog/reviews/1?x">r</a><article data-testid="comment-component"><p class="andes-visually-hidden">Calificación 5 de 5</p>
    <span class="comment__date">01 ene. 2024</span><p class="x comment__content"> Muy &amp; bueno<br>sí</p></article><article data-testid="comment-component"><p class="comment__content"> </p></article>"""
    other = '<article class="ui-comment"><p class="comment__content">b</p></article><a data-testid="review-summary" href="/r/2">s</a>'
    df = spark.createDataFrame([("P1", "m", "n", page), ("P2", "m", "n", other), ("P3", "m", "n", None)], "product_id string, marca string, modelo string, html string")
    got = {r.product_id: r for r in html.parse_reviews(df).collect()}
    assert got["P1"].raw_text == "Muy & buenosí" and got["P1"].rating == "Calificación 5 de 5" and got["P1"].timestamp == "01 ene. 2024" and got["P2"].raw_text == "b" and "P3" not in got
    link = {r.product_id: r.l for r in df.select("product_id", html.review_link(F.col("html"), "h:").alias("l")).collect()}
    assert link == {"P1": "h:/noindex/catalog/reviews/1?x", "P2": "h:/r/2", "P3": None}


def test_ml(spark):
    rng = np.random.default_rng(0)
    rows = [(f"S{i}", " ".join(rng.choice(["bueno excelente", "genial feliz"] if i % 3 else ["malo roto", "lento triste"], 3)), "Alegría" if i % 3 else "Enojo") for i in range(120)]
    df = spark.createDataFrame(rows, "id_review string, final_clean_text string, emotion string")
    split = an.stratified_split(df, "emotion", "id_review")
    n = {(r.emotion, r.fold): r["count"] for r in split.groupBy("emotion", "fold").count().collect()}
    assert n == {("Alegría", "test"): 16, ("Alegría", "train"): 64, ("Enojo", "test"): 8, ("Enojo", "train"): 32}
    model = ml.fit(split.filter("fold = 'train'").drop("fold"), "final_clean_text", "emotion", iterations=10)
    pred = ml.predict(model, split.filter("fold = 'test'").drop("fold"), "final_clean_text", "emotion")
    assert an.accuracy(pred, "emotion_real", "emotion_pred").collect()[0].accuracy == 1.0
    assert {r.label: r.support for r in an.classification_report(pred, "emotion_real", "emotion_pred").collect()}["macro avg"] == 24


def test_repairs(spark):
    rows = [("r1", "port til nuevo"), ("r2", "port til viejo"), ("r3", "Port til y portatil")] + [(f"w{i}", "portatil portatil") for i in range(5)]
    df = spark.createDataFrame(rows, "id_review string, t string")
    rules = repair.mined_split_rules(df, ["t"], fragment_most=10)
    assert [tuple(r) for r in rules.collect()] == [("port", "til", "portatil")]
    got = {r.id_review: r.t for r in repair.clean_split_words(df, "t", rules).collect()}
    assert got["r1"] == "portatil nuevo" and got["r3"] == "Portatil y portatil"
    most, repair.MOST_BROADCAST = repair.MOST_BROADCAST, 0
    try:
        assert {r.id_review: r.t for r in repair.clean_split_words(df, "t", rules).collect()} == got
    finally:
        repair.MOST_BROADCAST = most
    mined = repair.mined_letter_rules(df, ["t"])
    assert [(r.t1, r.t2, r.word) for r in mined.collect()] == [("port", "til", "portatil")]
    assert {r.id_review: r.t for r in repair.apply_letter_rules(df, "t", mined).collect()}["r2"] == "portatil viejo"
    assert {(r.t1, r.t2, r.candidate) for r in repair.missing_letter_pairs(df, "t", repair.vocabulary(df, ["t"])).collect()} == {("port", "til", "portatil"), ("Port", "til", "portatil")}


def test_analytics_small(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "x")], "k string, o int, v string")
    assert {tuple(r) for r in an.keep_first(df, ["k"], [F.col("o")]).collect()} == {("a", 1, "x"), ("b", 3, "x")}
    assert [r.id_review for r in an.sequential_ids(df, ["o"]).orderBy("o").collect()] == ["SHOP_0001", "SHOP_0002", "SHOP_0003"]
    assert an.random_sample(df, 2, "o").count() == 2
    one = an.numeric_stats(spark.createDataFrame([("a", 1.0)], "m string, r double"), "m", "r").collect()[0]
    assert one["var"] is None and one["n"] == 1
    log = cs.change_log(F.col("k"), F.col("v"), F.col("o"), df)
    assert log.count() == 3


def test_stream(spark, tmp_path):
    rows = [("SHOP_1", "no sirve", "1", 1.0, "Alegría"), ("SHOP_1", "no sirve", "1", 1.0, "Alegría"), ("SHOP_2", "excelente", "5", 5.0, "Neutral")]
    df = spark.createDataFrame(rows, "id_review string, final_clean_text string, rating string, rating_num double, base_emotion string").withColumn("captured_at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = clean.new_rows(clean.read(spark, str(tmp_path / "in"), df.schema))
    q = clean.write(clean.annotated(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.id_review: r.emotion for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"SHOP_1": "Enojo", "SHOP_2": "Alegría"}
    w = clean.windowed_counts(clean.read(spark, str(tmp_path / "in"), df.schema))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").collect()[0].n == 3


def test_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = written(spark.range(10))
    assert df.count() == 10 and "tamiza-" in df.inputFiles()[0] and shared_dir(spark).split(":")[-1] in df.inputFiles()[0]
    assert spark.conf.get("spark.checkpoint.dir", None) == before

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_written_tables_go_with_the_driver(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
from tamiza.functions.lineage import clear, written
import glob
assert written(s.range(5)).count() == 5 and len(glob.glob("{tmp_path}/shared/tamiza-*/*")) == 1
clear(s)
assert not glob.glob("{tmp_path}/shared/tamiza-*")
print(written(s.range(3)).count(), len(glob.glob("{tmp_path}/shared/tamiza-*/*")))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=180)
    assert out.stdout.split()[-2:] == ["3", "1"], out.stderr
    assert not list((tmp_path / "shared").glob("tamiza-*"))


def test_batches_resume_and_log(spark, tmp_path):
    df = spark.createDataFrame([(f"S{i}", f"texto {i}") for i in range(7)] + [("S9", None)], "id_review string, raw_text string")
    asked = spark.sparkContext.accumulator(0)

    def model(lote):
        items = json.loads(lote)["lote"]
        if len(items) > 1 and any(x["id"] == "S3" for x in items) or items[0]["id"] == "S3":
            raise RuntimeError
        asked.add(len(items))
        return {x["id"]: "" if x["id"] == "S4" else x["text"].upper() for x in items}

    at = str(tmp_path / "replies")
    first = {r.id_review: r.clean_text for r in external.run_batches(df.filter("id_review < 'S3'"), "raw_text", model, at).collect()}
    assert first == {f"S{i}": f"TEXTO {i}" for i in range(3)} and asked.value == 3
    rows = {r.id_review: r.clean_text for r in external.run_batches(df, "raw_text", model, at).collect()}
    assert rows["S3"] == external.BLOCKED and rows["S4"] == external.FAILED and rows["S6"] == "TEXTO 6" and rows["S9"] == external.SHORT
    assert asked.value == 6  # S0 to S2 are not asked again
    assert {tuple(r) for r in external.failures(spark.read.parquet(at)).collect()} == {("S3", "blocked"), ("S4", "empty")}
    cs.write_table(df, str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        cs.write_table(df, str(tmp_path / "t"))
    cs.write_table(df.limit(1), str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_running_counts_of_safe_corrections(spark):
    from tamiza.operators import corrector

    df = spark.createDataFrame([("si no s que",), ("s no s que",), ("S lo eso y s lo otro",), ("nada",), (None,)], "t string")
    assert [tuple(r.k) for r in df.select(corrector.safe_corrections(F.col("t")).alias("k")).collect()] == [("si no se que", 1), ("sino s que", 1), ("Solo eso y solo otro", 2), ("nada", 0), (None, None)]


def test_split_words(spark):
    lexicon = spark.createDataFrame([("memoria", 5.0), ("pantalla", 5.0), ("esta", 6.0), ("está", 5.9), ("bien", 6.0), ("la", 7.0), ("compra", 5.0), ("muy", 6.0), ("cansado", 4.0), ("mas", 5.0), ("más", 5.9), ("canasta", 1.7)], "word string, zipf double")
    texts = {1: "La mem ria", 2: "MEM RIA y Mem\tria", 3: "est a, EST E", 4: "est bien; Est muy", 5: "la m s nueva", 6: "can sta", 7: "pant lla mem ria.", 8: "sin nada", 9: "", 10: "mem  ria", 11: "mem-ria", 12: None}
    want = {1: "La memoria", 2: "MEMORIA y Memoria", 3: "está, ESTÁ", 4: "está bien; Está muy", 5: "la más nueva", 6: "canasta", 7: "pantalla memoria.", 8: "sin nada", 9: "", 10: "memoria", 11: "mem-ria", 12: None}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "i int, t string, p string")
    got = fuzzy.merge_split_words(df, "t", lexicon)
    assert got.columns == ["i", "t", "p"] and {r.i: r.t for r in got.collect()} == want
    assert fuzzy.merge_split_words(df.limit(0), "t", lexicon).count() == 0


def test_contextual_clean(spark):
    lexicon = spark.createDataFrame([("pantalla", 5.0), ("buena", 6.0), ("que", 7.0), ("la", 7.0), ("está", 6.0), ("por", 7.0)], "word string, zipf double")
    df = spark.createDataFrame([(1, "La pantlla  est a buenaa , q", "x"), (2, None, "y"), (3, " ", "z")], "i int, raw_text string, final_clean_text string")
    assert {r.i: r.final_clean_text for r in pipeline.contextual_clean(df, lexicon).collect()} == {1: "La pantalla está buena, que", 2: "y", 3: "z"}
