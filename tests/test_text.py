import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamiza.functions import text as tx
from tamiza.operators import corrector, encoding


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.o for r in df.select("i", f(F.col("x")).alias("o")).orderBy("i").collect()]


ODD = ["", " ", None, "\xa0a\x1c", " ñ Ñ é", "a , b . c !", "fin.", "a.b.", "fin...", "ÁÉ ǘ", "x\u2028y", "jaja!!!!! ok????", "a....", "é. ó. a", "¡hola! ¿qué? www.x"]


def test_strip_and_collapse_like_python(spark):
    assert run(spark, tx.strip, ODD) == [v if v is None else v.strip() for v in ODD]
    assert run(spark, tx.collapse, ODD) == [v if v is None else re.sub(r"\s+", " ", v) for v in ODD]
    assert run(spark, tx.n_words, ODD) == [len((v or "").split()) for v in ODD]


def test_accents_over_the_bmp(spark):
    chars = [chr(c) for c in range(0x20, 0x2100)]
    got = run(spark, tx.strip_accents, ["x" + c for c in chars])
    want = ["x" + "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn") for ch in chars]
    # A few marks are younger than the tables of Java, and some Indic vowels split otherwise.
    assert sum(a != b for a, b in zip(got, want)) <= 80
    assert run(spark, tx.strip_accents_keep_enye, ["ñandú Ñ ﬁ"]) == ["ñandu Ñ ﬁ"]


def test_capitalize_sentences(spark):
    def plain(t):
        return t if not t else re.sub(r"(?<=[.!?])\s*([a-z])", lambda m: m.group(0)[:-1] + m.group(1).upper(), t[0].upper() + t[1:])

    values = [v for v in ODD if v is not None] + ["a.b. c?d!\n e", "hola.ñ .z"]
    assert run(spark, tx.capitalize_sentences, values) == [plain(v) for v in values]


def test_periods_and_normalisers(spark):
    assert run(spark, tx.strip_only_period, ["a.", "a.b.", "a..", None, "."]) == ["a", "a.b.", "a..", None, ""]
    assert run(spark, tx.normalize_a, ["a  b .", "a...", "a .."]) == ["a b", "a...", "a."]
    for f in (tx.normalize_a, tx.normalize_b, tx.clean_runs, tx.normalize_controls):
        once = run(spark, f, ODD)
        if f is not tx.normalize_a:
            assert run(spark, f, once) == once


def test_rating(spark):
    df = spark.createDataFrame([("4.7", None), ("NaN", "Calificación 5 de 5"), (None, "x"), ("0", "3"), ("-1.5", "2")], "a string, b string")
    assert [r.o for r in df.select(tx.rating_value(F.col("a"), F.col("b")).alias("o")).collect()] == [4, 5, None, 0, -1]


def test_corrector(spark):
    got = run(spark, lambda x: corrector.apply_rules(x, corrector.ALL_RULES), ["la m quina esta muy bien", "nada", None, "x el precio, xfa", "tambien tambien", "x ser el"])
    assert [(r.text, r.changes) if r else r for r in got] == [
        ("la máquina está muy bien", ["→máquina", "→está"]), ("nada", []), (None, []), ("por el precio, por favor", ["→por", "→por favor"]), ("también también", ["→también"]), ("x ser el", []),
    ]
    df = spark.createDataFrame([("SHOP_1", "Q tal la maquina 😀😀. es rapido...."), ("SHOP_2", "lo que sea"), ("SHOP_3", None)], "id_review string, final_clean_text string")
    manual = spark.createDataFrame([("SHOP_2", "Texto  a mano .")], "id string, text string")
    rows = {r.id_review: r for r in corrector.correct(df, manual=manual).collect()}
    assert rows["SHOP_1"].final_clean_text == "Que tal la máquina. Es rápido."
    assert rows["SHOP_1"].cambios == ["→máquina", "→rápido", "→que"] and rows["SHOP_1"].clean_length_words == 6
    assert rows["SHOP_2"].final_clean_text == "Texto a mano." and rows["SHOP_2"].cambios == ["Manual exacto"]
    assert rows["SHOP_3"].final_clean_text == "Nan"
    assert {tuple(r) for r in corrector.change_report(corrector.correct(df, manual=manual)).collect()} == {("SHOP_1", "→máquina | →rápido | →que"), ("SHOP_2", "Manual exacto")}


def test_cased_rules(spark):
    assert run(spark, corrector.encoding_words, ["DISEO Diseo diseo ms Batera rediseo"]) == ["DISEÑO Diseño diseño más Batería rediseo"]
    assert run(spark, corrector.chat_expansions, ["Q tal, muy x todo x eso", "no. Q dijo Q", "TMB tmb Tmb", "Xq no"]) == ["Que tal, muy x todo por eso", "no. Que dijo que", "TAMBIEN tambien Tambien", "Porque no"]
    assert run(spark, corrector.compr_context, ["mi compr", "me la Compr", "COMPR una", "yo compr", "la compr", "compras"]) == ["mi compra", "me la Compré", "COMPRÉ una", "yo compré", "la compré", "compras"]
    assert run(spark, corrector.confusables, ["Lap y e comprado", "ME PRECIO bien"]) == ["Laptop y he comprado", "ME PARECIO bien"]
    r = run(spark, corrector.safe_corrections, ["M s r pido, se  p de", None])
    assert (r[0].text, r[0].n) == ("Mas rapido, se puede", 3) and r[1].text is None


def test_questions(spark):
    assert run(spark, corrector.clean_questions, ["¿¿Buen precio??", "Que tal?", "...", None, "no lo he visto todavia ahi???", "no lo he visto todavia ahi??"]) == ["..Buen precio..", "Que tal?", "", "", "no lo he visto todavia ahi.", "no lo he visto todavia ahi??"]


def test_ambiguous(spark):
    assert run(spark, corrector.is_ambiguous, ["s que", "brghn", "ctrl", "todo bien"]) == [True, True, False, False]


@pytest.mark.parametrize("a", encoding.PAGES)
@pytest.mark.parametrize("b", ["utf-8", *encoding.PAGES])
def test_recode_like_python(spark, a, b):
    values = ["plain", "Bajó más", "Ã³ Ã±", "¾ ß", "│├", "€", "漢", ""]

    def plain(x):
        try:
            return x.encode(a).decode(b)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None

    assert run(spark, lambda x: encoding.recode(x, a, b), values) == [plain(v) for v in values]


def test_sanitize_encoding(spark):
    assert run(spark, encoding.sanitize_gated, ["BajÃ³  a\x00b", "bien", None, "\ufeffa\xa0b"]) == ["Bajó a b", "bien", None, "a b"]
    assert run(spark, lambda x: encoding.sanitize_all(x, strict=True), ["¿Qué?", "cafÃ©"]) == ["¿Qué?", "café"]
