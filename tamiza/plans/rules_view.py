"""A derived table on which every rewrite rule fires: a fixed list of texts, dealt out over all documents.

The review tables hold almost none of the faults the rules mend, so the queries of the rules run over this view as well,
under `rules_` and their own name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = [
    "Excelente laptop, muy rápido todo", "No sirve, se traba y no enciende", "Está bien pero la batería es muy mala", "Sí claro, excelente para tirar el dinero, sarcasmo",
    "La pantalla es m s grande, tambi n es r pida", "Explotó el cargador, quiero mi dinero", "¿¿¿Buen precio???", "SSD SUPER RÁPIDO!! me encantaaa", "Creo que es un poco lento", "No es bueno, nunca falla", "Dicen que se quema", "",
    "La m quina es port til y el disco es r pido. es f cil de usar....", "la maquina y la musica, ademas tambien es rapido   , asi que biene bien!!!!!", "esta muy bien 🔥 esta mal. la compra x favor q no llega, d el centro dl norte",
    "xfa digan la vdd, np creer", "xa el niño y d la casa. x las tardes", "s no s que hacer, si no s que decir y s lo pido", "Gr fica buena, gr ficos malos y S lo eso. M s de lo mismo", "Menls mal; se p de usar, QUIZ S regalar n otra",
    "Pr ctica y fr gil, con plasti ci n y la op ci n, la ver si n nueva est bien", "el diseo de la batera es de hace un ao, MS barato y Senal mala", "k bueno, OK todo bien, ok gracias", "Q bien. q tal, muy x eso y x nada, pq si, XQ no, Tmb el tb",
    "mi compr llegó, me la compr ayer, lo compr barato, Compr una laptop, yo compr otra, una COMPR mala", "la lap y el apto, LAP nueva, me precio bien, Tambi n remiendo, exelente suero, home oficie lord", "¿Sirve para juegos?", "Muy bueno??? y ya?? sin mas",
    "s que n se nada, y un día más", "el mgsv y el dlls, pero xkcd tch brrr", "Claro que si, \"genial\" el problema, pero nada bueno /s", "Sí claro, un problema y nada más, sarcasmo", "de adorno quedó", "Jaja excelente, pero se traba", "Se traba, pero es excelente",
    "La baterÃ\xada durÃ³ mÃ¡s de un aÃ±o", "El niÃ±o explicÃ³ Â¿quÃ©?", "compu tadora y computadora, comput dora buena", "comput dora mala y computadora", "impres ra lenta, impresora", "la mem ria ram, la memoria", "Hola. buen día! todo bien? si. no", "NI MUY MUY, NI TAN TAN. pésimo!!! 5", "  con   espacios .  y , puntos.",
]
#: Of two documents only, so that their halves stay rare.
RARE = [(1, "el torn llo suelto y el tornillo y otro tornillo y mil tornillos, tornillo"), (2, "un torn llo y tornillo")]
_LABELS = ["Alegría", "Tristeza", "Enojo", "Sorpresa", "Asco", "Miedo", "Neutral"]
#: Tables that the view stands for.
TABLES = ("raw_reviews", "corrected", "complete")


class RulesView(str):
    """A directory whose review tables are the view."""


def frame(spark: SparkSession, documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    texts = F.array(*map(F.lit, TEXTS))
    text = lambda k: F.element_at(texts, (F.pmod(i + k, F.lit(len(TEXTS))) + 1).cast("int"))
    own = text(0)
    for n, t in RARE:
        own = F.when(i == n, t).otherwise(own)
    level = F.pmod(F.floor(i / 5), F.lit(6)).cast("double")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.pmod(F.floor(i / 3), F.lit(7)) + 1).cast("int"))
    return documents.select(
        F.format_string("SHOP_%04d", i + 1).alias("id_review"), own.alias("raw_text"), own.alias("final_clean_text"), F.when(i % 2 == 0, text(1)).alias("clean_text"), F.lit("").alias("text_after_sarcasm"),
        text(7).alias("text_pre_v7"), text(3).alias("final_clean_text_original"), level.alias("rating_num"), F.concat(F.lit("Calificación "), level.cast("int").cast("string"), F.lit(" de 5")).alias("rating"),
        label.alias("base_emotion"), label.alias("emotion"),
    )


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    texts = "[" + ", ".join(map(_q, TEXTS)) + "]"
    text = lambda k: f"({texts})[(doc_id + {k}) % {len(TEXTS)} + 1]"
    own = "CASE " + " ".join(f"WHEN doc_id = {n} THEN {_q(t)}" for n, t in RARE) + f" ELSE {text(0)} END"
    label = "([" + ", ".join(map(_q, _LABELS)) + "])[(doc_id // 3) % 7 + 1]"
    return f"""SELECT printf('SHOP_%04d', doc_id + 1) AS id_review, {own} AS raw_text, {own} AS final_clean_text, CASE WHEN doc_id % 2 = 0 THEN {text(1)} END AS clean_text, '' AS text_after_sarcasm,
{text(7)} AS text_pre_v7, {text(3)} AS final_clean_text_original, cast((doc_id // 5) % 6 AS double) AS rating_num, 'Calificación ' || (doc_id // 5) % 6 || ' de 5' AS rating, {label} AS base_emotion, {label} AS emotion FROM documents"""


def over(query: str) -> str:
    """The SQL of a query over the view in place of the review tables."""
    return "WITH rules_view AS (" + sql() + "), " + ", ".join(f"{t} AS (SELECT * FROM rules_view)" for t in TABLES) + f" SELECT * FROM ({query})"
