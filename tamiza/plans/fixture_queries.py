"""Queries of operators that need inputs no table has: grammar matches, model replies, pages, files. All are derived from the rules view."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.functions import text as tx
from tamiza.functions.lineage import own_dir, written
from tamiza.operators import analytics as an
from tamiza.operators import corrector, emotion, external, ml, repair, sarcasm
from tamiza.plans import pipeline, rules_view
from tamiza.plans.rule_oracles import collapse, corrected, strip
from tamiza.plans.review_oracles import _FULL
from tamiza.plans.review_oracles import ORACLES as REVIEWS
from tamiza.plans.tables import table
from tamiza.sources import csv, html

Query = Callable[[SparkSession, str], DataFrame]


def _view(s: SparkSession, d: str) -> DataFrame:
    return table(s, rules_view.RulesView(d), "corrected")


def grammar_applied(s: SparkSession, d: str) -> DataFrame:
    """Three or four matches for each text; two kinds are safe to apply."""
    t = F.coalesce("raw_text", F.lit(""))
    at = F.instr(t, " ,")
    match = lambda o, n, kind, to: F.struct(F.lit(o).cast("int").alias("offset") if isinstance(o, int) else o.cast("int").alias("offset"), F.lit(n).alias("error_length"), F.lit(kind).alias("issue_type"), F.array(to).alias("replacements"))
    own = F.array_compact(F.array(F.when(at > 4, match(at - 1, 2, "punctuation", F.lit(","))), match(0, 3, "typographical", F.upper(F.left(t, F.lit(3)))), match(0, 1, "misspelling", F.lit("X")), match(1, 1, "whitespace", F.lit("zz"))))
    return _view(s, d).select("id_review", external.apply_matches(t, own).alias("k")).select("id_review", "k.text", "k.applied", "k.skipped", "k.total")


def llm_normalized(s: SparkSession, d: str) -> DataFrame:
    """N1 with a model that fails for questions."""

    def model(text: str) -> str:
        if "?" in text:
            raise RuntimeError("refused")
        return text.upper()

    return external.normalize_rows(_view(s, d).select("id_review", "raw_text"), "raw_text", model, wait=0)


def _batch_model(request: str) -> dict[str, str]:
    items = json.loads(request)["lote"]
    if any("Explotó" in x["text"] for x in items):
        raise RuntimeError("blocked")
    return {x["id"]: x["text"].lower() for x in items}


def llm_batch_clean(s: SparkSession, d: str) -> DataFrame:
    """Batches with a model that blocks some texts, resumed once."""
    rows, at = written(_view(s, d).select("id_review", "raw_text")), f"{own_dir(s)}/{uuid.uuid4().hex}"
    external.run_batches(rows.filter("id_review < 'SHOP_02'"), "raw_text", _batch_model, at)
    return external.run_batches(rows, "raw_text", _batch_model, at)


def llm_replies(s: SparkSession, d: str) -> DataFrame:
    """N2."""
    one = F.to_json(F.struct(F.array(F.struct(F.col("id_review").alias("id"), F.col("raw_text").alias("texto_limpio"))).alias("respuestas")))
    broken = F.when(F.col("rating_num") == 5, F.concat(F.lit("no json "), "id_review")).otherwise(one)
    return external.parse_replies(_view(s, d).select(broken.alias("reply")))


def _pages(s: SparkSession, d: str) -> DataFrame:
    article = F.concat(F.lit('<article data-testid="comment-component"><p class="andes-visually-hidden">'), "rating", F.lit('</p><p class="x comment__content">'), "raw_text", F.lit("</p></article>"))
    link = F.when(F.col("rating_num") % 2 == 0, F.concat(F.lit('<a href="/noindex/catalog/reviews/'), "id_review", F.lit('?a=1">ver</a>')))
    return _view(s, d).select(F.col("id_review").alias("product_id"), F.lit("m").alias("marca"), F.lit("n").alias("modelo"), F.concat(F.lit("<html>"), F.coalesce(link, F.lit("")), article, F.lit("</html>")).alias("html"))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Written with a mark, read as strings."""
    at = f"{own_dir(s)}/{uuid.uuid4().hex}"
    csv.write_csv(_view(s, d).select("id_review", "raw_text", "clean_text", "rating_num"), at)
    got, encoding = csv.read_strings(s, at)
    return got.withColumn("encoding", F.lit(encoding))


def csv_typed(s: SparkSession, d: str) -> DataFrame:
    """Written without a mark, read with types; a missing source is nothing."""
    at = f"{own_dir(s)}/{uuid.uuid4().hex}"
    rows = _view(s, d).select("id_review", F.when(F.col("rating_num") == 3, "NA").otherwise(F.col("raw_text")).alias("raw_text"), "rating_num")
    csv.write_csv(rows, at, bom=False)
    kinds = rows.schema
    assert csv.read_typed(s, f"{at}-none", missing_ok=True) is None
    return csv.read_typed(s, at, kinds)


def file_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """K14 of a file that holds one number."""
    at = f"{own_dir(s)}/{uuid.uuid4().hex}"
    _view(s, d).agg(F.concat(F.lit("rows "), F.count("*").cast("string")).alias("value")).coalesce(1).write.text(at)
    return csv.fingerprint(s, f"{at}/part-*").select("fingerprint")


def ml_predictions(s: SparkSession, d: str) -> DataFrame:
    """Fitted on the training fold, predictions of the others."""
    rows = an.labelled_rows(table(s, d, "fase5_records").select(F.col("rec_id").cast("string").alias("id_review"), "final_clean_text", "emotion"), "final_clean_text", "emotion")
    fold = written(an.stratified_split(rows, "emotion", "id_review"))
    model = ml.fit(fold.filter("fold = 'train'").drop("fold"), "final_clean_text", "emotion", iterations=5)
    return ml.predict(model, fold.filter("fold = 'test'").drop("fold"), "final_clean_text", "emotion")


def manual_corrections(s: SparkSession, d: str) -> DataFrame:
    """A table of texts made by hand goes before the rules."""
    rows = _view(s, d).select("id_review", "final_clean_text")
    manual = rows.filter(F.col("id_review").endswith("0")).select("id_review", F.concat(F.lit("hecho a mano....  "), "id_review").alias("text"))
    return corrector.correct(rows, manual=manual).select("id_review", "final_clean_text", F.array_join("cambios", " | ").alias("cambios"))


def repair_examples(s: SparkSession, d: str) -> DataFrame:
    """Of each label the first five texts; the limit is the feature."""
    return repair.examples(_view(s, d), F.col("base_emotion"), F.col("raw_text"), F.col("id_review"))


def sarcasm_counters(s: SparkSession, d: str) -> DataFrame:
    """A24 of the sarcasm stage."""
    rows = _view(s, d).select(F.col("final_clean_text").alias("was"), "final_clean_text")
    done = sarcasm.clean(rows).withColumn("hit", F.col("sarcasm_reason") != "")
    return pipeline.counters(done, "final_clean_text", "was", "hit")


def letter_counters(s: SparkSession, d: str) -> DataFrame:
    """A24 of the letter repair."""
    return pipeline.counters(_view(s, d).withColumn("now", corrector.letter_repair(F.col("final_clean_text"))), "now", "final_clean_text")


def pending_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _view(s, d).select("id_review", "rating_num")
    return csv.pending(rows, rows.filter("rating_num >= 3"))


def emotion_labels(s: SparkSession, d: str) -> DataFrame:
    """An injected model's labels as emotions."""
    rows = _view(s, d).select("id_review", "raw_text")
    return external.infer_emotion(rows, "raw_text", lambda texts: ["joy" if t.startswith("E") else "anger" if "no" in t else "unknown" for t in texts]).select("id_review", "base_emotion")


def _each(f) -> Query:
    return lambda s, d: _view(s, d).select("id_review", f(F.col("raw_text")).alias("out"))


QUERIES: dict[str, Query] = {
    "grammar_applied": grammar_applied,
    "llm_normalized": llm_normalized,
    "llm_batch_clean": llm_batch_clean,
    "llm_replies": llm_replies,
    "html_reviews": lambda s, d: html.parse_reviews(_pages(s, d), "shop").select("product_id", "raw_text", "rating", "source", "category"),
    "review_links": lambda s, d: _pages(s, d).select("product_id", html.review_link(F.col("html"), "https://shop.example").alias("link")),
    "csv_round_trip": csv_round_trip,
    "csv_typed": csv_typed,
    "file_fingerprint": file_fingerprint,
    "ml_predictions": ml_predictions,
    "manual_corrections": manual_corrections,
    "repair_examples": repair_examples,
    "sarcasm_counters": sarcasm_counters,
    "letter_counters": letter_counters,
    "pending_rows": pending_rows,
    "emotion_labels": emotion_labels,
    "non_blank_rows": lambda s, d: _view(s, d).filter(~tx.is_blank(F.col("clean_text"))).select("id_review", "clean_text"),
    "normalize_spaces": _each(tx.normalize_spaces),
    "trailing_dots": _each(tx.trailing_dots),
    "consonant_skeleton": _each(tx.consonant_skeleton),
    "has_accent": _each(tx.has_accent),
    "safe_replacement": lambda s, d: _view(s, d).select("id_review", tx.is_safe_replacement(F.col("raw_text"), F.col("final_clean_text_original")).alias("same"), tx.is_safe_replacement(F.col("raw_text"), tx.normalize_a(F.upper("raw_text"))).alias("same_upper")),
}

_V = f"WITH v AS ({rules_view.sql()})"
_SKELETON = lambda x: f"regexp_replace({x}, '(?i)[aeiouáéíóúü]+', '', 'g')"
_SIG = lambda x: f"lower(regexp_replace({x}, '[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+', '', 'g'))"
_STRIPPED = strip("raw_text")

ORACLES: dict[str, str] = {
    "grammar_applied": _V
    + """, a AS (SELECT id_review, coalesce(raw_text, '') AS t FROM v), b AS (SELECT *, instr(t, ' ,') AS p, trim(t) = '' AS blank FROM a),
c AS (SELECT *, CASE WHEN p > 4 THEN left(t, p - 1) || ',' || substr(t, p + 2) ELSE t END AS u FROM b)
SELECT id_review, CASE WHEN blank THEN t ELSE upper(left(u, 3)) || substr(u, 4) END AS text, CASE WHEN blank THEN 0 ELSE 1 + (p > 4)::integer END AS applied, CASE WHEN blank THEN 0 ELSE 2 END AS skipped, CASE WHEN blank THEN 0 ELSE 3 + (p > 4)::integer END AS total FROM c""",
    "llm_normalized": _V + " SELECT id_review, raw_text, CASE WHEN trim(raw_text) = '' THEN '' WHEN contains(raw_text, '?') THEN raw_text ELSE upper(raw_text) END AS clean_text FROM v",
    "llm_batch_clean": _V + f" SELECT id_review, raw_text, CASE WHEN length({_STRIPPED}) < 2 THEN '[CORTO_O_VACIO]' WHEN contains(raw_text, 'Explotó') THEN '[BLOQUEADO_POR_SEGURIDAD]' ELSE lower({_STRIPPED}) END AS clean_text FROM v",
    "llm_replies": _V + " SELECT id_review AS id, nullif(raw_text, '') AS texto_limpio FROM v WHERE rating_num <> 5",
    "html_reviews": _V + f" SELECT id_review AS product_id, {_STRIPPED} AS raw_text, rating, 'shop' AS source, 'laptop' AS category FROM v WHERE {_STRIPPED} <> ''",
    "review_links": _V + " SELECT id_review AS product_id, CASE WHEN rating_num % 2 = 0 THEN 'https://shop.example/noindex/catalog/reviews/' || id_review || '?a=1' END AS link FROM v",
    "csv_round_trip": _V + " SELECT id_review, raw_text, coalesce(clean_text, '') AS clean_text, rating_num::varchar AS rating_num, 'utf-8-sig' AS encoding FROM v",
    "csv_typed": _V + " SELECT id_review, CASE WHEN rating_num <> 3 THEN nullif(raw_text, '') END AS raw_text, rating_num FROM v",
    "file_fingerprint": _V + " SELECT left(md5('rows ' || count(*) || chr(10)), 12) AS fingerprint FROM v",
    "manual_corrections": f"WITH v AS ({rules_view.sql()}), c AS ({corrected('v', 'id_review')}) SELECT id_review, CASE WHEN ends_with(id_review, '0') THEN 'hecho a mano... ' || id_review ELSE final_clean_text END AS final_clean_text, CASE WHEN ends_with(id_review, '0') THEN 'Manual exacto' ELSE cambios END AS cambios FROM c",
    "repair_examples": _V + ' SELECT base_emotion AS "group", k, raw_text AS text FROM (SELECT base_emotion, raw_text, row_number() OVER (PARTITION BY base_emotion ORDER BY id_review, raw_text) AS k FROM v) WHERE k <= 5',
    "pending_rows": _V + " SELECT id_review, rating_num FROM v WHERE rating_num < 3",
    "emotion_labels": _V + " SELECT id_review, CASE WHEN starts_with(raw_text, 'E') THEN 'Alegría' WHEN contains(raw_text, 'no') THEN 'Enojo' ELSE 'Neutral' END AS base_emotion FROM v",
    "non_blank_rows": _V + f" SELECT id_review, clean_text FROM v WHERE {_FULL('clean_text')}",
    "normalize_spaces": _V + f" SELECT id_review, {strip(collapse('raw_text'))} AS out FROM v",
    "trailing_dots": _V + r" SELECT id_review, regexp_replace(raw_text, '\.{2,}$', '.') AS out FROM v",
    "consonant_skeleton": _V + f" SELECT id_review, {_SKELETON('raw_text')} AS out FROM v",
    "has_accent": _V + " SELECT id_review, regexp_matches(raw_text, '(?i)[áéíóú]') AS out FROM v",
    "safe_replacement": _V + f" SELECT id_review, {_SIG('raw_text')} = {_SIG('final_clean_text_original')} AS same, true AS same_upper FROM v",
    "sarcasm_counters": rules_view.over(
        "WITH s AS (" + REVIEWS["sarcasm_clean"].replace("SELECT id_review, reason AS sarcasm_reason", "SELECT x AS was, reason AS sarcasm_reason") + f") SELECT count(*) AS rows, count(*) FILTER ({_FULL('was')}) AS processed, count(*) FILTER (NOT {_FULL('was')}) AS skipped, count(*) FILTER ({_FULL('was')} AND was IS DISTINCT FROM final_clean_text) AS changed, count(*) FILTER ({_FULL('was')} AND sarcasm_reason <> '') AS detected FROM s"
    ),
    "letter_counters": rules_view.over(
        "WITH s AS (SELECT c.final_clean_text AS was, k.out AS now FROM corrected c JOIN (" + REVIEWS["letter_repair"] + f") k USING (id_review)) SELECT count(*) AS rows, count(*) FILTER ({_FULL('was')}) AS processed, count(*) FILTER (NOT {_FULL('was')}) AS skipped, count(*) FILTER ({_FULL('was')} AND was IS DISTINCT FROM now) AS changed FROM s"
    ),
}
