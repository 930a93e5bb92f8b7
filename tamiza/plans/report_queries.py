"""Report and analytics queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.operators import analytics as an
from tamiza.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _view(s: SparkSession, d: str) -> DataFrame:
    return an.dashboard_view(table(s, d, "complete"))


def _predicted(s: SparkSession, d: str) -> DataFrame:
    """Real and predicted labels: the corrected emotion against the base label."""
    return table(s, d, "complete").filter(F.col("emotion").isNotNull() & F.col("base_emotion").isNotNull()).select("id_review", F.col("emotion").alias("real"), F.col("base_emotion").alias("pred"))


_LABELS = ["Alegría", "Tristeza", "Enojo", "Sorpresa", "Asco", "Miedo", "Neutral"]
_FILTER = an.ReviewFilter(brands=["Kovix", "Lumbra"], emotions=["Enojo", "Alegría"], keyword="pantalla|bater[ií]a", intensity=(2, 4))
_STOP = ["para", "pero", "con", "que", "los", "las", "una", "por", "del", "como", "más", "muy", "sin"]


def top_brand_per_emotion(s: SparkSession, d: str) -> DataFrame:
    return an.arg_max_per(an.counts(_view(s, d), "emotion", "marca"), "emotion", "marca")


def emotion_share_with_brand(s: SparkSession, d: str) -> DataFrame:
    share = an.share(_view(s, d), "emotion").withColumnRenamed("value", "emotion")
    return an.with_top(share, top_brand_per_emotion(s, d), "emotion", "marca", "top_brand")


def stratified_split_counts(s: SparkSession, d: str) -> DataFrame:
    rows = an.labelled_rows(table(s, d, "fase5_records").select("rec_id", "final_clean_text", "emotion"), "final_clean_text", "emotion")
    return an.stratified_split(rows, "emotion", "rec_id").groupBy("emotion", "fold").agg(F.count("*").alias("n"))


def stratified_split_rows(s: SparkSession, d: str) -> DataFrame:
    """The drawn rows themselves."""
    rows = an.labelled_rows(table(s, d, "fase5_records").select("rec_id", "final_clean_text", "emotion"), "final_clean_text", "emotion")
    return an.stratified_split(rows, "emotion", "rec_id").select("rec_id", "emotion", "fold")


def review_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred reviews; the limit is the feature."""
    rows = table(s, d, "complete").filter("id_review IS NOT NULL").groupBy("id_review").agg(F.max("final_clean_text").alias("final_clean_text"))
    return an.random_sample(rows, 100, "id_review")


def sequential_ids(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id")
    return an.sequential_ids(rows, ["doc_id"]).select("doc_id", "id_review")


def product_reviews(s: SparkSession, d: str) -> DataFrame:
    """Reviews with their product's row; products are a table of the catalogue."""
    p = table(s, d, "products").select(F.col("id").alias("product_id"), F.col("marca").alias("product_marca"), F.col("modelo").alias("product_modelo"), "url")
    return table(s, d, "raw_reviews").select("id_review", "product_id").join(p, "product_id").select("id_review", "product_id", "product_marca", "product_modelo", "url")


def dedup_reviews(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "raw_reviews").filter(F.col("raw_text").isNotNull() & F.col("product_id").isNotNull()).select("product_id", "raw_text", "id_review", "loaded_at")
    return an.keep_first(rows, ["product_id", "raw_text"], [F.col("loaded_at"), F.col("id_review")]).select("product_id", "id_review", F.unix_micros("loaded_at").alias("loaded_us"))


def latest_reviews(s: SparkSession, d: str) -> DataFrame:
    """Of each id the row loaded last."""
    rows = table(s, d, "raw_reviews").groupBy("id_review").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("n"))
    return rows.select("id_review", F.unix_micros("loaded_at").alias("loaded_us"), "n")


QUERIES: dict[str, Query] = {
    "emotion_share": lambda s, d: an.share(table(s, d, "complete"), "emotion"),
    "intensity_share": lambda s, d: an.share(an.valid_intensity(table(s, d, "complete")), "intensity", of_all=False),
    "emotion_by_intensity": lambda s, d: an.counts(_view(s, d), "emotion", "Intensidad"),
    "brand_by_emotion": lambda s, d: an.counts(_view(s, d), "marca", "emotion"),
    "top_brand_per_emotion": top_brand_per_emotion,
    "emotion_share_with_brand": emotion_share_with_brand,
    "top5_alert_models": lambda s, d: an.alerts(_view(s, d)),
    "brand_stats": lambda s, d: an.numeric_stats(_view(s, d), "marca", "rating_num"),
    "kpis": lambda s, d: an.kpis(_view(s, d)),
    "sla_critical": lambda s, d: _view(s, d).filter(an.SELECTIONS["sla"]()).select("id_review", "marca", "modelo", "emotion"),
    "complaints": lambda s, d: an.counts(_view(s, d).filter(an.SELECTIONS["complaints"]()), "modelo"),
    "marketing": lambda s, d: an.counts(_view(s, d).filter(an.SELECTIONS["marketing"]()), "marca"),
    "brand_emotion_filter": lambda s, d: an.filtered(_view(s, d), _FILTER).select("id_review", "marca", "emotion", "intensity"),
    "filter_options": lambda s, d: an.filter_options(_view(s, d), "modelo", ["Kovix", "Lumbra"]),
    "flag_preview": lambda s, d: an.preview(table(s, d, "complete").filter("final_clean_text IS NOT NULL"), "flag_incongruencia", "final_clean_text", "id_review").select("id_review", "final_clean_text"),
    "wordcloud_terms": lambda s, d: an.cloud_terms(table(s, d, "complete"), "final_clean_text", s.createDataFrame([(w,) for w in _STOP], "word string")),
    "accuracy": lambda s, d: an.accuracy(_predicted(s, d), "real", "pred"),
    "weighted_f1": lambda s, d: an.weighted_f1(_predicted(s, d), "real", "pred"),
    "classification_report": lambda s, d: an.classification_report(_predicted(s, d), "real", "pred"),
    "confusion_matrix": lambda s, d: an.confusion(_predicted(s, d), "real", "pred", _LABELS),
    "stratified_split_counts": stratified_split_counts,
    "stratified_split_rows": stratified_split_rows,
    "review_sample": review_sample,
    "sequential_ids": sequential_ids,
    "product_reviews": product_reviews,
    "dedup_reviews": dedup_reviews,
    "latest_reviews": latest_reviews,
    "source_brand_counts": lambda s, d: an.counts(table(s, d, "raw_reviews"), "source", "marca"),
}

_VIEW = "WITH v AS (SELECT *, cast(intensity AS double) AS level FROM complete WHERE intensity BETWEEN 1 AND 4)\n"
_PAIR = """WITH x AS (SELECT emotion AS r, base_emotion AS p FROM complete WHERE emotion IS NOT NULL AND base_emotion IS NOT NULL),
l AS (SELECT r AS label FROM x UNION SELECT p FROM x),
c AS (SELECT label, (SELECT count(*) FROM x WHERE r = label AND p = label) AS tp, (SELECT count(*) FROM x WHERE r = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted FROM l),
m AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted::double ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::double ELSE 0 END AS recall FROM c),
f AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM m)
"""

# Full-width letters and ordinals are plain letters to the word cloud; ñ parts words.
_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "ªº"
_PLAIN = "abcdefghijklmnopqrstuvwxyz" * 2 + "ao"
_CLOUD = f"""WITH w AS (SELECT unnest(regexp_extract_all(strip_accents(translate(replace(lower(final_clean_text), 'ñ', ' '), '{_WIDE.lower()}', '{_PLAIN}')), '[a-z]+')) AS word FROM complete)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND NOT list_contains([{', '.join(repr(x) for x in _STOP)}, 'mas'], word) GROUP BY word ORDER BY n DESC, word LIMIT 100"""

ORACLES: dict[str, str] = {
    "wordcloud_terms": _CLOUD,
    "emotion_share": "SELECT emotion AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM complete), 2) AS pct FROM complete WHERE emotion IS NOT NULL GROUP BY emotion",
    "intensity_share": _VIEW + "SELECT level AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 2) AS pct FROM v GROUP BY level",
    "emotion_by_intensity": _VIEW + "SELECT emotion, cast(cast(level AS integer) AS varchar) AS \"Intensidad\", count(*) AS n FROM v WHERE emotion IS NOT NULL GROUP BY ALL",
    "brand_by_emotion": _VIEW + "SELECT marca, emotion, count(*) AS n FROM v WHERE emotion IS NOT NULL AND marca IS NOT NULL GROUP BY ALL",
    "top_brand_per_emotion": _VIEW + "SELECT emotion, marca, n FROM (SELECT emotion, marca, count(*) AS n FROM v WHERE emotion IS NOT NULL AND marca IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY n DESC, marca) = 1",
    "emotion_share_with_brand": _VIEW
    + """, b AS (SELECT emotion, marca FROM (SELECT emotion, marca, count(*) AS n FROM v WHERE emotion IS NOT NULL AND marca IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY n DESC, marca) = 1)
SELECT s.emotion, n, pct, b.marca AS top_brand FROM (SELECT emotion, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v), 2) AS pct FROM v WHERE emotion IS NOT NULL GROUP BY emotion) s LEFT JOIN b USING (emotion)""",
    "top5_alert_models": _VIEW + "SELECT modelo, count(*) AS n FROM v WHERE emotion IN ('Enojo', 'Miedo') AND level >= 3 AND modelo IS NOT NULL GROUP BY modelo ORDER BY n DESC, modelo LIMIT 5",
    "brand_stats": _VIEW + "SELECT marca, avg(r) AS mean, var_samp(r) AS var, stddev_samp(r) AS std, count(r) AS n FROM (SELECT marca, CASE WHEN NOT isnan(rating_num) THEN rating_num END AS r FROM v WHERE marca IS NOT NULL) GROUP BY marca",
    "kpis": _VIEW + "SELECT count(*) AS n, count(*) FILTER (level = 4) AS critical, coalesce(round(count(*) FILTER (level = 4) * 100.0 / nullif(count(*), 0), 2), 0) AS critical_pct FROM v",
    "sla_critical": _VIEW + "SELECT id_review, marca, modelo, emotion FROM v WHERE level = 4",
    "complaints": _VIEW + "SELECT modelo, count(*) AS n FROM v WHERE emotion IN ('Enojo', 'Tristeza') AND modelo IS NOT NULL GROUP BY modelo",
    "marketing": _VIEW + "SELECT marca, count(*) AS n FROM v WHERE emotion = 'Alegría' AND level = 4 AND marca IS NOT NULL GROUP BY marca",
    "brand_emotion_filter": _VIEW + "SELECT id_review, marca, emotion, level AS intensity FROM v WHERE marca IN ('Kovix', 'Lumbra') AND emotion IN ('Enojo', 'Alegría') AND level BETWEEN 2 AND 4 AND regexp_matches(final_clean_text, 'pantalla|bater[ií]a', 'i')",
    "filter_options": _VIEW + "SELECT DISTINCT modelo FROM v WHERE marca IN ('Kovix', 'Lumbra') AND modelo IS NOT NULL",
    "flag_preview": "SELECT id_review, CASE WHEN length(final_clean_text) > 60 THEN left(final_clean_text, 60) || '...' ELSE final_clean_text END AS final_clean_text FROM complete WHERE flag_incongruencia AND final_clean_text IS NOT NULL ORDER BY complete.id_review, complete.final_clean_text LIMIT 10",
    "accuracy": "SELECT avg((emotion IS NOT DISTINCT FROM base_emotion)::integer::double) AS accuracy FROM complete WHERE emotion IS NOT NULL AND base_emotion IS NOT NULL",
    "weighted_f1": _PAIR + "SELECT sum(f1 * support) / sum(support) AS weighted_f1 FROM f",
    "classification_report": _PAIR
    + """SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, sum(recall * support) / sum(support), sum(support)::bigint FROM f""",
    "confusion_matrix": "SELECT emotion AS real, " + ", ".join(f"count(*) FILTER (base_emotion = '{x}') AS \"{x}\"" for x in _LABELS) + f" FROM complete WHERE base_emotion IS NOT NULL AND emotion IN ({', '.join(repr(x) for x in _LABELS)}) GROUP BY emotion",
    "stratified_split_counts": r"""WITH r AS (SELECT regexp_replace(emotion, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS emotion FROM fase5_records WHERE regexp_matches(final_clean_text, '[^\s\p{Z}]') AND regexp_matches(emotion, '[^\s\p{Z}]')),
c AS (SELECT emotion, count(*) AS n, cast(floor(count(*) * 0.2 + 0.5) AS bigint) AS t FROM r GROUP BY emotion HAVING count(*) >= 2)
SELECT emotion, 'test' AS fold, t AS n FROM c WHERE t > 0 UNION ALL SELECT emotion, 'train', n - t FROM c""",
    "stratified_split_rows": r"""WITH r AS (SELECT rec_id, regexp_replace(emotion, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS emotion FROM fase5_records WHERE regexp_matches(final_clean_text, '[^\s\p{Z}]') AND regexp_matches(emotion, '[^\s\p{Z}]')),
c AS (SELECT *, count(*) OVER (PARTITION BY emotion) AS n, row_number() OVER (PARTITION BY emotion ORDER BY md5('42-' || rec_id), rec_id) AS k FROM r)
SELECT rec_id, emotion, CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS fold FROM c WHERE n >= 2""",
    "review_sample": "SELECT id_review, max(final_clean_text) AS final_clean_text FROM complete WHERE id_review IS NOT NULL GROUP BY id_review ORDER BY md5('1-' || complete.id_review), complete.id_review LIMIT 100",
    "sequential_ids": "SELECT doc_id, printf('SHOP_%04d', row_number() OVER (ORDER BY doc_id)) AS id_review FROM documents",
    "product_reviews": "SELECT id_review, product_id, p.marca AS product_marca, p.modelo AS product_modelo, url FROM raw_reviews r JOIN products p ON p.id = r.product_id",
    "dedup_reviews": "SELECT product_id, id_review, epoch_us(loaded_at) AS loaded_us FROM (SELECT *, row_number() OVER (PARTITION BY product_id, raw_text ORDER BY loaded_at NULLS FIRST, id_review) AS k FROM raw_reviews WHERE raw_text IS NOT NULL AND product_id IS NOT NULL) WHERE k = 1",
    "latest_reviews": "SELECT id_review, epoch_us(max(loaded_at)) AS loaded_us, count(*) AS n FROM raw_reviews GROUP BY id_review",
    "source_brand_counts": "SELECT source, marca, count(*) AS n FROM raw_reviews WHERE source IS NOT NULL AND marca IS NOT NULL GROUP BY ALL",
}
