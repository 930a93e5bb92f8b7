"""Queries of the training-data operators and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiza.functions.lineage import written
from tamiza.functions.text import is_blank
from tamiza.llm import abuse, copies, corpus, lookalike, mixing, mojibake, overlap, packing, quality, sampling
from tamiza.llm.tokens import n_tokens
from tamiza.plans.tables import spread, table


#: A text scores as a case from here.
ABUSE_FROM = 0.35


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its score and kind; rows that repeat an id score alike."""
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", complete="final_clean_text")
    model = abuse.fit(*abuse.labelled(table(spark, sf_dir, "abuse_labels"), rows))
    return abuse.score(rows, "text", model).drop("text")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review, once per id, with its score and kind."""
    return _p1(spark, sf_dir).dropDuplicates(["tbl", "id_review"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).filter(F.col("abuse_score") >= ABUSE_FROM).select("tbl", "id_review").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and rates per table and source; an id counts for each source it is given with."""
    sources = table(spark, sf_dir, "raw_reviews").select(F.lit("raw_reviews").alias("tbl"), "id_review", "source")
    sources = sources.unionByName(table(spark, sf_dir, "complete").select(F.lit("complete").alias("tbl"), "id_review", "source")).distinct()
    rows = p1_scores(spark, sf_dir).join(sources, ["tbl", "id_review"])
    case = F.col("abuse_score") >= ABUSE_FROM
    kinds = [F.count_if(case & (F.col("abuse_kind") == k)).alias(f"n_{k}") for k in abuse.KINDS]
    return rows.groupBy("tbl", "source").agg(F.count("*").alias("n"), F.count_if(case).alias("n_cases"), *kinds, F.round(F.avg(case.cast("double")), 6).alias("rate"))


def _p2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return overlap.overlaps(spread(table(spark, sf_dir, "fase5_records").select("rec_id", "final_clean_text", "split")), "rec_id", "final_clean_text", "split")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_pairs(*_p2(spark, sf_dir))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping record with its class and its number of links."""
    return overlap.link_counts(*_p2(spark, sf_dir)).select(F.col("id").alias("rec_id"), F.hex("cls").alias("class_id"), "n_links")


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and evaluation records per evaluation split and source, from the sizes of linked classes: no pair is expanded."""
    rec = table(spark, sf_dir, "fase5_records").select("rec_id", "split", "source").filter("split != 'train'").dropDuplicates(["rec_id"])
    own = overlap.link_counts(*_p2(spark, sf_dir)).filter("side = 2").select(F.col("id").alias("rec_id"), "n_links")
    return own.join(rec, "rec_id").groupBy("split", "source").agg(F.sum("n_links").alias("n_pairs"), F.count("*").alias("n_records"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled review with its restored text; lost letters come back where the corpus' words leave one choice."""
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", corrected="final_clean_text")
    # Repaired once: its lost letters, the words they may be and the restored rows are read apart.
    garbled = written(_garbled(spark, sf_dir).dropDuplicates(["tbl", "id_review"]))
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return mojibake.restore_lost(garbled, "restored", words, ["tbl", "id_review"])


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", corrected="final_clean_text")
    return mojibake.repair(rows, "text", corpus.review_pmi(spark, sf_dir)).filter("garbled")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("tbl", "id_review").distinct()


def p6_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review, once per id, in the common form; garbled ones are restored first."""
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", complete="final_clean_text").dropDuplicates(["tbl", "id_review"])
    asked = F.coalesce(F.col("text").rlike(mojibake.CANDIDATE) | F.col("text").rlike(lookalike.QUESTIONABLE), F.lit(False))
    # Repaired once: what follows reads the repaired texts several times.
    mended = written(mojibake.repair(rows.filter(asked), "text", corpus.review_pmi(spark, sf_dir)))
    plain = rows.filter(~asked).select("*", F.lit(False).alias("garbled"), F.col("text").alias("restored"), F.col("text").alias("form"))
    return lookalike.normalize(mended, "restored").unionByName(plain)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", complete="final_clean_text").filter(F.col("text").rlike(lookalike.QUESTIONABLE))
    # Repaired once: what follows reads the sound texts several times.
    sound = written(mojibake.repair(rows.distinct(), "text", corpus.review_pmi(spark, sf_dir)).filter("not garbled").drop("garbled", "restored"))
    return lookalike.differing(sound, "text").select("tbl", "id_review").distinct()


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = corpus.texts(spark, sf_dir, raw_reviews="raw_text", corrected="final_clean_text")
    return copies.groups(rows, "id_review", "text", ["tbl"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir)[0].select("tbl", "id_keep", F.col("id").alias("id_dup"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: the kept id and its number of copies."""
    return _p7(spark, sf_dir)[1]


_PLANS = {
    "fase5_records": ("emotion", lambda: F.col("emotion"), lambda: ~is_blank(F.col("final_clean_text"))),
    "complete": ("intensity", lambda: F.col("intensity").cast("int"), lambda: F.col("intensity").between(1, 4)),
}


def _p5(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """(eligible ids, needs) of each table with plans."""
    targets, out = table(spark, sf_dir, "sample_targets"), []
    for name, (field, category, valid) in _PLANS.items():
        rows = written(sampling.eligible(table(spark, sf_dir, name), "id_review", category(), F.col("source"), valid()))
        out.append((rows, sampling.needs(rows, targets.filter((F.col("tbl") == name) & (F.col("field") == field)))))
    return out


def p5_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every category needs and has."""
    (_, a), (_, b) = _p5(spark, sf_dir)
    return a.unionByName(b)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of which the drawn sample holds fewer than they need."""
    out = [sampling.shortfalls(sampling.draw(rows, sampling.quotas(rows, need)), need) for rows, need in _p5(spark, sf_dir)]
    return out[0].unionByName(out[1]).select("plan", "category").distinct()


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn ids of every plan."""
    out = [sampling.draw(rows, sampling.quotas(rows, need)) for rows, need in _p5(spark, sf_dir)]
    return out[0].unionByName(out[1])


def p5_sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn ids and distinct ones per plan and category."""
    return p5_sample(spark, sf_dir).groupBy("plan", "category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "container_spec").agg(F.max("capacity_tokens")).collect()[0][0]
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", int(capacity or 2048))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).groupBy("uid", "id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("doc_id")).distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its items and load."""
    return _p8(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n_items"), F.sum("size").alias("tokens"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, n): all documents with text are packed, each whole, only documents above the capacity in pieces, no container above it."""
    packed = written(_p8(spark, sf_dir))
    capacity = F.lit(table(spark, sf_dir, "container_spec").agg(F.max("capacity_tokens")).collect()[0][0])  # one number
    count = lambda rows, what, when: rows.agg(F.count_if(when).alias("n")).select(F.lit(what).alias("what"), "n")
    load = packed.groupBy("container").agg(F.sum("size").alias("load"))
    doc = packed.groupBy("uid").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.sum("size").alias("size"), F.max("n_tokens").alias("tokens"))
    out = count(doc, "documents", F.lit(True)).unionByName(count(doc, "not whole", (F.col("size") != F.col("tokens")) | (F.col("n") != F.col("pieces"))))
    out = out.unionByName(count(doc, "split below capacity", (F.col("n") > 1) & (F.col("tokens") <= capacity)))
    return out.unionByName(count(load, "containers above capacity", F.col("load") > capacity))


def _p9(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", n_tokens(F.col("text")).alias("size"))
    docs = written(docs)  # tokenized once, read for the sums and for the mixture
    return docs, mixing.rates(mixing.by_source(docs), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir)[1].filter("not met").select("source").distinct()


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: one row per copy."""
    docs, rate = _p9(spark, sf_dir)
    return mixing.emitted(mixing.mix(docs, rate, "doc_id"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rate = _p9(spark, sf_dir)
    return mixing.report(mixing.mix(docs, rate, "doc_id"), rate)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics and its probability of prose."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.score(docs, "text", quality.fit(docs, "text", "doc_id")).drop("text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("prose < 0.5").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_rates": p1_rates,
    "p2_found": p2_found,
    "p2_members": p2_members,
    "p2_overlap_report": p2_overlap_report,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p6_found": p6_found,
    "p6_normalized": p6_normalized,
    "p7_found": p7_found,
    "p7_copies": p7_copies,
    "p5_found": p5_found,
    "p5_needs": p5_needs,
    "p5_sample": p5_sample,
    "p5_sample_totals": p5_sample_totals,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_coverage": p8_coverage,
    "p9_found": p9_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}

_P7 = r"""
WITH x AS (
  SELECT 'raw_reviews' AS tbl, id_review AS id, raw_text AS text FROM raw_reviews
  UNION SELECT 'corrected', id_review, final_clean_text FROM corrected),
y AS (
  SELECT tbl, id, lower(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{P}$+<=>^`|~]+', '', 'g')) AS flat,
    list_filter(regexp_split_to_array(text, '[;|\n\r]+'), lambda p: regexp_matches(p, '[^\s\p{Z}]')) AS parts
  FROM x WHERE id IS NOT NULL AND len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) >= 4),
z AS (
  SELECT tbl, id, flat, CASE WHEN len(parts) >= 3 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '(?s)^[^:]+:.*[^\s\p{Z}]'))) = 0
    THEN list_sort(list_transform(parts, lambda p: lower(regexp_replace(p, '[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{P}$+<=>^`|~]+', '', 'g')))) END AS rec
  FROM y WHERE flat <> ''),
f AS (SELECT tbl, flat, min(rec) AS rec, min(id) AS lo FROM z GROUP BY ALL),
r AS (SELECT tbl, flat, min(lo) OVER (PARTITION BY tbl, rec, CASE WHEN rec IS NULL THEN flat END) AS id_keep FROM f),
m AS (SELECT DISTINCT z.tbl, id_keep, id FROM z JOIN r ON z.tbl = r.tbl AND z.flat = r.flat WHERE id <> id_keep)
"""

_P5 = """
WITH e AS (
  SELECT 'fase5_records' AS tbl, id_review, min(lower(trim(emotion, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))) AS c FROM fase5_records
  WHERE regexp_matches(final_clean_text, '[^\\s\\p{Z}]') AND regexp_matches(emotion, '[^\\s\\p{Z}]') AND id_review IS NOT NULL GROUP BY id_review
  UNION ALL
  SELECT 'complete', id_review, min(cast(cast(intensity AS integer) AS varchar)) FROM complete WHERE intensity BETWEEN 1 AND 4 AND id_review IS NOT NULL GROUP BY id_review),
n AS (SELECT tbl, count(*) AS n FROM e GROUP BY tbl),
h AS (SELECT tbl, c, count(*) AS available FROM e GROUP BY ALL),
d AS (
  SELECT plan, category, greatest(min_rows, cast(ceil(floor(coalesce(n, 0) * sample_pct / 100.0) * target_pct / 100.0) AS bigint)) AS need, coalesce(available, 0) AS available
  FROM sample_targets t LEFT JOIN n USING (tbl) LEFT JOIN h ON h.tbl = t.tbl AND h.c = lower(trim(t.category)))
"""

ORACLES: dict[str, str] = {
    "p5_found": _P5 + "SELECT DISTINCT plan, category FROM d WHERE available < need",
    "p5_sample_totals": _P5 + "SELECT plan, lower(trim(category)) AS category, least(need, available) AS n, least(need, available) AS n_ids FROM d WHERE least(need, available) > 0",
    "p8_coverage": r"SELECT 'documents' AS what, count(*) FILTER (regexp_matches(text, '[^\s]')) AS n FROM documents UNION ALL SELECT unnest(['not whole', 'split below capacity', 'containers above capacity']), 0",
    "p5_needs": _P5 + "SELECT plan, category, need, available, available >= need AS met FROM d",
    "p7_found": _P7 + "SELECT tbl, id_keep, id AS id_dup FROM m",
    "p7_copies": _P7 + "SELECT tbl, id_keep, count(*) + 1 AS n_copies FROM m GROUP BY ALL",
}
