"""Stages with an external model or tool, which is injected as a callable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamiza.functions.text import alnum_signature, clip_for_model, is_blank, let

PENDING, SHORT, FAILED, BLOCKED, BAD_KEY = "PENDIENTE_PROCESAR", "[CORTO_O_VACIO]", "[ERROR_INESPERADO]", "[BLOQUEADO_POR_SEGURIDAD]", "ERROR_CLAVE_INVALIDA"
REPLY = "struct<respuestas: array<struct<id: string, texto_limpio: string>>>"


class InvalidKey(Exception):
    """Raised by a normaliser whose credentials are refused: the run stops asking."""


def normalize_rows(df: DataFrame, column: str, normalizer: Callable[[str], str] | None = None, name: str = "clean_text", attempts: int = 3, wait: float = 10.0) -> DataFrame:
    """Blank texts become "", others what the normaliser says; after the last failed attempt the text itself. Identity by default."""
    call = normalizer or (lambda t: t)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        refused = False

        def one(t: str | None) -> str:
            nonlocal refused
            if t is None or not t.strip():
                return ""
            if refused:
                return BAD_KEY
            for k in range(attempts):
                try:
                    return call(t)
                except InvalidKey:
                    refused = True
                    return BAD_KEY
                except Exception:
                    if k + 1 < attempts:
                        time.sleep(wait)
            return t

        for s in parts:
            yield s.map(one)

    return df.withColumn(name, run(F.col(column)))


def batches(df: DataFrame, column: str, id_col: str = "id_review", size: int = 30, buckets: int | None = None) -> DataFrame:
    """(bucket, batch, lote): requests of at most `size` texts as JSON. Texts too short for the model are left out. Rows are numbered within hash buckets of bounded size, so no task orders the table."""
    text = clip_for_model(F.col(column))
    rows = df.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).filter(F.col("text") != SHORT)
    n = buckets or max(1, -(-rows.count() // (size * 100)))  # a hundred requests a bucket, however many rows there are
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"), F.lit(n)))
    k = F.row_number().over(Window.partitionBy("bucket").orderBy("id", "text"))
    rows = rows.withColumn("batch", F.floor((k - 1) / size))
    return rows.groupBy("bucket", "batch").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("lote"))).alias("lote"))


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """(id, texto_limpio) of replies in JSON; an empty text is NULL, a broken reply gives nothing."""
    r = F.explode(F.coalesce(F.from_json(F.col(column), REPLY)["respuestas"], F.array().cast("array<struct<id: string, texto_limpio: string>>")))
    return replies.select(r.alias("r")).select("r.id", F.when(F.col("r.texto_limpio") != "", F.col("r.texto_limpio")).alias("texto_limpio"))


def ask(requests: DataFrame, call: Callable[[str], dict[str, str]], column: str = "lote") -> DataFrame:
    """(id, texto_limpio): a failed request is repeated item by item, a failing item is marked as blocked."""
    import json

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[tuple[str, str | None]] = []
            for text in p[column]:
                items = json.loads(text)["lote"]
                try:
                    got = call(text)
                except Exception:
                    got = {}
                    for it in items:
                        try:
                            got |= call(json.dumps({"lote": [it]}, ensure_ascii=False))
                        except Exception:
                            got[it["id"]] = BLOCKED
                out += [(it["id"], got.get(it["id"]) or None) for it in items]
            yield pd.DataFrame(out, columns=["id", "texto_limpio"])

    return requests.select(column).mapInPandas(run, "id string, texto_limpio string")


def failures(asked: DataFrame) -> DataFrame:
    """(id, outcome) of the items a run could not have answered: `blocked` or `empty`; what a log of failed calls holds."""
    outcome = F.when(F.col("texto_limpio") == BLOCKED, "blocked").when(F.col("texto_limpio").isNull(), "empty")
    return asked.select("id", outcome.alias("outcome")).filter("outcome IS NOT NULL")


def run_batches(df: DataFrame, column: str, call: Callable[[str], dict[str, str]], path: str, id_col: str = "id_review", size: int = 30) -> DataFrame:
    """Df with `clean_text`. Replies are appended to a table at `path`, and a run that is repeated or resumed asks only for rows that have none there."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    todo = df.join(spark.read.parquet(path).select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti") if done else df
    ask(batches(todo, column, id_col, size), call).write.mode("append").parquet(path)
    return join_replies(df, spark.read.parquet(path), column, id_col)


def join_replies(df: DataFrame, replies: DataFrame, column: str, id_col: str = "id_review", name: str = "clean_text") -> DataFrame:
    """Each row its reply; short texts their mark, rows without one the error mark."""
    one = replies.groupBy(F.col("id").alias("__id")).agg(F.max("texto_limpio").alias("__t"))
    rows = df.join(one, F.col(id_col).cast("string") == F.col("__id"), "left")
    short = clip_for_model(F.col(column)) == SHORT
    return rows.withColumn(name, F.when(short, F.lit(SHORT)).otherwise(F.coalesce("__t", F.lit(FAILED)))).drop("__id", "__t")


def mark_pending(df: DataFrame, column: str = "clean_text") -> DataFrame:
    """P13's first step."""
    return df.withColumn(column, F.coalesce(column, F.lit(PENDING)))


def infer_emotion(df: DataFrame, text: str, model: Callable[[list[str]], list[str]], name: str = "base_emotion") -> DataFrame:
    """An injected model's labels, batch by batch, mapped to emotions."""
    from tamiza.operators.emotion import label

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(model(s.fillna("").tolist()), dtype=object)

    return df.withColumn(name, label(run(F.col(text))))


#: Issue types whose first replacement may be applied. Fixed values.
SAFE_ISSUES = ["whitespace", "typographical", "punctuation", "capitalization"]


def apply_matches(text: Column, matches: Column, safe: list[str] | None = None) -> Column:
    """struct(text, applied, skipped, total): from right to left, the first replacement of safe issues that keeps letters and digits. matches: array of struct(offset, error_length, issue_type, replacements), offsets from 0."""
    safe = SAFE_ISSUES if safe is None else safe
    none = F.struct(text.alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"))

    def step(s: Column, m: Column) -> Column:
        was = F.substr(s["text"], m["offset"] + 1, m["error_length"])
        to = F.get(m["replacements"], F.lit(0))
        ok = F.coalesce(m["issue_type"].isin(*safe) & to.isNotNull() & (alnum_signature(was) == alnum_signature(to)), F.lit(False))
        new = F.concat(F.substr(s["text"], F.lit(1), m["offset"]), to, F.substr(s["text"], m["offset"] + m["error_length"] + 1))
        return F.struct(F.when(ok, new).otherwise(s["text"]).alias("text"), (s["applied"] + ok.cast("int")).alias("applied"), (s["skipped"] + (~ok).cast("int")).alias("skipped"))

    done = F.aggregate(F.sort_array(F.coalesce(matches, F.array().cast("array<struct<offset:int,error_length:int,issue_type:string,replacements:array<string>>>")), asc=False), none, step)
    return F.when(is_blank(text), F.struct(text.alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"), F.lit(0).alias("total"))).otherwise(
        let(done, lambda d: F.struct(d["text"].alias("text"), d["applied"].alias("applied"), d["skipped"].alias("skipped"), (d["applied"] + d["skipped"]).alias("total")))
    )
