"""CSV and file sources and sinks."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiza.operators.encoding import recode

#: What the typed readers take for NULL; the string readers keep it.
NA_TOKENS = ["", "NA", "N/A", "None", "null", "NULL", "nan", "NaN", "n/a", "<NA>", "#N/A", "-nan", "-NaN"]
TYPED_ENCODINGS = ("utf-8-sig", "utf-8", "latin1")
STRING_ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin1", "cp850", "cp437")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def starts_with_mark(spark: SparkSession, path: str) -> bool:
    """Three bytes of the first file: the line reader drops the mark, so it can't be seen there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    own = list(found) if found else []
    if own and own[0].isDirectory():
        own = [f for f in fs.listStatus(own[0].getPath()) if not f.getPath().getName().startswith(("_", "."))]
    own = sorted((f for f in own if f.getLen() >= 3), key=lambda f: f.getPath().getName())
    if not own:
        return False
    stream = fs.open(own[0].getPath())
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = STRING_ENCODINGS) -> str:
    """The first encoding that decodes every line. Lines are checked where they are read; only flags come back."""
    raw = spark.read.text(path)  # undecoded bytes
    b = F.hex(F.col("value").cast("binary"))
    got = raw.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(b.rlike("^(?:..)*(?:81|8D|8F|90|9D)")), F.lit(False)).alias("undefined"),
    ).collect()[0]
    fits = {"utf-8-sig": got["utf8"] and starts_with_mark(spark, path), "utf-8": got["utf8"], "cp1252": not got["undefined"], "latin1": True}
    for e in encodings:
        if fits.get(e, True):
            return e
    raise ValueError(f"no encoding of {encodings} reads {path}")


def read_strings(spark: SparkSession, path: str, encodings: tuple[str, ...] = STRING_ENCODINGS) -> tuple[DataFrame, str]:
    """All columns as strings, empty stays empty, and the encoding that was used."""
    enc = detect_encoding(spark, path, encodings)
    charset = "UTF-8" if enc.startswith("utf-8") else "ISO-8859-1"
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=charset, nullValue="\x00", emptyValue="")
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    if enc in ("cp1252", "cp850", "cp437"):  # read byte by byte, then as the page has it
        df = df.select(*[F.coalesce(recode(df[c], "latin-1", enc), df[c]).alias(c) for c in df.columns])
    return df.na.fill(""), enc


def read_typed(spark: SparkSession, path: str, schema: T.StructType | None = None, missing_ok: bool = False) -> DataFrame | None:
    """As a reader that infers types: NA tokens are NULL, and columns take the schema's types. A missing path gives None if that is allowed."""
    if missing_ok and not exists(spark, path):
        return None
    df, _ = read_strings(spark, path, TYPED_ENCODINGS)
    df = df.select(*[F.when(~df[c].isin(NA_TOKENS), df[c]).alias(c) for c in df.columns])
    if schema is None:
        return df
    kinds = {f.name: f.dataType for f in schema.fields}
    return df.select(*[df[c].try_cast(kinds[c]).alias(c) if c in kinds else df[c] for c in df.columns])


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "errorifexists") -> None:
    """K1, K2: with header; the mark goes in front of each file's header."""
    out = df.toDF(*[("﻿" if bom and i == 0 else "") + c for i, c in enumerate(df.columns)])
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table that is there already is only replaced if that is asked for."""
    if not overwrite and exists(df.sparkSession, path):
        raise FileExistsError(path)
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def replace(df: DataFrame, path: str, backup: str = "timestamp") -> str | None:
    """K3, K6, K7: writes beside the table, then renames, so a reader never sees half of it. backup: timestamp, once (kept if there is one), replace, none. Returns the backup's path."""
    spark = df.sparkSession
    tmp = f"{path.rstrip('/')}.tmp-{time.time_ns()}"
    df.write.parquet(tmp)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    kept = None
    if fs.exists(at(path)):
        kept = f"{path.rstrip('/')}.backup" + (f"-{time.strftime('%Y%m%d_%H%M%S')}" if backup == "timestamp" else "")
        if backup == "none" or (backup == "once" and fs.exists(at(kept))):
            fs.delete(at(path), True)
            kept = kept if backup == "once" else None
        else:
            if backup == "replace" and fs.exists(at(kept)):
                fs.delete(at(kept), True)
            if not fs.rename(at(path), at(kept)):
                raise OSError(f"{path} could not be kept as {kept}")
    if not fs.rename(at(tmp), at(path)):
        raise OSError(f"{tmp} could not be renamed to {path}")
    return kept


def pinned_input(spark: SparkSession, path: str) -> str:
    """K7: a rerun reads the backup where there is one."""
    return f"{path.rstrip('/')}.backup" if exists(spark, f"{path.rstrip('/')}.backup") else path


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """K4, K5: one batch's rows under its number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def pending(df: DataFrame, done: DataFrame | None, id_col: str = "id_review") -> DataFrame:
    """Rows that no earlier run has finished."""
    return df if done is None else df.join(done.select(id_col).distinct(), id_col, "left_anti")


def change_log(before: Column, after: Column, id_col: Column, df: DataFrame) -> DataFrame:
    """K8: (ID, ANTES, DESPUES) of changed rows."""
    return df.filter(~before.eqNullSafe(after)).select(id_col.alias("ID"), before.alias("ANTES"), after.alias("DESPUES"))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint): first twelve hex digits of each file's md5."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.md5("content"), 1, 12).alias("fingerprint"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P17."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)
