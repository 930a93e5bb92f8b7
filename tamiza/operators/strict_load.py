"""Rows that fail to parse: strict load, anti-join, diagnosis of the remainder.

A record conforms if its quoting is well formed, its number of fields is that
of its file, and every field passes its check. Conforming records come out as
typed rows that carry their offset; the offsets that the strict load did not
return are the rejects, and only those are diagnosed.

Defined cases: a NULL record and an empty record have too few fields
(`column_count`; for a one-column layout an empty record is one empty field);
a file without a layout gives `unknown_file`; records that repeat, also under one offset, are
judged one by one and all come out; other columns of the input stay on the
rejects, whatever their names; an empty table gives two empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive loops: Java runs them without recursion, so very long fields are safe.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
WELL_QUOTED = rf"(?s)\A{_FIELD}(?:,{_FIELD})*+\z"
# Used on "," + record: a match is never empty, so the search skips nothing.
_EACH = rf"(?s),({_FIELD})"


@dataclass(frozen=True)
class Check:
    """A field: its name, its type once loaded, and the regex or predicate that valid text meets."""

    name: str
    kind: str = "string"
    pattern: str | None = None
    date: bool = False
    parts: tuple[str, str] | None = None  # separator, pattern of each part

    def valid(self, x: Column) -> Column:
        ok = F.lit(True)
        if self.pattern is not None:
            ok = ok & x.rlike(self.pattern)
        if self.date:
            ok = ok & ((x == "") | (x.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & x.try_cast("date").isNotNull()))
        if self.parts is not None:
            sep, each = self.parts
            ok = ok & F.forall(F.split(x, sep, -1), lambda p: p.rlike(each))
        return ok

    def typed(self, x: Column) -> Column:
        return x if self.kind == "string" else F.when(x != "", x).try_cast(self.kind)


#: Layouts of the two exports; the patterns are fixed values.
REVIEWS = (
    Check("id_review", pattern=r"\ASHOP_[0-9]{4,}\z"),
    Check("timestamp", "date", date=True),
    Check("raw_text"),
    Check("clean_text"),
    Check("rating", pattern=r"\ACalificación [1-5] de 5\z"),
    Check("emotion", pattern=r"\A(?:|Alegría|Tristeza|Enojo|Sorpresa|Asco|Miedo|Neutral)\z"),
    Check("intensity", "int", pattern=r"\A[1-4]?\z"),
    Check("source"),
    Check("product_id", pattern=r"\AML_PROD_[0-9]{3}\z"),
    Check("category"),
    Check("marca"),
    Check("modelo"),
)
CORRECTIONS = (
    Check("id", pattern=r"\ASHOP_[0-9]{4,}\z"),
    Check("cambios", parts=(r" \| ", r"(?sU)\A(?:Manual exacto\z|→\S)")),
)
LAYOUTS = {"raw_laptops_ml.csv": REVIEWS, "reporte_correcciones_v7.csv": CORRECTIONS}


def fields(record: Column) -> Column:
    """The unquoted fields of a well-quoted record."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_EACH), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _conforms(layout: tuple[Check, ...], f: Column) -> Column:
    return (F.size(f) == len(layout)) & reduce(lambda a, b: a & b, [c.valid(F.get(f, F.lit(i))) for i, c in enumerate(layout)])


def _conforming(df: DataFrame, layout: tuple[Check, ...], file: Column, name: str, record: Column) -> DataFrame:
    ok = (file == name) & record.rlike(WELL_QUOTED)
    rows = df.filter(ok).select("*", fields(record).alias("__fields"))
    return rows.filter(_conforms(layout, F.col("__fields")))


def load_strict(df: DataFrame, file_name: str, layout: tuple[Check, ...], offset: str = "record_id", file: str = "file_name", record: str = "record") -> DataFrame:
    """Typed rows of one file, with the offset in front as `_offset`."""
    rows = _conforming(df.select(F.col(offset).alias("__offset"), F.col(file).alias("__file"), F.col(record).alias("__record")), layout, F.col("__file"), file_name, F.col("__record"))
    return rows.select(F.col("__offset").alias("_offset"), *[c.typed(F.get(F.col("__fields"), F.lit(i))).alias(c.name) for i, c in enumerate(layout)])


def rejects(df: DataFrame, layouts: dict[str, tuple[Check, ...]] | None = None, offset: str = "record_id", file: str = "file_name", record: str = "record") -> DataFrame:
    """The rows of df that no strict load returned, with `reason`: quoting, column_count, invalid_value or unknown_file."""
    layouts = LAYOUTS if layouts is None else layouts
    # A record's offset alone may repeat, so the key also holds the file and a digest of the record.
    key = [F.col(offset).alias("__k1"), F.col(file).alias("__k2"), F.md5(F.col(record)).alias("__k3")]
    keyed = df.select(F.struct("*").alias("__row"), F.col(record).alias("__record"), *key)
    loaded = [_conforming(keyed, layout, F.col("__k2"), name, F.col("__record")).select("__k1", "__k2", "__k3") for name, layout in layouts.items()]
    done = reduce(DataFrame.union, loaded).select(*[F.col(f"__k{i}").alias(f"__d{i}") for i in (1, 2, 3)])
    left = keyed.join(done, reduce(lambda a, b: a & b, [F.col(f"__k{i}").eqNullSafe(F.col(f"__d{i}")) for i in (1, 2, 3)]), "left_anti")
    n = F.size(fields(F.col("__record")))
    expected = F.lit(None).cast("int")
    for name, layout in layouts.items():
        expected = F.when(F.col("__k2") == name, F.lit(len(layout))).otherwise(expected)
    reason = (
        F.when(F.col("__record").isNull(), F.lit("column_count"))
        .when(~F.col("__record").rlike(WELL_QUOTED), F.lit("quoting"))
        .when(expected.isNull(), F.lit("unknown_file"))
        .when(n != expected, F.lit("column_count"))
        .otherwise(F.lit("invalid_value"))
    )
    return left.select("__row", reason.alias("__reason")).select("__row.*", F.col("__reason").alias("reason"))
