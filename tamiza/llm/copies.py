"""Duplicates hidden by formatting differences.

Merkle-style: the leaves of a nested record are normalised (white space, case and
punctuation go) and digested; a node's digest is that of its children's, sorted
where order does not matter. Records are grouped by root digest together with the
full normalised structure, so a group holds only what is structurally equal;
members then meet their group by digests of 192 bits (plain texts) or 128 bits (records). A text is such a record: one leaf, or, if it is made
only of three or more `label: value` parts, an unordered node of parts. A text
that reads like a record's flat form (punctuation lost) joins that record's group.

Shuffled are digests, ids and, once, the normalised structures, pre-aggregated per
partition; a group of copies of any size is one row after the map side, and the join
of members to groups has one row per group, so AQE can split a hot one.

Defined cases: NULL, blank and punctuation-only texts and texts under `min_words`
belong to no group; rows that repeat an id count once; among equal ids the
smallest by string order is kept; very long texts are whole; an empty table gives
empty results; of the input only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiza.functions.lineage import written

#: What is ignored inside a leaf, besides case.
IGNORED = r"(?U)[\s\x1c-\x1f\x85\p{Z}\p{P}$+<=>^`|~]+"
_SEP = r"[;|\n\r]+"


def leaf(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, IGNORED, ""))


def canonical(x: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """The full normalised structure as one string; equal exactly for equal structures. Arrays are unordered unless asked; structs go by field name."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f.name.lower() + "\x02"), canonical(x[f.name], f.dataType, ordered)) for f in sorted(kind.fields, key=lambda f: f.name.lower())]
        body = F.array_join(F.array(*parts), "\x03") if parts else F.lit("")
        return F.when(x.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x04"), body, F.lit("\x05")))
    if isinstance(kind, T.ArrayType):
        each = F.transform(x, lambda e: canonical(e, kind.elementType, ordered))
        return F.when(x.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x06"), F.array_join(each if ordered else F.array_sort(each), "\x03"), F.lit("\x07")))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return canonical(F.map_entries(x), entries)
    return F.coalesce(leaf(x.cast("string")), F.lit("\x00"))


def digest(x: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """Root digest (binary, 16 bytes): leaves first, children's digests sorted at unordered nodes."""
    if isinstance(kind, T.StructType):
        parts = [digest(x[f.name], f.dataType, ordered) for f in sorted(kind.fields, key=lambda f: f.name.lower())]
        names = ",".join(sorted(f.name.lower() for f in kind.fields))
        return F.unhex(F.md5(F.when(x.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(names.encode()), *parts))))
    if isinstance(kind, T.ArrayType):
        each = F.transform(x, lambda e: F.hex(digest(e, kind.elementType, ordered)))
        return F.unhex(F.md5(F.when(x.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("["), F.array_join(each if ordered else F.array_sort(each), "")))))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return digest(F.map_entries(x), entries)
    return F.unhex(F.md5(F.coalesce(leaf(x.cast("string")), F.lit("\x00"))))


def record_parts(text: Column) -> Column:
    """The parts of a text made only of three or more `label: value` parts, else NULL."""
    parts = F.filter(F.split(text, _SEP), lambda p: p.rlike(rf"(?U)[^\s\x1c-\x1f\x85]"))
    fits = (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(rf"(?sU)\A[^:]+:.*[^\s\x1c-\x1f\x85]"))
    return F.when(F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) >= 3, F.when(fits, parts))


def _keyed(df: DataFrame, keys: list[str], id_col: str, text: str, min_words: int) -> DataFrame:
    """Keys, id and the digests of the flat and the record form of every text that can have copies."""
    kind = T.ArrayType(T.StringType())
    rows = df.select(*keys, F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    enough = F.regexp_count("__text", F.lit(rf"(?U)[^\s\x1c-\x1f\x85]+")) >= min_words
    rows = rows.filter(F.col("__id").isNotNull() & enough).withColumn("__flat", leaf(F.col("__text"))).filter(F.col("__flat") != "")
    rows = rows.withColumn("__parts", record_parts(F.col("__text")))
    return rows.select(
        *keys,
        "__id",
        "__flat",
        F.unhex(F.md5("__flat")).alias("__f"),
        F.xxhash64("__flat").alias("__x"),
        F.when(F.col("__parts").isNotNull(), digest(F.col("__parts"), kind)).alias("__r"),
        F.when(F.col("__parts").isNotNull(), canonical(F.col("__parts"), kind)).alias("__s"),
    )


def groups(df: DataFrame, id_col: str, text: str, keys: list[str] | None = None, min_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, kept): (*keys, id, id_keep) of every id that is not kept, and (*keys, id_keep, n_copies) of every group of two ids or more."""
    keys = keys or []
    # Read twice below, and normalising and digesting is what costs: done once.
    rows = written(_keyed(df, keys, id_col, text, min_words))
    # Structurally equal flat texts: one row each, combined on the map side. Plain texts are compared in full here.
    flat = rows.groupBy(*keys, "__f", "__x", "__flat").agg(
        F.min("__r").alias("__r"), F.max("__r").alias("__r2"), F.min("__s").alias("__s"), F.min("__id").alias("__lo"), F.max("__id").alias("__hi"), F.max(F.col("__r").isNull()).alias("__plain")
    )
    flat = written(flat.drop("__flat"))
    root = F.coalesce("__r", "__f")
    # Records meet in another order: compared in full by their sorted structure.
    several = (
        flat.groupBy(*keys, root.alias("__root"), F.when(F.col("__r").isNull(), F.col("__x")).alias("__rx"), "__s")
        .agg(F.min("__lo").alias("id_keep"), F.max("__hi").alias("__last"))
        .filter(F.col("id_keep") < F.col("__last"))
    )
    to = several.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], F.col("__root").alias("__key"), F.col("__rx").alias("__kx"), "id_keep")
    # Flat texts that read like a record, and records that read alike but divide differently, follow that record.
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    linked = flat.filter(F.col("__r").isNotNull() & (F.col("__plain") | (F.col("__r") != F.col("__r2"))))
    linked = linked.join(to.filter(F.col("__kx").isNull()), [F.col("__r") == F.col("__key"), *same]).select(
        *[f"__k_{i}" for i in range(len(keys))], F.explode(F.array(F.struct(F.col("__f").alias("k"), F.col("__x").alias("x")), F.struct(F.col("__r2").alias("k"), F.lit(None).cast("long").alias("x")))).alias("__v"), "__r", "id_keep"
    )
    linked = linked.filter(F.col("__v.k") != F.col("__r")).select(*[f"__k_{i}" for i in range(len(keys))], F.col("__v.k").alias("__key"), F.col("__v.x").alias("__kx"), "id_keep")
    to = to.unionByName(linked)
    key, kx = F.coalesce("__r", "__f").alias("__m"), F.when(F.col("__r").isNull(), F.col("__x")).alias("__mx")
    hit = rows.select(*keys, "__id", key, kx).join(to, [F.col("__m") == F.col("__key"), F.col("__mx").eqNullSafe(F.col("__kx")), *same])
    members = hit.select(*keys, F.col("__id").alias("id"), "id_keep").filter(F.col("id") != F.col("id_keep")).distinct()
    kept = members.groupBy(*keys, "id_keep").agg((F.count("*") + 1).alias("n_copies"))
    return members, kept
