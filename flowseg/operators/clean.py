"""Cleaning of raw log lines and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowseg.functions.columns import quoted
from flowseg.functions.tables import is_small, lookup_join, materialize, with_row_index

MISSING = "-"


def drop_comments(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep the lines that do not start with ``#``."""
    return lines.filter(~F.col(column).startswith("#"))


def split_fields(lines: DataFrame, column: str = "value", out: str = "fields") -> DataFrame:
    """Split on runs of tabs and spaces, after trimming spaces at both ends."""
    return lines.withColumn(out, F.split(F.trim(F.col(column)), r"\s+"))


def keep_arity(lines: DataFrame, n: int, column: str = "fields") -> tuple[DataFrame, DataFrame]:
    """Rows with exactly ``n`` fields, and the rejected rest."""
    whole = F.size(column) == n
    return lines.filter(whole), lines.filter(~whole)


def sentinel_to_null(value: Column, sentinel: str = MISSING) -> Column:
    return F.nullif(value, F.lit(sentinel))


def default_value(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def project_schema(
    lines: DataFrame,
    schema: T.StructType,
    column: str = "fields",
    defaults: dict[str, str] | None = None,
) -> DataFrame:
    """Positional fields to named, typed columns; values that do not parse become NULL."""
    defaults = defaults or {}
    out = []
    for i, field in enumerate(schema.fields):
        value = sentinel_to_null(F.get(F.col(column), F.lit(i)))
        if field.name in defaults:
            value = default_value(value, defaults[field.name])
        out.append(value.try_cast(field.dataType).alias(field.name))
    return lines.select(*out)


def binary_label(df: DataFrame, column: str, positive: str, out: str | None = None) -> DataFrame:
    """1 where the label equals ``positive`` exactly, else 0 (also for NULL)."""
    hit = F.when(quoted(column) == positive, 1).otherwise(0).cast("int")
    return df.withColumn(out or column, hit)


def add_uid(df: DataFrame, out: str = "uid", columns: list[str] | None = None, scan: bool = False) -> DataFrame:
    """A content-based row id, the same on every run and under any partitioning.

    The id is the md5 of the given columns plus the occurrence number among
    identical rows. Only hashes and places are looked at to find what occurs more
    than once, and only its further copies are numbered, by a distributed index, so
    a row with very many copies is not numbered by one task. The rows
    themselves are scanned once and stay where they are while the numbers are few
    enough to be broadcast (checked); beyond that they are joined by place.

    Identical rows are interchangeable, so it does not matter which of them gets
    which number, but a row's place must not change between evaluations: pass
    ``scan=True`` for a file scan, otherwise the rows are written out first.
    """
    columns = columns or df.columns
    hashed = F.md5(F.to_json(F.struct(*[quoted(c) for c in columns]), {"ignoreNullFields": "false"}))
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    if not scan:
        placed = materialize(placed)
    narrow = placed.select("_at", hashed.alias("_h"))
    twice = narrow.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = narrow.join(materialize(twice), "_h").select("_h", "_at", "_n")
    ranked = materialize(with_row_index(copies, "_h", "_at", name="_i"))
    firsts = materialize(ranked.groupBy("_h").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c")))
    numbered = lookup_join(ranked.select("_h", "_at", "_i"), firsts, "_h", "_c", position="_at").select("_at", (F.col("_i") - F.col("_first")).alias("_k"))
    numbers = materialize(numbered.filter("_k > 0"))
    found = placed.join(F.broadcast(numbers) if is_small(numbers) else numbers, "_at", "left")
    return found.withColumn(out, F.concat_ws("-", hashed, F.coalesce("_k", F.lit(0)).cast("string"))).drop("_at", "_k")
