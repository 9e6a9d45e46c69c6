"""One plan for all columns: tables become cells, cells become frequencies of values.

Everything about single columns and about shared values of columns follows from the frequencies: one shuffle on (column, value), with
partial counts before it, in place of a query per column or pair of columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import sql_clean

_FAMILIES = (
    (T.BooleanType, "bool"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "float"),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime"),
    (T.StringType, "string"),
)


def family(kind: T.DataType) -> str:
    return next((f for t, f in _FAMILIES if isinstance(kind, t)), "other")


def key(table: Column, column: Column) -> Column:
    return F.concat(table, F.lit("."), column)


#: Text of more characters is shuffled and compared as its SHA-256.
LONG_TEXT = 256


def small(df: DataFrame) -> DataFrame:
    """A frame with a few rows per column, without its lineage: plans that use it several times stay small."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _text(c: Column, clean: Callable[[Column], Column]) -> Column:
    """(v, len) of a value: its cleaned text, or the digest of a long one, and the text's length."""
    v = clean(c)
    return F.struct(F.when(F.length(v) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(v.cast("binary"), 256))).otherwise(v).alias("v"), F.length(v).alias("len"))


def _names(tables: dict[str, DataFrame]) -> Column:
    """What a column's number stands for. So a row that is shuffled holds a number in place of names."""
    of = lambda t, i, f: F.struct(F.lit(t).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.lit(family(f.dataType)).alias("family"))
    return F.get(F.array(*(of(t, i, f) for t, df in tables.items() for i, f in enumerate(df.schema.fields))), F.col("cid"))


def _raw_cells(tables: dict[str, DataFrame], kinds: Callable[[T.DataType], str | None]) -> dict[str, DataFrame]:
    """(cid, x) for every cell, by the type that x is held in: ``kinds`` gives it for a column's type, and None for those that become text."""
    parts: dict[str, list[DataFrame]] = {}
    cid = 0
    for df in tables.values():
        mine: dict[str, list[Column]] = {}
        for f in df.schema.fields:
            kind = kinds(f.dataType) or "string"
            mine.setdefault(kind, []).append(F.struct(F.lit(cid).alias("cid"), F.col(f"`{f.name}`").cast(kind).alias("x")))
            cid += 1
        for kind, columns in mine.items():
            parts.setdefault(kind, []).append(df.select(F.inline(F.array(*columns))))
    return {k: reduce(DataFrame.unionByName, p) for k, p in parts.items()}


def _counted_as(kind: T.DataType) -> str | None:
    """The type that a column's values are counted in before they become text: one whose different values have different texts."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    return kind.simpleString() if isinstance(kind, (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) else None


def cells(tables: dict[str, DataFrame], clean: Callable[[Column], Column] = sql_clean) -> DataFrame:
    """(table_name, column_name, ordinal, family, v, len) for every cell; v is the cleaned text, or the digest of a long one, and len the text's length."""
    (raw,) = _raw_cells(tables, lambda _: "string").values()
    return raw.select(_names(tables).alias("c"), _text(F.col("x"), clean).alias("t")).select("c.*", "t.*")


def frequencies(tables: dict[str, DataFrame], clean: Callable[[Column], Column] = sql_clean) -> DataFrame:
    """(table_name, column_name, ordinal, family, v, len, cnt): how often each column holds each value; v is null for nulls.

    Numbers, times and booleans are counted as they are, and only different ones become text; ``clean`` has to keep those apart, but for floats, which are counted again by their text
    (NaN may be a null; 0.0 and -0.0 are one value). The examples, smallest values and ties that others take from v are digests where the text has more than LONG_TEXT characters.
    """
    out = []
    for kind, raw in _raw_cells(tables, _counted_as).items():
        if kind == "string":
            raw = raw.select("cid", _text(F.col("x"), clean).alias("t")).select("cid", "t.*")
            out.append(raw.groupBy("cid", "v").agg(F.max("len").alias("len"), F.count("*").alias("cnt")))  # equal values have equal lengths
            continue
        counted = raw.groupBy("cid", "x").agg(F.count("*").alias("cnt")).select("cid", _text(F.col("x").cast("string"), clean).alias("t"), "cnt").select("cid", "t.*", "cnt")
        out.append(counted.groupBy("cid", "v").agg(F.max("len").alias("len"), F.sum("cnt").alias("cnt")) if kind in ("float", "double") else counted)
    return reduce(DataFrame.unionByName, out).select(_names(tables).alias("c"), "v", "len", "cnt").select("c.*", "v", "len", "cnt")
