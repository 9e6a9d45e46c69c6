"""Dates in text by induced formats: values are reduced to shape masks, the order of day and month is induced once for each mask, and values are parsed by it.

A mask writes digits as 9 and letters as a. Only values of the shape of a date get one, so a column has few. Where a mask leaves open which of two numbers is the day, the ranges of the
column's values decide: a first number over 12 makes it day-first, a second one month-first; both, value by value; neither, the configured preference.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of months; three letters or more of one count.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?)?"
_SEP = r"[-/. ]"
#: Shapes of dates, each with or without a time behind. Of bare numbers, years and eight digits count, from 1000 on.
_SHAPE = (
    rf"^(?:\d{{4}}{_SEP}\d{{1,2}}{_SEP}\d{{1,2}}{_TIME}|\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}\d{{4}}{_TIME}"
    rf"|\d{{1,2}}[-/. ][A-Za-z]{{3,9}}[-/., ]{{1,2}}\d{{4}}{_TIME}|[A-Za-z]{{3,9}}[. ]{{1,2}}\d{{1,2}},? \d{{4}}{_TIME}|[12]\d{{3}}|[12]\d{{7}}{_TIME})$"
)
#: Orders of a mask: mixed ones take the day first where it can't be the month.
YMD, DMY, MDY, MIXED = "ymd", "dmy", "mdy", "mixed"


def date_mask(v: Column) -> Column:
    """The shape of a stripped text that may be a date; null for others."""
    return F.when((F.length(v) <= 40) & v.rlike(_SHAPE), F.translate(v, digits + ascii_letters, "9" * len(digits) + "a" * len(ascii_letters)))


def _tokens(v: Column) -> Column:
    """Numbers and words of a date, without the marks of times."""
    return F.regexp_extract_all(v, F.lit("[0-9]+|[A-Za-z]{3,}"), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _month(t: Column) -> Column:
    """The number of a month, given by number or name."""
    i = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.lower(F.substring(t, 1, 3)))
    return F.when(t.rlike("^[0-9]"), t.try_cast("int")).when(F.get(F.array(*map(F.lit, MONTHS)), (i - 1).cast("int")).startswith(F.lower(t)), i.cast("int"))


#: Shapes by what comes first: a bare number, the year, a month's name, a day before a month's name, or two numbers in open order.
_BARE, _YEAR, _NAME, _DAY, _OPEN = range(5)


def _parts(v: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of a date's parts: open (whether day and month may change places), a and b (the first two numbers), y, m, d as day-first has them, and h, i, s."""
    number = lambda c: c.try_cast("int")
    shape = F.when(v.rlike("^[0-9]{4}$|^[0-9]{8}($|[T ])"), _BARE).when(v.rlike("^[0-9]{4}[^0-9]"), _YEAR).when(v.rlike("^[A-Za-z]"), _NAME).when(v.rlike("^[0-9]+.[A-Za-z]"), _DAY).otherwise(_OPEN)
    half = F.when(v.rlike("[Pp][Mm](Z|[+-].*)?$"), "pm").when(v.rlike("[Aa][Mm](Z|[+-].*)?$"), "am")
    seconds = v.rlike("[0-9]:[0-9]{2}:[0-9]{2}")

    def of(x: Column) -> Column:
        t, k = x["t"], x["k"]
        at = lambda i: F.get(t, F.lit(i))
        bare = lambda first, n: F.when(F.length(at(0)) == 8, number(F.substring(at(0), first, n))).otherwise(1)
        clock = lambda i: F.coalesce(number(F.get(t, F.when(k == _BARE, 1).otherwise(3) + i)), F.lit(0))
        hour = F.when((x["half"] == "pm") & (clock(0) < 12), clock(0) + 12).when((x["half"] == "am") & (clock(0) == 12), 0).otherwise(clock(0))
        return F.struct(
            (k == _OPEN).alias("open"),
            number(at(0)).alias("a"),
            number(at(1)).alias("b"),
            F.when(k == _BARE, number(F.substring(at(0), 1, 4))).when(k == _YEAR, number(at(0))).otherwise(number(at(2))).alias("y"),
            F.when(k == _BARE, bare(5, 2)).when(k == _NAME, _month(at(0))).otherwise(_month(at(1))).alias("m"),
            F.when(k == _BARE, bare(7, 2)).when(k == _YEAR, number(at(2))).when(k == _NAME, number(at(1))).otherwise(number(at(0))).alias("d"),
            hour.alias("h"),
            clock(1).alias("i"),
            F.when(x["seconds"], clock(2)).otherwise(0).alias("s"),
        )

    return _let(F.struct(_tokens(v).alias("t"), shape.alias("k"), half.alias("half"), seconds.alias("seconds")), lambda x: _let(of(x), use))


def _timestamp(p: Column, month_first: Column) -> Column:
    """What the parts say, null if there is no such day or time. ``month_first`` counts where the order is open."""
    swap = p["open"] & month_first
    return F.try_make_timestamp(p["y"], F.when(swap, p["a"]).otherwise(p["m"]), F.when(swap, p["b"]).otherwise(p["d"]), p["h"], p["i"], p["s"].cast("decimal(8,6)"))


def parse_date(v: Column, order: Column | None = None, day_first: bool = False) -> Column:
    """A stripped text as a timestamp, null if it is none. ``order`` is the induced one; null, or without it, the text itself decides, and ``day_first`` where it can't. Zones are left out."""

    def of(p: Column) -> Column:
        lone = F.when(p["a"] > 12, False).when(p["b"] > 12, True).otherwise(not day_first)
        return _timestamp(p, lone if order is None else F.when(order == MDY, True).when(order == DMY, False).otherwise(lone))

    return F.when(date_mask(v).isNotNull(), _parts(v, of))


def date_formats(values: DataFrame, by: list[str], day_first: bool = False) -> DataFrame:
    """For each group ``by`` and mask of ``values`` (by, v stripped, cnt): order, cells, dates (cells that are dates in that order), date_min, date_max. Few rows for a column."""
    seen = values.withColumn("mask", date_mask(F.col("v"))).where("mask is not null")
    both = lambda p: F.struct(p["open"].alias("open"), F.when(p["open"], p["a"]).alias("a"), F.when(p["open"], p["b"]).alias("b"), _timestamp(p, F.lit(False)).alias(DMY), _timestamp(p, F.lit(True)).alias(MDY))
    seen = seen.select(*by, "mask", "cnt", _parts(F.col("v"), both).alias("p")).select(*by, "mask", "cnt", "p.*")
    seen = seen.withColumn(MIXED, F.when((F.col("a") > 12) | (F.lit(day_first) & (F.col("b") <= 12)), F.col(DMY)).otherwise(F.col(MDY)))
    kinds = (DMY, MDY, MIXED)
    sums = [f(k).alias(f"{k}_{n}") for k in kinds for n, f in (("dates", lambda k: F.sum(F.when(F.col(k).isNotNull(), F.col("cnt")).otherwise(0))), ("min", F.min), ("max", F.max))]
    g = seen.groupBy(*by, "mask").agg(F.sum("cnt").alias("cells"), F.max("open").alias("open"), F.max("a").alias("a"), F.max("b").alias("b"), *sums)
    order = F.when(~F.col("open"), YMD).when((F.col("a") > 12) & (F.col("b") > 12), MIXED).when(F.col("a") > 12, DMY).when(F.col("b") > 12, MDY).otherwise(DMY if day_first else MDY)
    g = g.withColumn("order", order)
    pick = lambda n: F.when(F.col("order") == MIXED, F.col(f"{MIXED}_{n}")).when(F.col("order") == MDY, F.col(f"{MDY}_{n}")).otherwise(F.col(f"{DMY}_{n}"))
    return g.select(*by, "mask", "order", "cells", pick("dates").alias("dates"), pick("min").alias("date_min"), pick("max").alias("date_max"))
