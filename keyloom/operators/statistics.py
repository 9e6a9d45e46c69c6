"""Statistics of numbers and dates from frequencies: weighted moments and exact weighted quantiles of all columns in the same passes.

Quantiles are found by narrowing: a target's rank lies in a bracket of values; while a bracket holds more than LIMIT different values, one pass counts it in BINS parts of equal width, for all
columns and targets at once, and the part with the rank, from its smallest to its largest value, is the next bracket. What is left, LIMIT values at most, is ranked. So no task ever holds
a column's values, and the driver holds some numbers for each column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cells import small

#: Different values that one task ranks; parts that a bracket is counted in.
LIMIT, BINS = 100_000, 1024
QUARTILES = (0.25, 0.5, 0.75)
_COLUMN = ["table_name", "column_name"]


def ranked_values(values: DataFrame, ranks: dict[tuple[str, str], set[int]], sizes: dict[tuple[str, str], tuple[int, float, float]], limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """(table_name, column_name, rank, x): the values at ``ranks`` (from 0, repeats counted) of ``values`` (table_name, column_name, x, cnt). ``sizes``: of each column its number of different values, the smallest and the largest.

    Values may come in several rows; the number in ``sizes`` and the limit then count rows, until a bracket holds one value."""
    spark = values.sparkSession
    # a target: column, rank, what lies below its bracket, the bracket's number of values and bounds
    targets = [(c, r, 0, *sizes[c]) for c, rs in ranks.items() for r in sorted(rs)]
    while wide := sorted({(c, lo, hi) for c, _, _, d, lo, hi in targets if d > limit and lo < hi}):
        frame = F.broadcast(spark.createDataFrame([(*c, lo, hi) for c, lo, hi in wide], "table_name string, column_name string, lo double, hi double"))
        part = F.when(F.col("x") >= F.col("hi"), bins).otherwise(F.width_bucket("x", "lo", "hi", F.lit(bins)))  # targets are few: brackets as broadcast rows
        counted = values.join(frame, _COLUMN).where("x between lo and hi").groupBy(*_COLUMN, "lo", "hi", part.alias("bin"))
        found: dict[tuple, list] = {}
        for r in counted.agg(F.sum("cnt").alias("n"), F.count("*").alias("d"), F.min("x").alias("a"), F.max("x").alias("b")).collect():  # BINS for a bracket at most
            found.setdefault(((r[0], r[1]), r["lo"], r["hi"]), []).append((r["bin"], r["n"], r["d"], r["a"], r["b"]))
        narrowed = []
        for c, rank, below, d, lo, hi in targets:
            if (c, lo, hi) in found:
                for _, n, d, a, b in sorted(found[c, lo, hi]):  # noqa: B007
                    if below + n > rank:
                        break
                    below += n
                lo, hi = a, b
            narrowed.append((c, rank, below, d, lo, hi))
        targets = narrowed
    frame = F.broadcast(spark.createDataFrame([(*c, rank, below, lo, hi) for c, rank, below, _, lo, hi in targets], "table_name string, column_name string, rank long, below long, lo double, hi double"))
    near = values.join(F.broadcast(frame.select(*_COLUMN, "lo", "hi", "below").distinct()), _COLUMN).where("x between lo and hi").groupBy(*_COLUMN, "lo", "hi", "below", "x").agg(F.sum("cnt").alias("cnt"))
    upto = near.withColumn("upto", F.col("below") + F.sum("cnt").over(Window.partitionBy(*_COLUMN, "lo", "hi", "below").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = upto.join(frame, [*_COLUMN, "lo", "hi", "below"]).where("upto > rank")
    return hit.groupBy(*_COLUMN, "rank").agg(F.min("x").alias("x"))


def numeric_statistics(freq: DataFrame, quantiles: Sequence[float] = QUARTILES, limit: int = LIMIT) -> DataFrame:
    """Of each int and float column with a number: num_count, num_mean, num_min, num_max, num_std_dev (of a sample), num_skewness (corrected for bias), num_quantiles (interpolated), as weighted by counts."""
    x = F.col("v").try_cast("double")
    values = freq.where(F.col("family").isin("int", "float") & F.col("v").isNotNull()).select(*_COLUMN, x.alias("x"), "cnt").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    n = F.sum("cnt").alias("n")
    base = small(values.groupBy(*_COLUMN).agg(n, F.count("*").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x") * F.col("cnt")).alias("s")))
    base = base.withColumn("mean", F.col("s") / F.col("n"))
    gap = F.col("x") - F.col("mean")
    power = lambda k: F.sum(F.pow(gap, k) * F.col("cnt"))
    moments = small(values.join(F.broadcast(base.select(*_COLUMN, "mean")), _COLUMN).groupBy(*_COLUMN).agg(power(2).alias("m2"), power(3).alias("m3")))
    rows = {(r["table_name"], r["column_name"]): r for r in base.collect()}  # a row per column
    at = {c: [(q, q * (r["n"] - 1)) for q in quantiles] for c, r in rows.items()}
    ranks = {c: {f(p) for _, p in ps for f in (math.floor, math.ceil)} for c, ps in at.items()}
    found: dict[tuple, float] = {}
    if ranks:
        found = {(r[0], r[1], r["rank"]): r["x"] for r in ranked_values(values, ranks, {c: (r["d"], r["lo"], r["hi"]) for c, r in rows.items()}, limit).collect()}  # two for each quantile and column
    between = lambda c, p: found[*c, math.floor(p)] + (p - math.floor(p)) * (found[*c, math.ceil(p)] - found[*c, math.floor(p)])
    told = freq.sparkSession.createDataFrame([(*c, [between(c, p) for _, p in ps]) for c, ps in at.items()], "table_name string, column_name string, num_quantiles array<double>")
    k = F.col("n").cast("double")
    deviation = F.when(k > 1, F.sqrt(F.col("m2") / (k - 1))).otherwise(0.0)
    skew = F.when((k > 2) & (F.col("m2") > 0), F.col("m3") / k / F.pow(F.col("m2") / k, F.lit(1.5)) * F.sqrt(k * (k - 1)) / (k - 2)).otherwise(0.0)
    out = base.join(moments, _COLUMN).join(told, _COLUMN)
    return out.select(*_COLUMN, F.col("n").alias("num_count"), F.col("mean").alias("num_mean"), F.col("lo").alias("num_min"), F.col("hi").alias("num_max"), deviation.alias("num_std_dev"), skew.alias("num_skewness"), "num_quantiles")


def date_statistics(freq: DataFrame, as_of: str) -> DataFrame:
    """Of each datetime column with a date: date_min, date_max, date_range_days and freshness_score as of a day (100, less as the last date lies back; 0 after a year)."""
    t = F.col("v").try_cast("timestamp")
    g = freq.where(F.col("family") == "datetime").select(*_COLUMN, t.alias("t")).where("t is not null").groupBy(*_COLUMN).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    days = F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 86400).cast("long")
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.datediff(F.to_date(F.lit(as_of)), F.to_date("hi")) / 365 * 100))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return g.select(*_COLUMN, text("lo").alias("date_min"), text("hi").alias("date_max"), days.alias("date_range_days"), fresh.alias("freshness_score"))


def enhanced_statistics(freq: DataFrame, profiles: DataFrame, as_of: str, limit: int = LIMIT) -> DataFrame:
    """``profiles`` with the statistics of numbers and dates, and how densely integers fill their range (pk_continuity); null where a column has none."""
    num = numeric_statistics(freq, limit=limit)
    q = F.col("num_quantiles")
    num = num.withColumns({"num_q25": q[0], "num_median": q[1], "num_q75": q[2], "num_iqr": q[2] - q[0]}).drop("num_quantiles")
    span = (F.col("int_max").cast("double") - F.col("int_min") + 1)
    dense = F.when(F.col("dtype_family") != "int", None).when(F.col("n_unique") < 2, 100.0).otherwise(F.least(F.lit(100.0), 100.0 * F.col("n_unique") / span))
    return profiles.join(num, _COLUMN, "left").join(date_statistics(freq, as_of), _COLUMN, "left").withColumn("pk_continuity", F.when(F.col("int_min").isNotNull(), dense))
