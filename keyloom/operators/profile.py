"""Column profiles from value frequencies, health, numeric and date statistics, consistency and type inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_formats, date_mask, parse_date
from ..functions.normalize import int_like, numeric_tokens, strip
from ..plans.cells import family, small
from .statistics import LIMIT, QUARTILES, ranked_values


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def with_empty_tables(profiles: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds the columns of tables without rows, which have no values to count."""
    cols = [(t, f.name, f"{t}.{f.name}", i, family(f.dataType), *(0,) * 4, *(0.0,) * 3, False, 0.0, *(None,) * 5) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    known = profiles.sparkSession.createDataFrame(cols, profiles.schema)
    return profiles.unionByName(known.join(profiles.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti"))


def profile(freq: DataFrame) -> DataFrame:
    """One row per column of a frequency frame: counts, ratios, text lengths, the share of the most frequent value, and integer bounds."""
    has, v, cnt = F.col("v").isNotNull(), F.col("v"), F.col("cnt")
    whole = F.when((F.col("family") == "int") & v.rlike("^-?[0-9]{1,18}$"), v.try_cast("long"))
    g = freq.groupBy("table_name", "column_name", "ordinal", "family").agg(
        F.sum("cnt").alias("n_rows"),
        F.coalesce(F.sum(F.when(~has, cnt)), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(has, cnt)), F.lit(0)).alias("n_non_null"),
        F.count("v").alias("n_unique"),
        F.coalesce(F.max(F.when(has, cnt)), F.lit(0)).alias("top1"),
        F.sum(F.col("len") * cnt).alias("len_sum"),
        F.min("len").cast("double").alias("min_len"),
        F.max("len").cast("double").alias("max_len"),
        F.min(whole).alias("int_min"),
        F.max(whole).alias("int_max"),
    )
    return g.select(
        "table_name",
        "column_name",
        F.concat("table_name", F.lit("."), "column_name").alias("column_key"),
        "ordinal",
        F.col("family").alias("dtype_family"),
        *(F.col(c).cast("long").alias(c) for c in ("n_rows", "n_null", "n_non_null", "n_unique")),
        _ratio(F.col("n_null"), F.col("n_rows")).alias("null_ratio"),
        _ratio(F.col("n_unique"), F.col("n_rows")).alias("unique_ratio"),
        _ratio(F.col("n_unique"), F.col("n_non_null")).alias("unique_ratio_non_null"),
        ((F.col("n_rows") > 0) & (F.col("n_null") == 0) & (F.col("n_unique") == F.col("n_rows"))).alias("is_unary_ucc"),
        _ratio(F.col("top1"), F.col("n_non_null")).alias("top1_ratio"),
        F.when(F.col("n_non_null") > 0, F.col("len_sum").cast("double") / F.col("n_non_null")).alias("avg_len"),
        "min_len",
        "max_len",
        "int_min",
        "int_max",
    )


def sample_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """Adds nothing to a column but its k smallest values, as rows (table_name, column_name, place, v)."""
    w = Window.partitionBy("table_name", "column_name").orderBy("v")
    return freq.where("v is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("table_name", "column_name", "place", "v")


def with_health(profiles: DataFrame) -> DataFrame:
    """Adds health_score (0 to 100), health_status, health_severity and health_reasons."""
    string = F.col("dtype_family") == "string"
    rules = [
        (F.when(F.col("null_ratio") >= 0.95, 50).when(F.col("null_ratio") >= 0.50, 25).when(F.col("null_ratio") >= 0.20, 10).otherwise(0), "nulls"),
        (F.when(F.col("n_unique") <= 1, 35).otherwise(0), "constant"),
        (F.when(string & (F.coalesce("avg_len", F.lit(0.0)) == 0), 25).otherwise(0), "empty_text"),
        (F.when(string & (F.col("max_len") - F.col("min_len") >= 50), 10).otherwise(0), "length_spread"),
        (F.when((F.col("unique_ratio_non_null") >= 0.99) & (F.col("n_null") > 0), 10).otherwise(0), "unique_with_nulls"),
    ]
    cost = rules[0][0]
    for r, _ in rules[1:]:
        cost = cost + r
    empty = F.col("n_rows") == 0
    score = F.when(empty, 0).otherwise(F.greatest(F.lit(0), 100 - cost)).cast("int")
    out = profiles.withColumn("health_score", score)
    s = F.col("health_score")
    return out.withColumns(
        {
            "health_status": F.when(s >= 85, "ok").when(s >= 40, "warn").otherwise("fail"),
            "health_severity": F.when(s >= 70, "low").when(s >= 40, "medium").otherwise("high"),
            "health_reasons": F.array_compact(F.array(*(F.when(r > 0, n) for r, n in rules))),
        }
    )


def health_rollup(profiles: DataFrame) -> DataFrame:
    """Per table: how many columns are ok, warn and fail, and their mean score. ``profiles`` have health."""
    status = F.col("health_status")
    return profiles.groupBy("table_name").agg(*(F.count_if(status == s).alias(s) for s in ("ok", "warn", "fail")), F.avg("health_score").alias("avg_score"))


def attention(profiles: DataFrame) -> DataFrame:
    return profiles.where("health_status = 'fail' or (health_status = 'warn' and health_severity = 'medium')")


def numeric_stats(df: DataFrame, columns: list[str], limit: int = LIMIT) -> DataFrame:
    """Mean, median, bounds, sample deviation, quartiles and bias-corrected skewness of numeric columns, one row each.

    Quartiles are exact: rows are counted in ever narrower brackets where they are, so that no task takes a column. Infinite numbers are ranked at the ends, NaN above all.
    """
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns)))).where("x is not null")
    inf = float("inf")
    finite = ~F.isnan("x") & (F.abs("x") < inf)
    n = F.count("x").cast("double")
    ends = [F.count_if(F.col("x") == -inf).alias("n_low"), F.count_if(finite).alias("n_finite"), F.count_if(F.col("x") == inf).alias("n_high"), F.min(F.when(finite, F.col("x"))).alias("lo"), F.max(F.when(finite, F.col("x"))).alias("hi")]
    g = long.groupBy("column_name").agg(n.alias("n"), F.avg("x").alias("num_mean"), F.min("x").alias("num_min"), F.max("x").alias("num_max"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("num_std_dev"), F.skewness("x").alias("s"), *ends)
    g = small(g)
    rows = {r["column_name"]: r for r in g.collect()}  # a row per column
    at = {c: [q * (r["n"] - 1) for q in QUARTILES] for c, r in rows.items()}
    ranks = {c: {f(p) for p in ps for f in (math.floor, math.ceil)} for c, ps in at.items()}
    inner = {("", c): {k - r["n_low"] for k in ranks[c] if 0 <= k - r["n_low"] < r["n_finite"]} for c, r in rows.items()}
    inner = {c: ks for c, ks in inner.items() if ks}
    values = long.where(finite).select(F.lit("").alias("table_name"), "column_name", "x", F.lit(1).cast("long").alias("cnt"))
    sizes = {c: (rows[c[1]]["n_finite"], rows[c[1]]["lo"], rows[c[1]]["hi"]) for c in inner}
    found = {(r["column_name"], r["rank"]): r["x"] for r in ranked_values(values, inner, sizes, limit).collect()} if inner else {}  # two for each quartile and column

    def value(c: str, k: int) -> float:
        r = rows[c]
        k -= r["n_low"]
        return -inf if k < 0 else found[c, k] if k < r["n_finite"] else inf if k < r["n_finite"] + r["n_high"] else float("nan")

    def between(c: str, p: float) -> float:
        low, high = value(c, math.floor(p)), value(c, math.ceil(p))
        return low if low == high else low * (math.ceil(p) - p) + high * (p - math.floor(p))

    told = df.sparkSession.createDataFrame([(c, [between(c, p) for p in ps]) for c, ps in at.items()], "column_name string, q array<double>")
    g = g.join(told, "column_name")
    skew = F.when((F.col("n") > 2) & (F.col("num_std_dev") > 0), F.col("s") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)).otherwise(0.0)
    return g.select("column_name", "num_mean", F.col("q")[1].alias("num_median"), "num_min", "num_max", "num_std_dev", F.col("q")[0].alias("num_q25"), F.col("q")[2].alias("num_q75"), (F.col("q")[2] - F.col("q")[0]).alias("num_iqr"), skew.alias("num_skewness"))


def date_stats(df: DataFrame, columns: list[str], as_of: str) -> DataFrame:
    """First and last date, whole days between them, and freshness (100, less as the last date lies back from ``as_of``; 0 after a year)."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("timestamp").alias("t")) for c in columns)))).where("t is not null")
    g = long.groupBy("column_name").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    days = F.floor((F.unix_timestamp("hi") - F.unix_timestamp("lo")) / 86400)
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("hi"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return g.select("column_name", iso("lo").alias("date_min"), iso("hi").alias("date_max"), days.cast("long").alias("date_range_days"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - age / 365 * 100)).alias("freshness_score"))


def int_continuity(profiles: DataFrame) -> DataFrame:
    """How densely an integer column fills its range: 100 * distinct / (max - min + 1); 100 below two distinct values."""
    span = (F.col("int_max") - F.col("int_min") + 1).cast("double")
    c = F.when(F.col("n_unique") < 2, 100.0).otherwise(F.least(F.lit(100.0), 100.0 * F.col("n_unique") / span))
    return profiles.where("dtype_family = 'int' and int_min is not null").select("table_name", "column_name", c.alias("pk_continuity"))


def consistency_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """100 * (1 - deviation / mean), at least 0; 90 for a mean of 0, 40 without numbers."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))))
    g = long.groupBy("column_name").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    score = F.when(F.col("m").isNull(), 40.0).when(F.col("m") == 0, 90.0).otherwise(100 * (1 - F.least(F.lit(1.0), F.abs(F.col("s") / F.col("m")))))
    return g.select("column_name", score.alias("consistency_score"))


def consistency_bool(freq: DataFrame) -> DataFrame:
    """200 times the share of the rarer of two values."""
    g = freq.where("v is not null").groupBy("table_name", "column_name").agg(F.sum("cnt").alias("n"), F.min("cnt").alias("low"), F.count("*").alias("k"))
    return g.select("table_name", "column_name", F.when(F.col("k") > 1, F.least(F.lit(100.0), 200.0 * F.col("low") / F.col("n"))).otherwise(20.0).alias("consistency_score"))


def consistency(freq: DataFrame) -> DataFrame:
    """A score for each column from its frequencies: of numbers by their variation, of text by that of lengths, of booleans by the rarer value; 70 for other kinds."""
    two, n = ["table_name", "column_name", "family"], F.col("cnt").cast("double")
    x = F.when(F.col("family").isin("int", "float"), F.col("v").try_cast("double")).when(F.col("family") == "string", F.col("len").cast("double"))
    g = freq.where("v is not null").withColumn("x", x).groupBy(*two).agg(
        F.sum(F.when(F.col("x").isNotNull(), n)).alias("n"), F.sum(F.col("x") * n).alias("s1"), F.sum(F.col("x") * F.col("x") * n).alias("s2"), F.sum(n).alias("all"), F.min(n).alias("low"), F.count("*").alias("kinds")
    )
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.lit(0.0), F.try_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1))
    even = F.when(mean == 0, F.when(F.col("family") == "string", 100.0).otherwise(90.0)).otherwise(100 * (1 - F.least(F.lit(1.0), F.abs(F.sqrt(F.coalesce(var, F.lit(0.0))) / mean))))
    flag = F.when(F.col("kinds") < 2, 20.0).otherwise(F.least(F.lit(100.0), 200 * F.col("low") / F.col("all")))
    return g.select("table_name", "column_name", F.when(F.col("family") == "bool", flag).when(F.col("n") > 0, even).when(F.col("family").isin("int", "float"), 40.0).otherwise(70.0).alias("consistency_score"))


def consistency_datetime(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per group ``by``: 100 * (1 - variation of the steps between sorted times), at least 0; 90 if all times are equal.

    Times are counted first, then ordered within about sqrt(n) slices of a group's span; steps between slices come from the slices' ends. So a large group is no single task.
    """
    t = df.select(F.col(by).alias("grp"), F.unix_micros(F.col(column).cast("timestamp")).alias("t")).where("t is not null").groupBy("grp", "t").agg(F.count("*").alias("c"))
    span = t.groupBy("grp").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("c").alias("n"))
    part = F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.ceil(F.sqrt("n")))
    cut = t.join(span, "grp").withColumn("part", part)
    d = (F.col("t") - F.lag("t").over(Window.partitionBy("grp", "part").orderBy("t"))).cast("double")
    ends = cut.withColumn("d", d).groupBy("grp", "part", "n").agg(F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.min("t").alias("first"), F.max("t").alias("last"))
    between = (F.col("first") - F.lag("last").over(Window.partitionBy("grp").orderBy("part"))).cast("double")
    full = ends.withColumn("e", F.coalesce(between, F.lit(0.0))).groupBy("grp", "n").agg((F.coalesce(F.sum("s1"), F.lit(0.0)) + F.sum("e")).alias("s1"), (F.coalesce(F.sum("s2"), F.lit(0.0)) + F.sum(F.col("e") * F.col("e"))).alias("s2"))
    k = F.col("n") - 1
    mean = F.col("s1") / k
    deviation = F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - k * mean * mean) / (k - 1))).otherwise(0.0)
    score = F.when(mean == 0, 90.0).otherwise(100 * (1 - F.least(F.lit(1.0), deviation / mean)))
    return full.where("n > 1").select("grp", score.alias("consistency_score"))


def consistency_string(df: DataFrame, column: str, order: str, n: int = 200) -> DataFrame:
    """The mean of the regularity of all lengths, and that of the shares of letters and digits in the first ``n`` rows by ``order``."""
    s = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("s"), F.col(order).alias("o"))
    lengths = s.agg(F.avg(F.length("s").cast("double")).alias("m"), F.coalesce(F.stddev_samp(F.length("s").cast("double")), F.lit(0.0)).alias("sd"))
    first = s.orderBy("o").limit(n).where("s <> ''")
    of = lambda c: F.length(F.regexp_replace("s", c, "")) / F.length("s")
    shape = first.agg(F.coalesce(F.stddev_pop(of("[^A-Za-z]")), F.lit(0.0)).alias("a"), F.coalesce(F.stddev_pop(of("[^0-9]")), F.lit(0.0)).alias("d"))
    length_score = 1 - F.least(F.lit(1.0), F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0))
    shape_score = 1 - F.least(F.lit(1.0), (F.col("a") + F.col("d")) / 2)
    return lengths.crossJoin(shape).select((50 * (length_score + shape_score)).alias("consistency_score"))  # a row each


TRUE_TOKENS, FALSE_TOKENS = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")


def _number(v: Column) -> Column:
    """A text as a number, also with signs of currency and the like; most are plain ones, and those without a digit aren't looked at twice."""
    return F.coalesce(v.try_cast("double"), F.when(v.rlike("[0-9]"), numeric_tokens(v).try_cast("double")))


def induced_dates(freq: DataFrame, day_first: bool = False) -> DataFrame:
    """(table_name, column_name, mask, order, cells, dates, date_min, date_max): the formats of dates that columns show."""
    values = freq.where("v is not null").select("table_name", "column_name", strip(F.col("v")).alias("v"), "cnt")
    return date_formats(values, ["table_name", "column_name"], day_first)


def type_ratios(freq: DataFrame, day_first: bool = False) -> DataFrame:
    """Shares of a column's non-null cells that read as boolean, date, number and, of the numbers, integer; on all values, weighted. Dates are read in the order that their mask shows."""
    two = ["table_name", "column_name"]
    f = freq.where("v is not null").withColumn("low", F.lower(strip(F.col("v"))))
    f = f.select(*two, "cnt", F.col("low").isin(*TRUE_TOKENS, *FALSE_TOKENS).alias("b"), _number(F.col("v")).alias("x"))
    share = lambda hit: F.sum(F.when(hit, F.col("cnt")).otherwise(0)).cast("double")
    g = f.groupBy(*two).agg(F.sum("cnt").cast("double").alias("n"), share(F.col("b")).alias("b"), share(F.col("x").isNotNull()).alias("x"), share(int_like(F.col("x"), 1e-9)).alias("i"))
    g = g.join(induced_dates(freq, day_first).groupBy(*two).agg(F.sum("dates").cast("double").alias("d")), two, "left")
    return g.select(*two, (F.col("b") / F.col("n")).alias("bool_ratio"), (F.coalesce("d", F.lit(0.0)) / F.col("n")).alias("date_ratio"), (F.col("x") / F.col("n")).alias("numeric_ratio"), F.when(F.col("x") > 0, F.col("i") / F.col("x")).otherwise(0.0).alias("int_ratio"))


def decide_types(ratios: DataFrame) -> DataFrame:
    """Adds atomic_type and atomic_prob: boolean, then date, then int, then float, else string."""
    b, d, x, i = (F.col(c) for c in ("bool_ratio", "date_ratio", "numeric_ratio", "int_ratio"))
    is_int, is_float = (x >= 0.98) & (i >= 0.98), x >= 0.98
    kind = F.when(b >= 0.95, "bool").when(d >= 0.90, "date").when(is_int, "int").when(is_float, "float").otherwise("string")
    prob = F.when(b >= 0.95, b).when(d >= 0.90, d).when(is_float, x).otherwise(1 - F.greatest(b, d, x))
    return ratios.withColumns({"atomic_type": kind, "atomic_prob": prob})


def convert(df: DataFrame, types: dict[str, str], orders: DataFrame | None = None, day_first: bool = False) -> DataFrame:
    """Columns cast to inferred types; what doesn't read becomes null. ``orders`` (column_name, mask, order), as ``induced_dates`` gives them for this table, tell how dates are to be read; without it each one is read by itself."""
    known: dict[str, list[tuple[str, str]]] = {}
    for r in orders.select("column_name", "mask", "order").collect() if orders is not None else []:  # few masks a column
        known.setdefault(r[0], []).append((r[1], r[2]))

    def of(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        low = F.lower(strip(v))
        kind = types.get(c, "string")
        if kind == "bool":
            return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)
        if kind == "date":
            order = F.try_element_at(F.create_map(*(F.lit(x) for kv in known[c] for x in kv)), date_mask(strip(v))) if c in known else None
            return parse_date(strip(v), order, day_first)
        return {"int": F.rint(_number(v)).cast("long"), "float": _number(v)}.get(kind, v)

    return df.select(*(of(c).alias(c) for c in df.columns))


def enhanced(profiles: DataFrame, consistency: DataFrame) -> DataFrame:
    """Adds completeness and overall_quality; ``consistency`` has table_name, column_name and consistency_score."""
    out = profiles.join(consistency, ["table_name", "column_name"], "left").withColumn("consistency_score", F.coalesce("consistency_score", F.lit(70.0)))
    out = out.withColumn("completeness", F.when(F.col("n_rows") > 0, 100.0 * F.col("n_non_null") / F.col("n_rows")).otherwise(0.0))
    return out.withColumn("overall_quality", (F.col("completeness") + 100 * F.col("unique_ratio_non_null") + F.col("consistency_score")) / 3)
