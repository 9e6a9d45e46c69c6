"""One query per operator over the test tables, and DuckDB SQL that gives the same rows.

The tables hold no nulls, orphans or repeats, so messy inputs are derived from them by expressions that both sides share. Doubles are rounded to six
digits, and lists are joined to text, so that results compare.
"""

from __future__ import annotations

import itertools
import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import viz
from .config import DefaultConfig, SoftConfig
from .functions import names
from .functions.normalize import int_like, int_rep, memory_clean, no_zeros_rep, raw_rep, sql_clean, zfill_rep
from .operators import composite, inclusion, keys, profile, quality, recommend, selection, statistics
from .plans.cells import frequencies, small
from .sources import store
from .sources.catalog import Catalog, null_tokens_to_null
from .sources.previews import csv_previews

#: The integer and text columns of the relational tables, with their families.
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int"},
    "part": {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string"},
    "events": {"event_id": "int", "user_id": "int", "event_type": "string"},
}
#: Their columns of other families. Engines write these values differently, so that the queries on them compare all but lengths.
OTHER = {
    "customer": {"c_acctbal": "float"},
    "supplier": {"s_acctbal": "float"},
    "part": {"p_retailprice": "float"},
    "orders": {"o_totalprice": "float", "o_orderdate": "datetime"},
    "lineitem": {"l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_shipdate": "datetime"},
    "events": {"ts": "datetime", "value": "float"},
}
#: Derived tables: name, base table, and columns as (expression, name, family).
MESSY = {
    "messy_orders": (
        "orders",
        [
            ("o_orderkey", "order_id", "int"),
            ("CASE WHEN o_orderkey % 10 < 4 THEN 0 WHEN o_orderkey % 97 = 0 THEN 999999 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END", "customer_id", "int"),
            ("CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' ', o_orderstatus) END", "status", "string"),
            ("CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END", "paid", "string"),
        ],
    ),
    "flags": ("orders", [("o_orderkey % 2 = 0", "is_even", "bool"), ("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 = 0 END", "is_paid", "bool")]),
    "messy_customers": (
        "customer",
        [
            ("c_custkey", "customer_id", "int"),
            ("concat('user', cast(c_custkey - c_custkey % 5 AS {text}), '@x.org')", "email", "string"),
            ("c_mktsegment", "segment", "string"),
            ("CASE WHEN c_custkey % 100 = 1 THEN 'Unknown' ELSE c_name END", "full_name", "string"),
        ],
    ),
    "sparse_orders": (
        "orders",
        [
            ("CASE WHEN o_orderkey % 50 = 0 THEN 'x' END", "remark", "string"),
            ("CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey END", "reference", "int"),
            ("repeat(md5(cast(o_orderkey AS {text})), 3)", "raw_payload", "string"),
        ],
    ),
    "accounts": ("customer", [("lpad(cast(c_custkey AS {text}), 10, '0')", "account_no", "string"), ("concat(cast(c_custkey AS {text}), '.0')", "account_ref", "string")]),
    "payments": ("orders", [("concat(cast(o_custkey AS {text}), '.0')", "account_no", "string"), ("CASE WHEN o_orderkey % 5 > 0 THEN 'unknown' ELSE lpad(cast(o_custkey AS {text}), 10, '0') END", "account_code", "string"), ("concat(' ', cast(o_custkey AS {text}))", "account_key", "string")]),
}


def _expr(e: str, text: str) -> str:
    return e.replace("{text}", text)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def core(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: _t(spark, d, t).select(*c) for t, c in COLUMNS.items()}


def messy(spark: SparkSession, d: str, *which: str) -> dict[str, DataFrame]:
    return {n: _t(spark, d, b).selectExpr(*(f"{_expr(e, 'string')} AS {c}" for e, c, _ in cols)) for n, (b, cols) in MESSY.items() if n in which}


def _messy_sql(n: str) -> str:
    b, cols = MESSY[n]
    return f"(SELECT {', '.join(f'{_expr(e, "VARCHAR")} AS {c}' for e, c, _ in cols)} FROM {b})"


def _round(df: DataFrame) -> DataFrame:
    """Doubles to six digits, lists to text."""
    of = lambda c, t: F.round(c, 6).alias(c) if t == "double" else F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array<") else F.col(c)
    return df.select(*(of(c, t) for c, t in df.dtypes))


# SQL pieces -----------------------------------------------------------------------------------------------------------------
SQL_CLEAN = "CASE WHEN lower(trim(cast({c} AS VARCHAR))) IN ('', 'null', 'none', 'n/a', 'na', 'nan') THEN NULL ELSE trim(cast({c} AS VARCHAR)) END"
RAW = "cast({c} AS VARCHAR)"


def _sources(tables) -> list[tuple[str, str, dict[str, str]]]:
    return [(t, t, COLUMNS[t]) if t in COLUMNS else (t, _messy_sql(t), {c: f for _, c, f in MESSY[t][1]}) for t in tables]


def freq_sql(tables=tuple(COLUMNS), clean: str = SQL_CLEAN, sources: list[tuple[str, str, dict[str, str]]] | None = None) -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{f}' AS family, {clean.format(c=c)} AS v, count(*)::BIGINT AS cnt FROM {src} GROUP BY ALL" for t, src, cols in sources or _sources(tables) for i, (c, f) in enumerate(cols.items())]
    return "freq AS (" + "\nUNION ALL ".join(parts) + ")"


PROF = """prof AS (
  SELECT table_name, column_name, ordinal, family AS dtype_family, sum(cnt)::BIGINT AS n_rows, coalesce(sum(cnt) FILTER (v IS NULL), 0)::BIGINT AS n_null,
         coalesce(sum(cnt) FILTER (v IS NOT NULL), 0)::BIGINT AS n_non_null, count(v)::BIGINT AS n_unique,
         n_null::DOUBLE / n_rows AS null_ratio, n_unique::DOUBLE / n_rows AS unique_ratio, coalesce(n_unique::DOUBLE / nullif(n_non_null, 0), 0) AS unique_ratio_non_null,
         n_null = 0 AND n_unique = n_rows AS is_unary_ucc, coalesce(max(cnt) FILTER (v IS NOT NULL)::DOUBLE / nullif(n_non_null, 0), 0) AS top1_ratio,
         sum(length(v) * cnt)::DOUBLE / nullif(n_non_null, 0) AS avg_len, min(length(v))::DOUBLE AS min_len, max(length(v))::DOUBLE AS max_len,
         min(CASE WHEN family = 'int' THEN try_cast(v AS BIGINT) END) AS int_min, max(CASE WHEN family = 'int' THEN try_cast(v AS BIGINT) END) AS int_max
  FROM freq GROUP BY table_name, column_name, ordinal, family
), ucc AS (SELECT * FROM prof WHERE is_unary_ucc)"""
HEALTH = """health AS (
  SELECT *, greatest(0, 100 - CASE WHEN null_ratio >= 0.95 THEN 50 WHEN null_ratio >= 0.5 THEN 25 WHEN null_ratio >= 0.2 THEN 10 ELSE 0 END
    - CASE WHEN n_unique <= 1 THEN 35 ELSE 0 END - CASE WHEN dtype_family = 'string' AND coalesce(avg_len, 0) = 0 THEN 25 ELSE 0 END
    - CASE WHEN dtype_family = 'string' AND max_len - min_len >= 50 THEN 10 ELSE 0 END - CASE WHEN unique_ratio_non_null >= 0.99 AND n_null > 0 THEN 10 ELSE 0 END)::INTEGER AS health_score,
    CASE WHEN health_score >= 85 THEN 'ok' WHEN health_score >= 40 THEN 'warn' ELSE 'fail' END AS health_status,
    CASE WHEN health_score >= 70 THEN 'low' WHEN health_score >= 40 THEN 'medium' ELSE 'high' END AS health_severity
  FROM prof
)"""
IND = """child AS (
  SELECT * FROM prof WHERE NOT is_unary_ucc AND dtype_family IN ('int', 'string') AND null_ratio < 0.95 AND unique_ratio_non_null >= 0.02 AND n_non_null >= 20
    AND NOT (n_unique <= 50 AND top1_ratio > 0.9) AND n_unique >= CASE WHEN dtype_family = 'string' THEN 20 ELSE 10 END
    AND (dtype_family <> 'string' OR (max_len - min_len <= 30 AND avg_len <= 40))
), met AS (
  SELECT c.table_name AS fk_table, c.column_name AS fk_column, p.table_name AS pk_table, p.column_name AS pk_column, count(*)::BIGINT AS intersection_distinct, sum(f.cnt)::BIGINT AS matched_rows,
         any_value(c.n_non_null) AS fk_non_null_rows, any_value(c.n_unique) AS fk_distinct, any_value(p.n_unique) AS pk_distinct,
         any_value(c.int_min) AS fk_min, any_value(c.int_max) AS fk_max, any_value(p.int_min) AS pk_min, any_value(p.int_max) AS pk_max
  FROM child c JOIN ucc p ON c.table_name <> p.table_name AND c.dtype_family = p.dtype_family
  JOIN freq f ON f.table_name = c.table_name AND f.column_name = c.column_name AND f.v IS NOT NULL
  JOIN freq g ON g.table_name = p.table_name AND g.column_name = p.column_name AND g.v = f.v
  GROUP BY 1, 2, 3, 4
), ind AS (
  SELECT *, round(intersection_distinct::DOUBLE / fk_distinct, 6) AS distinct_coverage, round(matched_rows::DOUBLE / fk_non_null_rows, 6) AS row_coverage
  FROM met WHERE intersection_distinct::DOUBLE / fk_distinct >= 0.9
)"""


def _tokens(c: str) -> str:
    stop = ", ".join(f"'{t}'" for t in names.STOP_TOKENS)
    return f"list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '' AND x NOT IN ({stop})))"


def _plain(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '[^a-z0-9]+', '', 'g')"


def sim_sql(a: str, b: str) -> str:
    x, y, u, v = _plain(a), _plain(b), _tokens(a), _tokens(b)
    jaccard = f"len(list_intersect({u}, {v}))::DOUBLE / len(list_distinct(list_concat({u}, {v})))"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0 WHEN len({u}) = 0 OR len({v}) = 0 THEN 0.0 ELSE greatest({jaccard}, CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.65 ELSE 0.0 END) END::DOUBLE"


SCORED = f"""scored AS (
  SELECT *, {sim_sql("fk_column", "pk_column")} AS name_sim,
    CASE WHEN fk_min IS NULL OR pk_min IS NULL THEN 0.0 ELSE log10(greatest(1.0, greatest(1, pk_max - pk_min + 1)::DOUBLE / greatest(1, fk_max - fk_min + 1))) END AS wide,
    least(0.95, wide / (1 + wide)) * least(1.0, 2000.0::DOUBLE / greatest(1, fk_distinct)) AS range_penalty,
    CASE WHEN fk_distinct <= 30 AND distinct_coverage >= 0.95 AND name_sim < 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS small_domain_penalty,
    CASE WHEN regexp_matches(lower(fk_column), 'minute|min|time|second|day|month|year|age|score|rating|stage|round|week|status|flag|type|count|qty|quantity|amount|price|total') AND NOT suffix(lower(fk_column), 'id') AND suffix(lower(pk_column), 'id')
      AND fk_max <= 500 AND fk_distinct <= 500 AND distinct_coverage >= 0.99 AND row_coverage >= 0.99 THEN 1.0 ELSE 0.0 END::DOUBLE AS measure_penalty,
    greatest(0.0, least(1.0, 0.75::DOUBLE * distinct_coverage + 0.2::DOUBLE * row_coverage + 0.05::DOUBLE * name_sim - 0.1::DOUBLE * range_penalty - 0.2::DOUBLE * small_domain_penalty - 0.6::DOUBLE * measure_penalty)) AS score
  FROM ind
), edges AS (
  SELECT s.*, fk_table || '.' || fk_column || ' -> ' || pk_table || '.' || pk_column AS relationship, CASE WHEN p.unique_ratio_non_null >= 0.999999 THEN 'one_to_one' ELSE 'many_to_one' END AS cardinality, p.null_ratio >= 0.01 AS optional
  FROM scored s JOIN prof p ON p.table_name = fk_table AND p.column_name = fk_column WHERE score >= 0.9
  QUALIFY row_number() OVER (PARTITION BY fk_table, fk_column ORDER BY score DESC, distinct_coverage DESC, row_coverage DESC, name_sim DESC, pk_table, pk_column) <= 3
)"""
BASE = f"WITH {freq_sql()}, {PROF}"
CHAIN = f"{BASE}, {IND}, {SCORED}"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _profiles(spark, d):
    return profile.profile(frequencies(core(spark, d)))


def _chain(spark, d):
    freq = frequencies(core(spark, d)).persist()
    p = small(profile.profile(freq))
    ucc = keys.unary_ucc(p)
    ind = small(inclusion.strict_inclusions(freq, p, ucc))
    scored = selection.score(ind)
    return freq, p, ucc, ind, scored, small(selection.select_edges(scored, p))


# Profiles -------------------------------------------------------------------------------------------------------------------
PROFILE_COLUMNS = "table_name column_name dtype_family n_rows n_null n_non_null n_unique null_ratio unique_ratio unique_ratio_non_null is_unary_ucc top1_ratio avg_len min_len max_len".split()


def _column_sql(t: str, src: str, c: str, f: str, clean: str) -> str:
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{f}' AS dtype_family, count(*) AS n_rows, count(*) - count(v) AS n_null, count(v) AS n_non_null, count(DISTINCT v) AS n_unique,
  round((count(*) - count(v))::DOUBLE / count(*), 6) AS null_ratio, round(count(DISTINCT v)::DOUBLE / count(*), 6) AS unique_ratio, round(coalesce(count(DISTINCT v)::DOUBLE / nullif(count(v), 0), 0), 6) AS unique_ratio_non_null,
  count(v) = count(*) AND count(DISTINCT v) = count(*) AS is_unary_ucc,
  (SELECT round(max(k)::DOUBLE / sum(k), 6) FROM (SELECT count(*) AS k FROM (SELECT {clean.format(c=c)} AS v FROM {src}) WHERE v IS NOT NULL GROUP BY v)) AS top1_ratio,
  round(avg(length(v)), 6) AS avg_len, min(length(v))::DOUBLE AS min_len, max(length(v))::DOUBLE AS max_len FROM (SELECT {clean.format(c=c)} AS v FROM {src})"""


def _columns_sql(tables, clean=SQL_CLEAN) -> str:
    return "\nUNION ALL ".join(_column_sql(t, src, c, f, clean) for t, src, cols in _sources(tables) for c, f in cols.items())


@query("profile_columns_tpch", _columns_sql(COLUMNS))
def _(spark, d):
    return _round(_profiles(spark, d).select(*PROFILE_COLUMNS))


@query("profile_messy_nulls", _columns_sql(["messy_orders"]))
def _(spark, d):
    return _round(profile.profile(frequencies(messy(spark, d, "messy_orders"))).select(*PROFILE_COLUMNS))


@query("profile_raw_duplicates_view", _columns_sql(["messy_orders", "messy_customers"], RAW))
def _(spark, d):
    return _round(profile.profile(frequencies(messy(spark, d, "messy_orders", "messy_customers"), lambda c: c.cast("string"))).select(*PROFILE_COLUMNS))


ALL = (*COLUMNS, "messy_orders", "messy_customers")
MORE = f"WITH {freq_sql(ALL)}, {PROF}, {HEALTH}"


def _health(spark, d):
    return profile.with_health(profile.profile(frequencies(core(spark, d) | messy(spark, d, "messy_orders", "messy_customers"))))


@query("health_scores", f"{MORE} SELECT table_name, column_name, health_score, health_status, health_severity FROM health")
def _(spark, d):
    return _health(spark, d).select("table_name", "column_name", "health_score", "health_status", "health_severity")


@query("health_rollup", f"{MORE} SELECT table_name, count(*) FILTER (health_status = 'ok') AS ok, count(*) FILTER (health_status = 'warn') AS warn, count(*) FILTER (health_status = 'fail') AS fail, round(avg(health_score), 6) AS avg_score FROM health GROUP BY 1")
def _(spark, d):
    return _round(profile.health_rollup(_health(spark, d)))


@query("attention_needed", f"WITH {freq_sql((*ALL, 'sparse_orders'))}, {PROF}, {HEALTH} SELECT table_name, column_name, health_status FROM health WHERE health_status = 'fail' OR (health_status = 'warn' AND health_severity = 'medium')")
def _(spark, d):
    p = profile.profile(frequencies(core(spark, d) | messy(spark, d, "messy_orders", "messy_customers", "sparse_orders")))
    return profile.attention(profile.with_health(p)).select("table_name", "column_name", "health_status")


# Floats, times and booleans; and columns of few or long values
OTHERS = f"WITH {freq_sql(sources=[(t, t, c) for t, c in OTHER.items()] + _sources(['flags', 'sparse_orders']))}, {PROF}, {HEALTH}"


def _others(spark, d):
    other = {t: _t(spark, d, t).select(*c) for t, c in OTHER.items()}
    return profile.with_health(profile.profile(frequencies(other | messy(spark, d, "flags", "sparse_orders"))))


COUNTS = [c for c in PROFILE_COLUMNS if not c.endswith("_len")]


@query("profile_other_families", f"{OTHERS} SELECT {', '.join(f'round({c}, 6) AS {c}' if c.endswith('ratio') or c.endswith('non_null') and c[0] == 'u' else c for c in COUNTS)}, health_score, health_status FROM health")
def _(spark, d):
    return _round(_others(spark, d).select(*COUNTS, "health_score", "health_status"))


@query("datatypes_other_families", f"{OTHERS} SELECT table_name, column_name, CASE dtype_family WHEN 'bool' THEN 'BOOLEAN' WHEN 'datetime' THEN 'TIMESTAMP' ELSE 'DECIMAL(10,2)' END AS db_type, CASE dtype_family WHEN 'bool' THEN 0.9 WHEN 'datetime' THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM prof WHERE dtype_family IN ('bool', 'datetime', 'float')")
def _(spark, d):
    p = _others(spark, d).where(F.col("dtype_family").isin("bool", "datetime", "float"))
    return recommend.datatypes(p).select("table_name", "column_name", "db_type", "confidence")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("numeric_stats", "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS num_mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS num_median, min({c})::DOUBLE AS num_min, max({c})::DOUBLE AS num_max, round(stddev_samp({c}), 6) AS num_std_dev, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS num_q25, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS num_q75, round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 6) AS num_iqr, round(skewness({c}), 5) AS num_skewness FROM lineitem" for c in NUMBERS))
def _(spark, d):
    return _round(profile.numeric_stats(_t(spark, d, "lineitem"), NUMBERS)).withColumn("num_skewness", F.round("num_skewness", 5))


@query("date_stats", "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS date_max, floor(epoch(max({c}) - min({c})) / 86400)::BIGINT AS date_range_days, round(greatest(0.0, least(100.0, 100 - date_diff('day', max({c})::DATE, DATE '2000-01-01') / 365.0::DOUBLE * 100)), 6)::DOUBLE AS freshness_score FROM {t}" for t, c in (("orders", "o_orderdate"),)))
def _(spark, d):
    return _round(profile.date_stats(_t(spark, d, "orders"), ["o_orderdate"], "2000-01-01"))


@query("int_continuity", f"{BASE} SELECT table_name, column_name, round(CASE WHEN n_unique < 2 THEN 100.0 ELSE least(100.0, 100.0 * n_unique / (int_max - int_min + 1)::DOUBLE) END, 6)::DOUBLE AS pk_continuity FROM prof WHERE dtype_family = 'int'")
def _(spark, d):
    return _round(profile.int_continuity(_profiles(spark, d)))


@query("consistency_numeric", "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, round(100 * (1 - least(1.0, abs(stddev_samp({c}) / avg({c})))), 6)::DOUBLE AS consistency_score FROM lineitem" for c in NUMBERS))
def _(spark, d):
    return _round(profile.consistency_numeric(_t(spark, d, "lineitem"), NUMBERS))


@query("consistency_bool", f"SELECT 'flags' AS table_name, 'paid' AS column_name, round(least(100.0, 200.0 * min(k) / sum(k)), 6)::DOUBLE AS consistency_score FROM (SELECT count(*)::DOUBLE AS k FROM {_messy_sql('messy_orders')} GROUP BY paid)")
def _(spark, d):
    flags = messy(spark, d, "messy_orders")["messy_orders"].selectExpr("paid = 'yes' AS paid")
    return _round(profile.consistency_bool(frequencies({"flags": flags})))


@query("consistency_datetime", "WITH s AS (SELECT event_type AS grp, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts))::DOUBLE AS d FROM events) SELECT grp, round(CASE WHEN avg(d) = 0 THEN 90.0 ELSE 100 * (1 - least(1.0, coalesce(stddev_samp(d), 0) / avg(d))) END, 6)::DOUBLE AS consistency_score FROM s WHERE d IS NOT NULL GROUP BY grp")
def _(spark, d):
    return _round(profile.consistency_datetime(_t(spark, d, "events"), "ts", "event_type"))


@query("consistency_string", """WITH f AS (SELECT p_name AS s FROM part ORDER BY p_partkey LIMIT 200),
x AS (SELECT stddev_pop(length(regexp_replace(s, '[^A-Za-z]', '', 'g'))::DOUBLE / length(s)) AS a, stddev_pop(length(regexp_replace(s, '[^0-9]', '', 'g'))::DOUBLE / length(s)) AS d FROM f),
l AS (SELECT avg(length(p_name)) AS m, stddev_samp(length(p_name)) AS sd FROM part)
SELECT round(50 * ((1 - least(1.0, sd / m)) + (1 - least(1.0, (a + d) / 2))), 6)::DOUBLE AS consistency_score FROM x, l""")
def _(spark, d):
    return _round(profile.consistency_string(_t(spark, d, "part"), "p_name", "p_partkey"))


STATS = {"lineitem": {"l_quantity": "float", "l_discount": "float", "l_linenumber": "int", "l_suppkey": "int", "l_shipdate": "datetime"}, "orders": {"o_orderkey": "int", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderstatus": "string"}}
STAT_FIELDS = ["num_count", "num_mean", "num_min", "num_max", "num_std_dev", "num_skewness", "num_q25", "num_median", "num_q75", "num_iqr", "date_min", "date_max", "date_range_days", "freshness_score", "pk_continuity"]


def _stat_sql(t: str, c: str, f: str) -> str:
    x, num, day, whole = f"{c}::DOUBLE", f in ("int", "float"), f == "datetime", f == "int"
    q = lambda p: f"quantile_cont({x}, {p})" if num else "NULL::DOUBLE"
    one = lambda e, on=num: e if on else "NULL::DOUBLE"
    text = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')" if day else "NULL::VARCHAR"
    fields = [
        f"count({c})::BIGINT" if num else "NULL::BIGINT", *(f"round({one(e)}, 5)" for e in (f"avg({x})", f"min({x})", f"max({x})", f"stddev_samp({x})", f"skewness({x})", q(0.25), q(0.5), q(0.75), f"{q(0.75)} - {q(0.25)}")),
        text(f"min({c})"), text(f"max({c})"), f"floor(epoch(max({c}) - min({c})) / 86400)::BIGINT" if day else "NULL::BIGINT",
        f"round({one(f"greatest(0.0, least(100.0, 100 - date_diff('day', max({c})::DATE, DATE '2000-01-01') / 365.0::DOUBLE * 100))", day)}, 5)::DOUBLE", f"round({one(f'least(100.0, 100.0 * count(DISTINCT {c}) / (max({c}) - min({c}) + 1))', whole)}, 5)::DOUBLE",
    ]
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, " + ", ".join(f"{e} AS {n}" for e, n in zip(fields, STAT_FIELDS, strict=True)) + f" FROM {t} HAVING count(*) >= 0"


@query("enhanced_statistics", " UNION ALL ".join(_stat_sql(t, c, f) for t, cs in STATS.items() for c, f in cs.items()))
def _(spark, d):
    """Numbers, dates and continuity of all columns in one frame, from frequencies; brackets of over 2,000 values are narrowed."""
    freq = frequencies({t: _t(spark, d, t).select(*cs) for t, cs in STATS.items()}).persist()
    out = statistics.enhanced_statistics(freq, small(profile.profile(freq)), "2000-01-01", limit=2000).select("table_name", "column_name", *STAT_FIELDS)
    return out.select(*(F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("sample_values_sorted", f"WITH {freq_sql()} SELECT table_name, column_name, place::INTEGER AS place, v FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY v) AS place FROM freq WHERE v IS NOT NULL) WHERE place <= 5")
def _(spark, d):
    return profile.sample_values(frequencies(core(spark, d)))


# Keys -----------------------------------------------------------------------------------------------------------------------
@query("unary_ucc", f"{BASE} SELECT table_name, column_name, n_rows, n_unique, 'unary' AS ucc_type FROM ucc")
def _(spark, d):
    return keys.unary_ucc(_profiles(spark, d)).select("table_name", "column_name", "n_rows", "n_unique", "ucc_type")


@query("unary_ucc_relaxed", f"WITH {freq_sql(ALL)}, {PROF} SELECT table_name, column_name, round(unique_ratio, 6) AS unique_ratio FROM prof WHERE is_unary_ucc OR (unique_ratio_non_null >= 0.95 AND null_ratio <= 0.1)")
def _(spark, d):
    p = profile.profile(frequencies(core(spark, d) | messy(spark, d, "messy_orders", "messy_customers")))
    return _round(keys.unary_ucc(p, 0.95, 0.1).select("table_name", "column_name", "unique_ratio"))


def _name_tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '')"


def _prune_sql(base: str = MORE) -> str:
    from .config import PruneConfig

    c = PruneConfig()
    has = lambda ws: f"list_has_any({_name_tokens_sql('column_name')}, [{', '.join(repr(w) for w in ws)}])"
    return f"""{base}, h AS (SELECT *, {has(c.payload_tokens)} AS pay, {has(c.key_tokens)} AS k, {has(c.measure_tokens)} AS m, {has(c.date_tokens)} AS dt, {has(c.negative_tokens)} AS neg,
      dtype_family = 'string' AND (coalesce(avg_len, 0) >= 120 OR coalesce(max_len, 0) >= 250 OR (avg_len >= 60 AND max_len >= 1000)) AS long_text, n_unique BETWEEN 1 AND 50 AS small FROM prof),
    r AS (SELECT *, list_filter([CASE WHEN n_non_null = 0 THEN 'all_null' END, CASE WHEN null_ratio >= 0.98 THEN 'too_many_nulls' END, CASE WHEN top1_ratio >= 0.999 THEN 'single_value_dominated' END, CASE WHEN dtype_family = 'bool' THEN 'boolean_like' END, CASE WHEN long_text THEN 'free_text_like' END,
      CASE WHEN m AND NOT k THEN 'measure_like_name' END, CASE WHEN dt AND NOT k THEN 'date_like_name' END, CASE WHEN pay AND NOT k AND (coalesce(avg_len, 0) >= 80 OR coalesce(max_len, 0) >= 200) AND unique_ratio_non_null >= 0.9 THEN 'encoded_payload_like' END, CASE WHEN neg AND NOT k AND dtype_family = 'string' AND coalesce(avg_len, 0) >= 30 THEN 'negative_name_hint' END], lambda x: x IS NOT NULL) AS bad,
      list_filter([CASE WHEN k THEN 'key_name_hint' END, CASE WHEN small THEN 'small_domain' END], lambda x: x IS NOT NULL) AS good FROM h)
    SELECT table_name, column_name, len(bad) > 0 AS reject, k AS key_name_hint, small AS small_domain, array_to_string(CASE WHEN len(bad) > 0 THEN bad WHEN len(good) > 0 THEN good ELSE ['keep'] END, ',') AS reasons FROM r"""


@query("prune_flags", _prune_sql())
def _(spark, d):
    p = profile.profile(frequencies(core(spark, d) | messy(spark, d, "messy_orders", "messy_customers")))
    return _round(keys.prune(p).select("table_name", "column_name", "reject", "key_name_hint", "small_domain", "reasons"))


@query("prune_flags_other_families", _prune_sql(OTHERS))
def _(spark, d):
    return _round(keys.prune(_others(spark, d)).select("table_name", "column_name", "reject", "key_name_hint", "small_domain", "reasons"))


@query("surrogate_annotations", f"""{CHAIN}, refs AS (SELECT pk_table, pk_column, count(*)::BIGINT AS refs FROM edges WHERE score >= 0.95 AND (name_sim >= 0.3 OR (suffix(fk_column, 'id') AND suffix(pk_column, 'id')))
    AND NOT (regexp_matches(fk_column, 'minute|second|hour|status|flag|qty|count|number_of') AND NOT suffix(fk_column, 'id')) GROUP BY 1, 2),
  k AS (SELECT p.*, unique_ratio >= 0.999 AND null_ratio <= 0.01 AS strict, coalesce(refs, 0)::BIGINT AS refs, CASE WHEN column_name = 'id' THEN 1.0 WHEN regexp_matches(column_name, '_id$|uuid|guid') THEN 0.7 ELSE 0 END AS hint,
      CASE WHEN regexp_matches(column_name, '{"|".join(names.EXTERNAL_STRONG)}') THEN 1.0 WHEN regexp_matches(column_name, '{"|".join(names.EXTERNAL_MEDIUM)}') THEN 0.6 ELSE 0 END AS nat,
      regexp_matches(column_name, '{"|".join(names.DESCRIPTIVE_PARTS)}') AS descr, regexp_matches(column_name, '{"|".join(names.BUSINESS_PARTS)}') AS biz,
      EXISTS (SELECT 1 FROM ucc u WHERE u.table_name = p.table_name AND u.column_name <> p.column_name AND NOT regexp_matches(u.column_name, '^id$|_id$')) AS alt
    FROM prof p LEFT JOIN refs r ON r.pk_table = p.table_name AND r.pk_column = p.column_name WHERE (unique_ratio >= 0.999 AND null_ratio <= 0.01) OR (unique_ratio >= 0.98 AND null_ratio <= 0.05)),
  s AS (SELECT *, round(greatest(0, least(1, 0.5 + CASE WHEN dtype_family = 'int' AND n_unique::DOUBLE / (int_max - int_min + 1) >= 0.8 THEN 0.15 ELSE 0 END + CASE WHEN refs >= 2 THEN 0.15 ELSE 0 END + CASE WHEN alt THEN 0.1 ELSE 0 END + least(0.1, 0.1 * hint) - 0.2 * nat - CASE WHEN descr AND refs = 0 AND hint = 0 THEN 0.2 ELSE 0 END)), 3)::DOUBLE AS confidence FROM k)
  SELECT table_name, column_name, CASE WHEN refs > 0 THEN 'pk_candidate' ELSE 'key_candidate' END AS key_role, CASE WHEN confidence >= 0.75 AND strict AND NOT descr THEN 'surrogate' WHEN NOT strict AND biz THEN 'business_key' ELSE 'key_candidate' END AS key_kind, confidence, refs FROM s""")
def _(spark, d):
    freq, p, ucc, _, _, edges = _chain(spark, d)
    return keys.surrogate_keys(p, keys.uuid_like(freq), ucc, edges).select("table_name", "column_name", "key_role", "key_kind", "confidence", "refs")


@query("surrogate_filters", f"SELECT * FROM ({ORACLE['surrogate_annotations']}) WHERE key_role = 'pk_candidate' AND confidence >= 0.6 ORDER BY confidence DESC, table_name, column_name LIMIT 3")
def _(spark, d):
    """The three most confident keys that are referred to."""
    freq, p, ucc, _, _, edges = _chain(spark, d)
    found = keys.surrogate_keys(p, keys.uuid_like(freq), ucc, edges).select("table_name", "column_name", "key_role", "key_kind", "confidence", "refs")
    return selection.pick_surrogates(found, role="pk_candidate", min_confidence=0.6, top=3)


@query("edge_subset", f"{CHAIN} SELECT relationship, round(score, 6) AS score FROM edges WHERE fk_table IN ('orders', 'lineitem', 'customer', 'part') AND pk_table IN ('orders', 'lineitem', 'customer', 'part')")
def _(spark, d):
    return _round(selection.pick_edges(_chain(spark, d)[5], tables=["orders", "lineitem", "customer", "part"]).select("relationship", "score"))


UUID = "concat(substr(md5(cast(c_custkey AS {text})), 1, 8), '-', substr(md5(cast(c_custkey AS {text})), 9, 4), '-4', substr(md5(cast(c_custkey AS {text})), 14, 3), '-a', substr(md5(cast(c_custkey AS {text})), 18, 3), '-', substr(md5(cast(c_custkey AS {text})), 21, 12))"


@query("uuid_like", f"SELECT 't' AS table_name, c AS column_name, avg(regexp_matches(v, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}$')::INT) >= 0.95 AS uuid_like FROM (SELECT 'u' AS c, {_expr(UUID, 'VARCHAR')} AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer) GROUP BY c")
def _(spark, d):
    return keys.uuid_like(frequencies({"t": _t(spark, d, "customer").selectExpr(f"{_expr(UUID, 'string')} AS u", "c_name")}))


LINE = ["l_orderkey", "l_partkey", "l_suppkey"]


def _combo_sql(cols) -> str:
    return f"SELECT '{','.join(cols)}' AS columns, {len(cols)}::BIGINT AS k WHERE (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM lineitem))"


PAIRS = [("l_orderkey", "l_partkey"), ("l_orderkey", "l_suppkey"), ("l_partkey", "l_suppkey")]


def _composite(spark, d, k):
    found = keys.composite_ucc(_t(spark, d, "lineitem").select(*LINE), LINE, k)
    return spark.createDataFrame([(",".join(c), len(c)) for c in found], "columns string, k long")


@query("composite_ucc_k2", "\nUNION ALL ".join(map(_combo_sql, PAIRS)))
def _(spark, d):
    return _composite(spark, d, 2)


@query("composite_ucc_k3_minimal", "WITH two AS (" + "\nUNION ALL ".join(map(_combo_sql, PAIRS)) + f") SELECT * FROM two UNION ALL SELECT * FROM ({_combo_sql(LINE)}) WHERE NOT EXISTS (SELECT 1 FROM two)")
def _(spark, d):
    return _composite(spark, d, 3)


LOTS = "o_orderkey - o_orderkey % 10 AS batch, o_orderkey % 10 AS line, o_custkey % 10 AS desk"
LOT_PAIRS = [("batch", "line"), ("batch", "desk"), ("line", "desk")]


@query("composite_ucc_found", f"WITH lots AS (SELECT {LOTS} FROM orders) " + " UNION ALL ".join(_combo_sql(c).replace("lineitem", "lots") for c in LOT_PAIRS))
def _(spark, d):
    found = keys.composite_ucc(_t(spark, d, "orders").selectExpr(*LOTS.split(", ")), ["batch", "line", "desk"], 2)
    return spark.createDataFrame([(",".join(c), len(c)) for c in found], "columns string, k long")


# Normalisation --------------------------------------------------------------------------------------------------------------
TOKENS = ", ".join(f"'{t}'" for t in __import__("keyloom.config", fromlist=["x"]).MEMORY_NULLS)


@query("null_normalise", f"SELECT order_id, CASE WHEN lower(trim(regexp_replace(status, '\\s+', ' ', 'g'))) IN ({TOKENS}) THEN NULL ELSE status END AS memory_value, {SQL_CLEAN.format(c='status')} AS sql_value FROM {_messy_sql('messy_orders')}")
def _(spark, d):
    return messy(spark, d, "messy_orders")["messy_orders"].select("order_id", memory_clean(F.col("status")).alias("memory_value"), sql_clean(F.col("status")).alias("sql_value"))


@query("int_like_tolerance", "WITH x AS (SELECT o_orderkey, o_totalprice * (1 + o_orderkey % 3) AS x FROM orders UNION ALL SELECT o_orderkey, (o_orderkey % 1000)::DOUBLE + 1e-9 FROM orders) SELECT o_orderkey, round(x, 6) AS x, abs(x - round_even(x, 0)) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(round_even(x, 0)) AS int_like FROM x")
def _(spark, d):
    o = _t(spark, d, "orders")
    x = o.selectExpr("o_orderkey", "o_totalprice * (1 + o_orderkey % 3) AS x").unionByName(o.selectExpr("o_orderkey", "cast(o_orderkey % 1000 as double) + cast(1e-9 as double) AS x"))
    return x.select("o_orderkey", F.round("x", 6).alias("x"), int_like(F.col("x")).alias("int_like"))


@query("key_representations", f"""SELECT account_no, account_code, trim(account_key) AS raw_rep, cast(cast(account_no AS DOUBLE) AS BIGINT)::VARCHAR AS int_rep,
  CASE WHEN regexp_matches(account_code, '^[0-9]+$') THEN regexp_replace(account_code, '^0+(.)', '\\1') END AS no_zeros, lpad(trim(account_key), greatest(8, length(trim(account_key)))::INT, '0') AS padded FROM {_messy_sql('payments')}""")
def _(spark, d):
    p = messy(spark, d, "payments")["payments"]
    return p.select("account_no", "account_code", raw_rep(F.col("account_key")).alias("raw_rep"), int_rep(F.col("account_no"), 2**31 - 1).alias("int_rep"), no_zeros_rep(F.col("account_code")).alias("no_zeros"), zfill_rep(F.col("account_key"), F.lit(8)).alias("padded"))


@query("csv_scan_string_nulls", f"SELECT order_id, CASE WHEN status IN ('', 'NULL', 'null', 'None', 'none', 'N/A', 'n/a', 'NA', 'na') THEN NULL ELSE status END AS status FROM {_messy_sql('messy_orders')}")
def _(spark, d):
    return null_tokens_to_null(messy(spark, d, "messy_orders")["messy_orders"].select("order_id", "status"))


CSV = [("o_orderkey", "order_id", "int"), ("concat('1995-0', cast(1 + o_orderkey % 9 AS {text}), '-11')", "day", "datetime"), ("CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END", "paid", "bool"), ("o_totalprice", "total", "float"), ("CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' ELSE concat('say \"', o_orderstatus, '\", ', chr(10), 'please') END", "note", "string")]


@query("csv_end_to_end", f"WITH t AS (SELECT {', '.join(f'{_expr(e, 'VARCHAR')} AS {c}' for e, c, _ in CSV)} FROM orders) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{f}' AS dtype_family, count(*) AS n_rows, count(*) FILTER ({c}::VARCHAR = 'N/A') AS n_null, count(DISTINCT {c}) FILTER ({c}::VARCHAR <> 'N/A') AS n_unique FROM t" for _, c, f in CSV))
def _(spark, d):
    """Writes a table as CSV with quotes, commas, line ends and null tokens, reads it as an upload, and takes the types from the texts."""
    from .engine import Engine

    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="keyloom-")  # the latter in local sessions
    path = f"{folder}/keyloom/{uuid.uuid4().hex}/shop.csv"
    _t(spark, d, "orders").selectExpr(*(f"{_expr(e, 'string')} AS {c}" for e, c, _ in CSV)).write.option("header", True).option("escape", '"').csv(path)
    engine = Engine(Catalog.of_uploads(spark, [path]), nulls="memory", infer_types=True)
    out = engine.profiles.select("column_name", "dtype_family", "n_rows", "n_null", "n_unique")
    engine.close()
    return out


# Inclusion dependencies -----------------------------------------------------------------------------------------------------
@query("ind_pair_metrics_custkey", f"""WITH c AS (SELECT {SQL_CLEAN.format(c='customer_id')} AS v FROM {_messy_sql('messy_orders')}), p AS (SELECT DISTINCT cast(c_custkey AS VARCHAR) AS v FROM customer)
SELECT count(c.v) AS fk_non_null_rows, count(DISTINCT c.v) AS fk_distinct, count(DISTINCT p.v) AS intersection_distinct, count(p.v) AS matched_rows, (SELECT count(*) FROM p) AS pk_distinct,
  round(count(DISTINCT p.v)::DOUBLE / count(DISTINCT c.v), 6) AS distinct_coverage, round(count(p.v)::DOUBLE / count(c.v), 6) AS row_coverage FROM c LEFT JOIN p USING (v)""".replace("USING (v)", "ON c.v = p.v"))
def _(spark, d):
    return _round(inclusion.pair_metrics(messy(spark, d, "messy_orders")["messy_orders"], "customer_id", _t(spark, d, "customer"), "c_custkey", sql_clean))


IND_COLUMNS = "fk_table fk_column pk_table pk_column fk_non_null_rows fk_distinct pk_distinct intersection_distinct matched_rows distinct_coverage row_coverage fk_min fk_max pk_min pk_max".split()


@query("ind_strict_all_pairs", f"{BASE}, {IND} SELECT {', '.join(IND_COLUMNS)} FROM ind")
def _(spark, d):
    return _chain(spark, d)[3].select(*IND_COLUMNS)


NAMES = ["customer_id", "CustomerID", "custId", "orderCustomer", "customer", "id", "o_custkey", "c_custkey", "AccountNo", "account_code", "", "name", "full name"]


_NAMED = (("region", "r_name"), ("nation", "n_name"), ("part", "p_brand"))


@query("name_similarity_pairs", f"WITH n(a) AS (SELECT unnest([{', '.join(repr(n) for n in NAMES)}]) UNION {' UNION '.join(f'SELECT {c} FROM {t}' for t, c in _NAMED)} UNION SELECT unnest([{', '.join(repr(c) for cs in COLUMNS.values() for c in cs)}])) SELECT x.a AS a, y.a AS b, round({sim_sql('x.a', 'y.a')}, 6) AS name_sim FROM n x, n y")
def _(spark, d):
    """All pairs of the tables' column names, some names out of their rows, and names with odd spellings."""
    n = spark.createDataFrame([(x,) for x in (*NAMES, *(c for df in core(spark, d).values() for c in df.columns))], "a string")
    n = reduce(DataFrame.unionByName, [_t(spark, d, t).select(F.col(c).alias("a")) for t, c in _NAMED], n).distinct()
    return n.crossJoin(n.withColumnRenamed("a", "b")).select("a", "b", F.round(names.name_similarity(F.col("a"), F.col("b")), 6).alias("name_sim"))  # names of columns, brands and places: few


SCORE_COLUMNS = ["fk_table", "fk_column", "pk_table", "pk_column"]


@query("score_candidates", f"{CHAIN} SELECT fk_table, fk_column, pk_table, pk_column, round(name_sim, 6) AS name_sim, round(range_penalty, 6) AS range_penalty, small_domain_penalty, measure_penalty, round(score, 6) AS score FROM scored")
def _(spark, d):
    return _round(_chain(spark, d)[4].select(*SCORE_COLUMNS, "name_sim", "range_penalty", "small_domain_penalty", "measure_penalty", "score"))


@query("select_edges_top3", f"{CHAIN} SELECT relationship, cardinality, optional, round(score, 6) AS score FROM edges")
def _(spark, d):
    return _round(_chain(spark, d)[5].select("relationship", "cardinality", "optional", "score"))


@query("relationship_summary", f"{CHAIN} SELECT count(*) AS total, count(*) FILTER (cardinality = 'many_to_one') AS many_to_one, count(*) FILTER (cardinality = 'one_to_one') AS one_to_one, count(*) FILTER (optional) AS optional, count(*) FILTER (NOT optional) AS required FROM edges")
def _(spark, d):
    return selection.relationship_summary(_chain(spark, d)[5])


SOFT = SoftConfig(routing_sim=0.2)
SOFT_TABLES = ("accounts", "payments")
SOFT_PAIRS = [("payments", c, "accounts", p) for c in ("account_no", "account_code", "account_key") for p in ("account_no", "account_ref")]


def _soft(spark, d):
    freq = frequencies(messy(spark, d, *SOFT_TABLES), lambda c: c.cast("string")).persist()
    pairs = spark.createDataFrame([(*p, 0.5) for p in SOFT_PAIRS], "fk_table string, fk_column string, pk_table string, pk_column string, name_sim double")
    return freq, inclusion.soft_matches(freq, pairs, SOFT)


def _soft_sql() -> str:
    src = "\nUNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, trim({c}) AS v FROM {_messy_sql(t)}" for t in SOFT_TABLES for _, c, _ in MESSY[t][1])
    pairs = ", ".join(f"('{a}', '{b}', '{x}', '{y}')" for a, b, x, y in SOFT_PAIRS)
    return f"""WITH raw AS ({src}), f AS (SELECT t, c, v, count(*)::BIGINT AS n FROM raw WHERE v <> '' GROUP BY ALL),
st AS (SELECT t, c, sum(n) FILTER (try_cast(v AS DOUBLE) IS NOT NULL) >= 0.5 * sum(n) AS numeric, coalesce(max(length(v)) FILTER (regexp_matches(v, '^[0-9]+$')), 0) AS digits FROM f GROUP BY 1, 2),
pairs(ft, fc, pt, pc) AS (VALUES {pairs}),
pw AS (SELECT p.*, CASE WHEN greatest(a.digits, b.digits) BETWEEN 2 AND 18 THEN greatest(a.digits, b.digits) ELSE 0 END AS w FROM pairs p JOIN st a ON a.t = ft AND a.c = fc JOIN st b ON b.t = pt AND b.c = pc),
cols AS (SELECT ft AS t, fc AS c, w FROM pw UNION SELECT pt, pc, w FROM pw),
nums AS (SELECT f.t, f.c, f.v, f.n, CASE WHEN numeric AND try_cast(f.v AS DOUBLE) IS NOT NULL THEN cast(cast(try_cast(f.v AS DOUBLE) AS BIGINT) AS VARCHAR) END AS num FROM f JOIN st USING (t, c)),
reps AS (SELECT t, c, 1 AS k, 'raw_str' AS rep, 0 AS w, v AS x, n FROM nums UNION ALL SELECT t, c, 2, 'num_int_str', 0, num, n FROM nums UNION ALL SELECT t, c, 3, 'digits_lstrip_zeros', 0, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN regexp_replace(v, '^0+(.)', '\\1') END, n FROM nums
  UNION ALL SELECT t, c, 4, 'zfill_' || w, w, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN lpad(v, greatest(w, length(v))::INT, '0') ELSE v END, n FROM nums JOIN cols USING (t, c) WHERE w > 1
  UNION ALL SELECT t, c, 5, 'num_int_str_zfill_' || w, w, CASE WHEN regexp_matches(num, '^[0-9]+$') THEN lpad(num, greatest(w, length(num))::INT, '0') ELSE num END, n FROM nums JOIN cols USING (t, c) WHERE w > 1),
r AS (SELECT t, c, k, rep, w, x, sum(n)::BIGINT AS n FROM reps WHERE x IS NOT NULL GROUP BY ALL),
h AS (SELECT t, c, k, w, sum(n)::BIGINT AS total, count(*)::BIGINT AS dist, arg_max(x, n) AS top_x, max(n) AS top_n FROM (SELECT * FROM r ORDER BY x) GROUP BY ALL),
met AS (SELECT ft AS fk_table, fc AS fk_column, pt AS pk_table, pc AS pk_column, a.rep AS fk_rep, b.rep AS pk_rep, a.k AS fk_k, b.k AS pk_k, count(*)::BIGINT AS inter, sum(a.n)::BIGINT AS matched, any_value(h.total) AS total, any_value(h.dist) AS dist, any_value(h.top_n) AS top_n, any_value(h.top_x) AS top_x, max((a.x = h.top_x)::INT) AS top_in
  FROM pw p JOIN r a ON a.t = ft AND a.c = fc AND a.w IN (0, p.w) JOIN r b ON b.t = pt AND b.c = pc AND b.w IN (0, p.w) AND a.x = b.x JOIN h ON h.t = a.t AND h.c = a.c AND h.k = a.k AND h.w = a.w GROUP BY ALL),
m AS (SELECT *, (top_n::DOUBLE / total >= 0.75 AND lower(top_x) IN ('0', '00', '000', '999', '9999', '999999', 'unknown', 'null')) OR (top_n::DOUBLE / total >= 0.9 AND top_in = 0) AS cut FROM met),
best AS (SELECT fk_table, fk_column, pk_table, pk_column, fk_rep, pk_rep, total - CASE WHEN cut THEN top_n ELSE 0 END AS fk_non_null_rows, dist - cut::INT AS fk_distinct, inter - CASE WHEN cut THEN top_in ELSE 0 END AS intersection_distinct, matched - CASE WHEN cut THEN top_n * top_in ELSE 0 END AS matched_rows,
  round(coalesce(intersection_distinct::DOUBLE / nullif(fk_distinct, 0), 0), 6) AS distinct_coverage, round(coalesce(matched_rows::DOUBLE / nullif(fk_non_null_rows, 0), 0), 6) AS row_coverage, cut AS placeholder_dropped, fk_k, pk_k, total FROM m)"""


@query("soft_best_representation", _soft_sql() + " SELECT fk_table, fk_column, pk_table, pk_column, fk_rep, pk_rep, fk_non_null_rows::BIGINT AS fk_non_null_rows, fk_distinct::BIGINT AS fk_distinct, intersection_distinct::BIGINT AS intersection_distinct, matched_rows::BIGINT AS matched_rows, distinct_coverage, row_coverage FROM best WHERE intersection_distinct > 0 QUALIFY row_number() OVER (PARTITION BY fk_column, pk_column ORDER BY intersection_distinct::DOUBLE / fk_distinct DESC, matched_rows::DOUBLE / fk_non_null_rows DESC, fk_k, pk_k) = 1")
def _(spark, d):
    best = inclusion.best_representation(_soft(spark, d)[1])
    return _round(best.select("fk_table", "fk_column", "pk_table", "pk_column", "fk_rep", "pk_rep", "fk_non_null_rows", "fk_distinct", "intersection_distinct", "matched_rows", "distinct_coverage", "row_coverage"))


@query("soft_placeholder_drop", _soft_sql() + " SELECT fk_column, pk_column, fk_rep, pk_rep, fk_non_null_rows::BIGINT AS fk_non_null_rows, matched_rows::BIGINT AS matched_rows, distinct_coverage, row_coverage FROM best WHERE fk_column = 'account_code'")
def _(spark, d):
    m = _soft(spark, d)[1].where("fk_column = 'account_code'")
    return _round(m.select("fk_column", "pk_column", "fk_rep", "pk_rep", "fk_non_null_rows", "matched_rows", "distinct_coverage", "row_coverage"))


def _routed(spark, d):
    p = profile.profile(frequencies(core(spark, d) | messy(spark, d, "messy_orders", "messy_customers", *SOFT_TABLES)))
    return inclusion.route_pairs(inclusion.soft_children(p), inclusion.soft_parents(p, keys.unary_ucc(p)), SoftConfig(max_parents=5))


ROUTED = (*COLUMNS, "messy_orders", "messy_customers", *SOFT_TABLES)


@query("soft_routing_topk", f"""WITH {freq_sql(ROUTED)}, {PROF}, named AS (SELECT * FROM prof WHERE regexp_matches(lower(column_name), '{SoftConfig().key_pattern}') AND null_ratio <= 0.95 AND n_unique >= 10 AND NOT (n_unique <= 50 AND top1_ratio > 0.9)),
parents AS (SELECT table_name, column_name FROM ucc WHERE n_rows >= 20 AND n_non_null::DOUBLE / n_rows >= 0.3 AND unique_ratio >= 0.6 UNION SELECT table_name, column_name FROM named),
x AS (SELECT c.table_name AS fk_table, c.column_name AS fk_column, p.table_name AS pk_table, p.column_name AS pk_column, {sim_sql('c.column_name', 'p.column_name')} AS sim, prefix(lower(p.table_name), lower(c.table_name)[1:3]) AS near FROM named c JOIN parents p ON c.table_name <> p.table_name),
y AS (SELECT *, max(sim) OVER (PARTITION BY fk_table, fk_column) >= 0.3 AS any_named FROM x)
SELECT fk_table, fk_column, pk_table, pk_column, round(CASE WHEN any_named THEN sim ELSE 0 END, 6)::DOUBLE AS name_sim FROM y WHERE any_named = (sim >= 0.3)
QUALIFY row_number() OVER (PARTITION BY fk_table, fk_column ORDER BY CASE WHEN any_named THEN sim ELSE near::INT END DESC, pk_table, pk_column) <= 5""")
def _(spark, d):
    return _round(_routed(spark, d))


@query("soft_rejects", _soft_sql() + """, one AS (SELECT b.*, h.top_n::DOUBLE / h.total AS top1 FROM best b JOIN h ON h.t = fk_table AND h.c = fk_column AND h.k = fk_k AND h.total = b.total WHERE intersection_distinct > 0
  QUALIFY row_number() OVER (PARTITION BY fk_column, pk_column ORDER BY intersection_distinct::DOUBLE / fk_distinct DESC, matched_rows::DOUBLE / fk_non_null_rows DESC, fk_k, pk_k) = 1)
SELECT fk_column, pk_column, CASE WHEN fk_distinct <= 30 AND top1 >= 0.5 THEN 'small_domain_guard' WHEN NOT ((distinct_coverage >= 0.8 AND row_coverage >= 0.8) OR (distinct_coverage >= 0.95 AND row_coverage >= 0.6) OR (distinct_coverage >= 0.8 AND matched_rows >= 200)) THEN 'coverage_fail' ELSE 'accepted' END AS reason FROM one""")
def _(spark, d):
    v = inclusion.soft_verdict(inclusion.best_representation(_soft(spark, d)[1]), SOFT)
    return v.select("fk_column", "pk_column", F.coalesce("reason", F.lit("accepted")).alias("reason"))


BOUNDS = ("fk_min", "fk_max", "pk_min", "pk_max")


@query("soft_scores_range_penalty", _soft_sql() + f""", one AS (SELECT * FROM best WHERE intersection_distinct > 0 QUALIFY row_number() OVER (PARTITION BY fk_column, pk_column ORDER BY intersection_distinct::DOUBLE / fk_distinct DESC, matched_rows::DOUBLE / fk_non_null_rows DESC, fk_k, pk_k) = 1),
bd AS (SELECT t, c, rep, min(try_cast(x AS DOUBLE)) AS lo, max(try_cast(x AS DOUBLE)) AS hi FROM r GROUP BY ALL),
b AS (SELECT o.*, f.lo AS fk_min, f.hi AS fk_max, g.lo AS pk_min, g.hi AS pk_max, {sim_sql("fk_column", "pk_column")} AS name_sim FROM one o JOIN bd f ON f.t = fk_table AND f.c = fk_column AND f.rep = fk_rep JOIN bd g ON g.t = pk_table AND g.c = pk_column AND g.rep = pk_rep),
p AS (SELECT *, CASE WHEN fk_min IS NULL OR pk_min IS NULL THEN 0.0 ELSE log10(greatest(1.0, greatest(1, pk_max - pk_min + 1)::DOUBLE / greatest(1, fk_max - fk_min + 1))) END AS wide, least(0.95, wide / (1 + wide)) * least(1.0, 2000.0::DOUBLE / greatest(1, fk_distinct)) AS range_penalty FROM b)
SELECT fk_column, pk_column, fk_rep, pk_rep, {", ".join(f"round({c}, 6) AS {c}" for c in BOUNDS)}, round(range_penalty, 6) AS range_penalty,
  round(greatest(0.0, least(1.0, 0.75 * (intersection_distinct::DOUBLE / fk_distinct) + 0.2 * (matched_rows::DOUBLE / fk_non_null_rows) + 0.05 * name_sim - 0.1 * range_penalty)), 6)::DOUBLE AS score FROM p""")
def _(spark, d):
    """The range penalty of soft inclusions takes the bounds of the representations that won."""
    best = inclusion.best_representation(_soft(spark, d)[1])
    return _round(selection.score(best.drop("name_sim")).select("fk_column", "pk_column", "fk_rep", "pk_rep", *BOUNDS, "range_penalty", "score"))


UNTESTED = [
    ("sparse", "account_no", "accounts", "account_no"),
    ("sparse", "account_tag", "accounts", "account_no"),
    ("sparse", "account_tag", "nowhere", "account_no"),
    ("sparse", "no_column", "accounts", "account_no"),
    ("payments", "account_no", "accounts", "account_ref"),
]
SPARSE = {"account_no": "CASE WHEN c_custkey <= 5 THEN cast(c_custkey AS {text}) ELSE ' ' END", "account_tag": "concat('x', cast(c_custkey AS {text}))"}
UNTESTED_SRC = " UNION ALL ".join([f"SELECT 'sparse' AS t, '{c}' AS c, trim({_expr(e, 'VARCHAR')}) AS v FROM customer" for c, e in SPARSE.items()] + [f"SELECT '{t}' AS t, '{c}' AS c, trim({c}) AS v FROM {_messy_sql(t)}" for t in SOFT_TABLES for _, c, _ in MESSY[t][1]])


@query("soft_untested_pairs", f"""WITH src AS ({UNTESTED_SRC}), e AS (SELECT t, c, count(*) FILTER (v <> '') AS eff FROM src GROUP BY ALL), p(fk_table, fk_column, pk_table, pk_column) AS (VALUES {', '.join(map(str, UNTESTED))})
SELECT p.*, CASE WHEN fk_table NOT IN (SELECT t FROM e) OR pk_table NOT IN (SELECT t FROM e) THEN 'table_missing' WHEN f.eff IS NULL OR k.eff IS NULL THEN 'column_missing' WHEN least(f.eff, k.eff) < {SOFT.min_non_null} THEN 'min_non_null_effective' ELSE 'no_representation_match' END AS reason
FROM p LEFT JOIN e f ON f.t = fk_table AND f.c = fk_column LEFT JOIN e k ON k.t = pk_table AND k.c = pk_column
WHERE NOT EXISTS (SELECT 1 FROM src a JOIN src b ON a.v = b.v AND a.v <> '' WHERE a.t = fk_table AND a.c = fk_column AND b.t = pk_table AND b.c = pk_column)""")
def _(spark, d):
    sparse = _t(spark, d, "customer").selectExpr(*(f"{_expr(e, 'string')} AS {c}" for c, e in SPARSE.items()))
    freq = frequencies(messy(spark, d, *SOFT_TABLES) | {"sparse": sparse}, lambda c: c.cast("string")).persist()
    pairs = spark.createDataFrame([(*p, 0.5) for p in UNTESTED], "fk_table string, fk_column string, pk_table string, pk_column string, name_sim double")
    return inclusion.untested_pairs(freq, pairs, inclusion.best_representation(inclusion.soft_matches(freq, pairs, SOFT)), SOFT).drop("name_sim")


# Quality --------------------------------------------------------------------------------------------------------------------
O, C = _messy_sql("messy_orders"), _messy_sql("messy_customers")
CHILD = f"(SELECT {SQL_CLEAN.format(c='customer_id')} AS v FROM {O})"
PARENT = f"(SELECT {SQL_CLEAN.format(c='customer_id')} AS v FROM {C} WHERE customer_id % 17 > 0)"


def _parents(spark, d):
    return messy(spark, d, "messy_customers")["messy_customers"].where("customer_id % 17 > 0")


def _orders(spark, d):
    return messy(spark, d, "messy_orders")["messy_orders"]


@query("orphan_fk", f"SELECT v, count(*) AS cnt FROM {CHILD} WHERE v IS NOT NULL AND v NOT IN (SELECT v FROM {PARENT}) GROUP BY v")
def _(spark, d):
    return quality.orphans(_orders(spark, d), "customer_id", _parents(spark, d), "customer_id")


@query("missing_children", f"SELECT DISTINCT v FROM {PARENT} WHERE v NOT IN (SELECT v FROM {CHILD} WHERE v IS NOT NULL)")
def _(spark, d):
    return quality.childless(_orders(spark, d), "customer_id", _parents(spark, d), "customer_id")


EDGE = {"fk_table": "messy_orders", "fk_column": "customer_id", "pk_table": "messy_customers", "pk_column": "customer_id", "optional": False, "score": 0.93, "name_sim": 1.0, "range_penalty": 0.0}


@query("rel_missing_classified", f"""WITH c AS (SELECT * FROM {CHILD} WHERE v IS NOT NULL), p AS (SELECT DISTINCT v FROM {PARENT}), o AS (SELECT * FROM c WHERE v NOT IN (SELECT v FROM p)), m AS (SELECT * FROM p WHERE v NOT IN (SELECT v FROM c)),
  s AS (SELECT (SELECT count(*) FROM c) AS fk_rows, (SELECT count(*) FROM o) AS orphan_fk_rows, (SELECT count(*) FROM p) AS parents, (SELECT count(*) FROM m) AS parents_missing_children),
  r AS (SELECT *, round(orphan_fk_rows::DOUBLE / fk_rows, 6) AS orphan_fk_ratio, round(parents_missing_children::DOUBLE / parents, 6) AS parents_missing_children_ratio,
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM o ORDER BY v LIMIT 10)) AS orphan_examples FROM s)
SELECT *, CASE WHEN orphan_fk_ratio >= 0.05 OR parents_missing_children_ratio >= 0.2 THEN 'fail' WHEN orphan_fk_ratio >= 0.01 OR parents_missing_children_ratio >= 0.05 THEN 'warning' ELSE 'ok' END AS status,
  array_to_string(list_filter([CASE WHEN orphan_fk_rows > 0 AND list_has_any(string_split(orphan_examples, ','), ['0', '-1', '999999', '9999', '999', '99999', '888888']) THEN 'sentinel_or_default_fk_values' END, CASE WHEN parents_missing_children > 0 THEN 'child_table_incomplete_or_filtered' END,
    CASE WHEN orphan_fk_rows > 0 THEN 'type_or_format_mismatch_or_missing_parent_rows' END, CASE WHEN orphan_fk_rows > 0 OR parents_missing_children > 0 THEN 'edge_may_be_wrong_or_accidental_match' END], lambda x: x IS NOT NULL), ',') AS likely_causes FROM r""")
def _(spark, d):
    r = quality.missing_for_edges({"messy_orders": _orders(spark, d), "messy_customers": _parents(spark, d)}, [EDGE])
    return _round(r.select("fk_rows", "orphan_fk_rows", "parents", "parents_missing_children", "orphan_fk_ratio", "parents_missing_children_ratio", "orphan_examples", "status", "likely_causes"))


TWICE = f"(SELECT * FROM {C} UNION ALL SELECT * FROM {C} WHERE customer_id % 150 = 0)"


def _twice(spark, d):
    c = messy(spark, d, "messy_customers")["messy_customers"]
    return c.unionByName(c.where("customer_id % 150 = 0"))


def _dup_sql(c: str, least: float) -> str:
    return f"""WITH f AS (SELECT cast({c} AS VARCHAR) AS v, count(*) AS k FROM {TWICE} GROUP BY 1) SELECT 'customers' AS table_name, '{c}' AS column_name, (sum(k - 1) FILTER (k > 1))::BIGINT AS duplicate_rows, count(*) FILTER (k > 1) AS duplicate_values, round((sum(k - 1) FILTER (k > 1))::DOUBLE / sum(k), 6) AS duplicate_ratio FROM f
HAVING count(*)::DOUBLE / sum(k) >= {least} AND max(k) > 1"""


def _dups(spark, d, natural):
    freq = frequencies({"customers": _twice(spark, d)})
    return quality.key_duplicates(freq, profile.profile(freq), natural).drop("examples")


@query("dup_key_values", _dup_sql("customer_id", 0.98))
def _(spark, d):
    return _dups(spark, d, False)


@query("dup_natural_key_values", _dup_sql("email2", 0.7).replace("email2", "email_alt").replace(TWICE, f"(SELECT CASE WHEN customer_id % 4 = 0 THEN 'u' || (customer_id - 1) ELSE 'u' || customer_id END AS email_alt FROM {C})"))
def _(spark, d):
    c = messy(spark, d, "messy_customers")["messy_customers"].selectExpr("CASE WHEN customer_id % 4 = 0 THEN concat('u', customer_id - 1) ELSE concat('u', customer_id) END AS email_alt")
    freq = frequencies({"customers": c})
    return quality.key_duplicates(freq, profile.profile(freq), True).drop("examples")


OVER = ("messy_orders", "messy_customers")


def _overlap_sql(rule: str, tables=OVER) -> str:
    return f"""WITH {freq_sql(tables)}, n AS (SELECT table_name, column_name, count(*) AS n FROM freq WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT a.table_name AS table_a, a.column_name AS column_a, b.table_name AS table_b, b.column_name AS column_b, count(*) AS shared, any_value(x.n) AS n_a, any_value(y.n) AS n_b, round(count(*)::DOUBLE / least(any_value(x.n), any_value(y.n)), 6) AS overlap_ratio
FROM freq a JOIN freq b ON a.v = b.v AND {rule} JOIN n x ON x.table_name = a.table_name AND x.column_name = a.column_name JOIN n y ON y.table_name = b.table_name AND y.column_name = b.column_name GROUP BY 1, 2, 3, 4 HAVING count(*)::DOUBLE / least(any_value(x.n), any_value(y.n)) >= 0.1"""


def _overlap(spark, d, tables=OVER, **how):
    freq = frequencies(core(spark, d) | messy(spark, d, *MESSY) if tables is None else messy(spark, d, *(t for t in tables if t in MESSY)) | {t: x for t, x in core(spark, d).items() if t in tables}).persist()
    return quality.overlaps(freq, small(profile.profile(freq)), **how)


@query("overlap_same_name", _overlap_sql("a.table_name < b.table_name AND a.column_name = b.column_name"))
def _(spark, d):
    return _overlap(spark, d, same_name=True)


OVER2 = ("nation", "supplier", "customer", "part")


@query("overlap_any_name", _overlap_sql("a.table_name < b.table_name", OVER2))
def _(spark, d):
    return _overlap(spark, d, OVER2)


@query("within_table_id_reuse", _overlap_sql("a.table_name = b.table_name AND a.column_name < b.column_name", ("lineitem", "orders")))
def _(spark, d):
    return _overlap(spark, d, ("lineitem", "orders"), within=True)


def _least(cte: str, by: str) -> str:
    return f"SELECT {by}, string_agg(v, ',' ORDER BY v) AS examples FROM (SELECT DISTINCT {by}, v FROM {cte} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY v) <= 10) GROUP BY {by}"


@query("overlap_examples", f"WITH {freq_sql(OVER2)}, n AS (SELECT table_name, column_name, count(*) AS n FROM freq WHERE v IS NOT NULL GROUP BY 1, 2), met AS (SELECT a.table_name AS table_a, a.column_name AS column_a, b.table_name AS table_b, b.column_name AS column_b, a.v FROM freq a JOIN freq b ON a.v = b.v AND a.table_name < b.table_name), "
    "ok AS (SELECT table_a, column_a, table_b, column_b FROM met m JOIN n x ON x.table_name = table_a AND x.column_name = column_a JOIN n y ON y.table_name = table_b AND y.column_name = column_b GROUP BY ALL HAVING count(*)::DOUBLE / least(any_value(x.n), any_value(y.n)) >= 0.1), "
    f"e AS ({_least('met', 'table_a, column_a, table_b, column_b')}) SELECT e.* FROM e JOIN ok USING (table_a, column_a, table_b, column_b)")  # fmt: skip
def _(spark, d):
    """The ten smallest values that overlapping columns share."""
    freq = frequencies({t: x for t, x in core(spark, d).items() if t in OVER2}).persist()
    found = quality.with_examples(quality.overlaps(freq, small(profile.profile(freq))), freq)
    return _round(found.select("table_a", "column_a", "table_b", "column_b", "examples"))


TYPED_SETS = {"lots": ("orders", "o_orderkey % 100 AS code, cast(o_orderkey % 40 AS {text}) AS label"), "parts": ("customer", "cast(c_custkey % 50 AS double) AS code_float, c_custkey % 50 + 0.5 * (c_custkey % 2) AS mixed, concat(' ', cast(c_custkey % 30 AS {text}), ' ') AS tag")}
_SETS = [("lots", "code", "cast(o_orderkey % 100 AS VARCHAR)", "orders"), ("lots", "label", "cast(o_orderkey % 40 AS VARCHAR)", "orders"), ("parts", "code_float", "cast(c_custkey % 50 AS VARCHAR)", "customer"), ("parts", "mixed", "cast((c_custkey % 50 + 0.5 * (c_custkey % 2))::DOUBLE AS VARCHAR)", "customer"), ("parts", "tag", "cast(c_custkey % 30 AS VARCHAR)", "customer")]


@query("overlap_int_float", "WITH f AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {e} AS v FROM {b}" for t, c, e, b in _SETS) + "), n AS (SELECT t, c, count(*) AS n FROM f GROUP BY ALL) SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS shared, any_value(x.n) AS n_a, any_value(y.n) AS n_b, round(count(*)::DOUBLE / least(any_value(x.n), any_value(y.n)), 6) AS overlap_ratio FROM f a JOIN f b ON a.v = b.v AND a.t < b.t JOIN n x ON x.t = a.t AND x.c = a.c JOIN n y ON y.t = b.t AND y.c = b.c GROUP BY ALL HAVING overlap_ratio >= 0.1")
def _(spark, d):
    """Numbers of an integer column, of a float column without fractions, and of text meet; those of a column with fractions keep theirs."""
    freq = frequencies({t: _t(spark, d, b).selectExpr(*_expr(e, "string").split(", ")) if t == "lots" else _t(spark, d, b).selectExpr("cast(c_custkey % 50 AS double) AS code_float", "cast(c_custkey % 50 + 0.5 * (c_custkey % 2) AS double) AS mixed", "concat(' ', cast(c_custkey % 30 AS string), ' ') AS tag") for t, (b, e) in TYPED_SETS.items()})
    return quality.overlaps(freq, profile.profile(freq))


EXAMPLE_ROW = "'{' || '\"customer_id\":' || customer_id || ',\"email\":\"' || email || '\"}'"


@query("identity_examples", f"""WITH c AS (SELECT coalesce(trim(email), '') AS signature, customer_id, full_name, email FROM {C}), b AS (SELECT signature FROM c GROUP BY 1 HAVING count(DISTINCT customer_id) > 1), b2 AS (SELECT signature FROM c GROUP BY 1 HAVING count(DISTINCT full_name) > 1),
r AS (SELECT 'customer_id' AS id_column, signature, {EXAMPLE_ROW} AS r, row_number() OVER (PARTITION BY signature ORDER BY customer_id) AS k FROM c WHERE signature IN (SELECT signature FROM b)),
r2 AS (SELECT 'full_name', signature, '{{' || '"full_name":"' || full_name || '","email":"' || email || '"}}' AS r, row_number() OVER (PARTITION BY signature ORDER BY full_name) AS k FROM (SELECT DISTINCT signature, full_name, email FROM c WHERE signature IN (SELECT signature FROM b2))),
a AS (SELECT * FROM r WHERE k <= 3 UNION ALL SELECT * FROM r2 WHERE k <= 3)
SELECT signature, string_agg(r, ',' ORDER BY r) AS example_rows FROM (SELECT signature, r, row_number() OVER (PARTITION BY signature ORDER BY r) AS k FROM (SELECT DISTINCT signature, r FROM a)) WHERE k <= 4 GROUP BY 1""")
def _(spark, d):
    """Example rows of conflicting ids, three for each id column, and the first four of those merged for each signature."""
    c = messy(spark, d, "messy_customers")["messy_customers"]
    parts = [quality.with_example_rows(quality.signature_conflicts(c, i, ["email"]), c, i, ["email"], 3) for i in ("customer_id", "full_name")]
    return _round(quality.collapse_signatures(parts[0].unionByName(parts[1]), 4).select("signature", "example_rows"))


SIG = "SELECT coalesce(trim(email), '') AS signature, count(DISTINCT customer_id) AS distinct_ids, count(*) AS n_rows, min(cast(customer_id AS VARCHAR)) AS first_id, 'customer_id' AS id_column FROM {0} GROUP BY 1 HAVING count(DISTINCT customer_id) > 1".format(C)
SIG2 = "SELECT coalesce(trim(email), '') AS signature, count(DISTINCT full_name) AS distinct_ids, count(*) AS n_rows, min(full_name) AS first_id, 'full_name' AS id_column FROM {0} GROUP BY 1 HAVING count(DISTINCT full_name) > 1".format(C)
COLLAPSED = f"SELECT signature, string_agg(DISTINCT id_column, ',' ORDER BY id_column) AS id_columns, max(distinct_ids) AS max_distinct_ids, max(n_rows) AS n_rows FROM ({SIG} UNION ALL {SIG2}) GROUP BY 1"


def _signatures(spark, d):
    c = messy(spark, d, "messy_customers")["messy_customers"]
    return quality.signature_conflicts(c, "customer_id", ["email"]).unionByName(quality.signature_conflicts(c, "full_name", ["email"]))


@query("signature_multi_ids", SIG)
def _(spark, d):
    return quality.signature_conflicts(messy(spark, d, "messy_customers")["messy_customers"], "customer_id", ["email"]).drop("signature_columns")


@query("signature_collapsed", COLLAPSED)
def _(spark, d):
    return quality.collapse_signatures(_signatures(spark, d))


@query("signature_summary", f"SELECT count(*) AS signatures, max(max_distinct_ids) AS max_distinct_ids, 'customer_id,full_name' AS id_columns FROM ({COLLAPSED})")
def _(spark, d):
    return quality.summarise_signatures(quality.collapse_signatures(_signatures(spark, d)))


def _rows_sql(cols: str) -> str:
    return f"SELECT sum(k)::BIGINT AS n_rows, sum(k - 1)::BIGINT AS duplicate_rows, count(*) FILTER (k > 1) AS duplicate_groups, round(sum(k - 1)::DOUBLE / sum(k), 6) AS duplicate_ratio FROM (SELECT count(*) AS k FROM {TWICE} GROUP BY {cols})"


@query("exact_duplicate_rows", _rows_sql("ALL").replace("SELECT count(*) AS k FROM", "SELECT customer_id, email, segment, full_name, count(*) AS k FROM"))
def _(spark, d):
    return quality.duplicate_rows(_twice(spark, d))


@query("subset_duplicate_rows", _rows_sql("email, segment"))
def _(spark, d):
    return quality.duplicate_rows(_twice(spark, d), ["email", "segment", "no_such_column"])


@query("relationship_edge_dups", f"SELECT customer_id AS left_value, email AS right_value, count(*) AS n FROM {TWICE} GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return quality.repeated_links(_twice(spark, d), "customer_id", "email")


@query("cardinality_violations", f"SELECT 'left' AS side, cast(customer_id AS VARCHAR) AS value, count(DISTINCT email) AS partners FROM {C} GROUP BY customer_id HAVING count(DISTINCT email) > 1 UNION ALL SELECT 'right', email, count(DISTINCT customer_id) FROM {C} GROUP BY email HAVING count(DISTINCT customer_id) > 1")
def _(spark, d):
    return quality.cardinality_violations(messy(spark, d, "messy_customers")["messy_customers"], "customer_id", "email")


@query("duplicate_preview_keep_false", f"SELECT *, count(*) OVER (PARTITION BY email, segment) AS group_size FROM {TWICE} QUALIFY group_size > 1")
def _(spark, d):
    return quality.duplicate_preview(_twice(spark, d), ["email", "segment"])


def _default_sql(extra: str = "", select: str = "", partner: str = "NULL::BIGINT") -> str:
    return f"""WITH c AS (SELECT {SQL_CLEAN.format(c='customer_id')} AS v, order_id FROM {O}), f AS (SELECT v, count(*) AS cnt FROM c WHERE v IS NOT NULL GROUP BY v), t AS (SELECT *, sum(cnt) OVER () AS total, count(*) OVER () AS fk_distinct FROM f),
k AS (SELECT * FROM t ORDER BY cnt DESC, v LIMIT 3), s AS (SELECT v, cnt, cnt::DOUBLE / total AS q, v IN (SELECT v FROM {PARENT}) AS in_parent, try_cast(v AS BIGINT) IN (-1, 0, 99, 999, 9999, 99999, 999999, 88, 8888, 888888) AS sentinel, fk_distinct, {partner} AS partner_distinct FROM k),
r AS (SELECT *, CASE WHEN fk_distinct <= 5 AND NOT sentinel THEN [] ELSE list_filter([CASE WHEN q >= 0.2 AND NOT in_parent THEN 'high_frequency_orphan_value' END, CASE WHEN q >= 0.2 AND sentinel THEN 'high_frequency_sentinel_value' END, CASE WHEN q >= 0.5 AND fk_distinct > 5 THEN 'extreme_bucket_share' END, CASE WHEN q >= 0.2 AND partner_distinct IS NOT NULL THEN 'pairs_with_many_distinct_partner_ids' END], lambda x: x IS NOT NULL) END AS why FROM s)
SELECT v, cnt, round(q, 6) AS ratio, in_parent, sentinel, fk_distinct, partner_distinct, array_to_string(why, ',') AS reasons, len(why) > 0 AS flagged{select} FROM r"""


@query("default_fk_topk", _default_sql())
def _(spark, d):
    return _round(quality.default_keys(_orders(spark, d), "customer_id", _parents(spark, d), "customer_id"))


@query("default_fk_pairing_variance", _default_sql(partner="(SELECT CASE WHEN count(DISTINCT order_id) >= 10 AND count(DISTINCT order_id)::DOUBLE / (SELECT count(DISTINCT order_id) FROM c WHERE v IS NOT NULL) >= 0.2 THEN count(DISTINCT order_id) END FROM c WHERE c.v = k.v)"))
def _(spark, d):
    return _round(quality.default_keys(_orders(spark, d), "customer_id", _parents(spark, d), "customer_id", partners=("order_id",)))


@query("default_fk_dummy_parent", f"""WITH c AS (SELECT CASE WHEN o_orderkey % 10 < 6 THEN 1 ELSE o_custkey END AS v FROM orders), f AS (SELECT v, count(*) AS cnt FROM c GROUP BY v), t AS (SELECT *, sum(cnt) OVER () AS total FROM f), k AS (SELECT * FROM t ORDER BY cnt DESC, cast(v AS VARCHAR) LIMIT 3)
SELECT cast(v AS VARCHAR) AS v, cnt, round(cnt::DOUBLE / total, 6) AS ratio, cnt::DOUBLE / total >= 0.5 AS flagged, cnt::DOUBLE / total >= 0.5 AND EXISTS (SELECT 1 FROM {C} p WHERE p.customer_id = k.v AND regexp_matches(lower(full_name), 'unknown|default|misc|n/a|\\bna\\b')) AS dummy_parent FROM k""")
def _(spark, d):
    child = _t(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 10 < 6 THEN 1 ELSE o_custkey END AS customer_id")
    r = quality.default_keys(child, "customer_id", messy(spark, d, "messy_customers")["messy_customers"], "customer_id", labels=("full_name",), cfg=DefaultConfig())
    return _round(r.select("v", "cnt", "ratio", "flagged", "dummy_parent"))


# Types ----------------------------------------------------------------------------------------------------------------------
TYPED = [("cast(o_orderkey AS {text})", "num"), ("CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END", "flag"), ("concat('1995-0', cast(1 + o_orderkey % 9 AS {text}), '-1', cast(o_orderkey % 10 AS {text}))", "day"), ("concat('$', cast(o_orderkey AS {text}), '.5')", "price"), ("o_orderpriority", "txt"), ("CASE WHEN o_orderkey % 3 = 0 THEN 'x1' ELSE cast(o_orderkey % 7 AS {text}) END", "mixed")]
TYPED_SQL = "(SELECT " + ", ".join(f"{_expr(e, 'VARCHAR')} AS {c}" for e, c in TYPED) + " FROM orders)"


def _typed(spark, d):
    return _t(spark, d, "orders").selectExpr(*(f"{_expr(e, 'string')} AS {c}" for e, c in TYPED))


NUM = "try_cast(regexp_replace(v, '[$£€¥%,_\\s]', '', 'g') AS DOUBLE)"
DATE = "(regexp_matches(v, '^[12][0-9]{3}$') OR try_strptime(v, '%Y-%m-%d') IS NOT NULL OR (regexp_matches(v, '^[12][0-9]{7}$') AND try_strptime(v, '%Y%m%d') IS NOT NULL))"
RATIOS = f"""WITH u AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM {TYPED_SQL}" for _, c in TYPED)}), x AS (SELECT column_name, lower(trim(v)) IN ('true', 't', 'yes', 'y', '1', 'on', 'false', 'f', 'no', 'n', '0', 'off') AS b, {DATE} AS d, {NUM} AS n FROM u),
r AS (SELECT column_name, avg(b::INT) AS bool_ratio, avg(d::INT) AS date_ratio, avg((n IS NOT NULL)::INT) AS numeric_ratio, coalesce(avg((abs(n - round_even(n, 0)) <= 1e-9::DOUBLE + 1e-5::DOUBLE * abs(round_even(n, 0)))::INT) FILTER (n IS NOT NULL), 0) AS int_ratio FROM x GROUP BY 1)"""


@query("atomic_type_ratios", f"{RATIOS} SELECT column_name, round(bool_ratio, 6) AS bool_ratio, round(date_ratio, 6) AS date_ratio, round(numeric_ratio, 6) AS numeric_ratio, round(int_ratio, 6) AS int_ratio FROM r")
def _(spark, d):
    return _round(profile.type_ratios(frequencies({"t": _typed(spark, d)})).drop("table_name"))


@query("atomic_type_decision", f"{RATIOS} SELECT column_name, CASE WHEN bool_ratio >= 0.95 THEN 'bool' WHEN date_ratio >= 0.9 THEN 'date' WHEN numeric_ratio >= 0.98 AND int_ratio >= 0.98 THEN 'int' WHEN numeric_ratio >= 0.98 THEN 'float' ELSE 'string' END AS atomic_type, round(CASE WHEN bool_ratio >= 0.95 THEN bool_ratio WHEN date_ratio >= 0.9 THEN date_ratio WHEN numeric_ratio >= 0.98 THEN numeric_ratio ELSE 1 - greatest(bool_ratio, date_ratio, numeric_ratio) END, 6) AS atomic_prob FROM r")
def _(spark, d):
    return _round(profile.decide_types(profile.type_ratios(frequencies({"t": _typed(spark, d)}))).select("column_name", "atomic_type", "atomic_prob"))


@query("convert_types", f"SELECT num::BIGINT AS num, flag = 'Yes' AS flag, strptime(day, '%Y-%m-%d')::TIMESTAMP AS day, replace(price, '$', '')::DOUBLE AS price, txt FROM {TYPED_SQL}")
def _(spark, d):
    return profile.convert(_typed(spark, d).drop("mixed"), {"num": "int", "flag": "bool", "day": "date", "price": "float"}).withColumn("day", F.col("day").cast("timestamp_ntz"))


#: Texts of an order's date in several formats, and what shows their order: name, format in SQL, mask, order, whether only days up to 12 are taken.
DAYS = [
    ("eu", "%d-%m-%Y", "99-99-9999", "dmy", ""),
    ("us", "%m/%d/%Y", "99/99/9999", "mdy", ""),
    ("open", "%d.%m.%Y", "99.99.9999", "mdy", "day(o_orderdate) > 12"),
    ("named", "%d %b %Y", "99 aaa 9999", "ymd", ""),
    ("stamp", "%b %d, %Y %I:%M %p", "aaa 99, 9999 99:99 aa", "ymd", ""),
    ("iso", "%Y-%m-%dT%H:%M:%S", "9999-99-99a99:99:99", "ymd", ""),
]
_SPARK_DAY = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%b": "MMM", "%I": "hh", "%M": "mm", "%p": "a", "%H": "HH", "%S": "ss"}
MIX = "CASE WHEN o_orderkey % 3 = 0 THEN {iso} WHEN o_orderkey % 3 = 1 THEN {eu} ELSE concat('no day ', cast(o_orderkey AS {text})) END"


def _day(fmt: str, spark: bool) -> str:
    if not spark:
        return f"strftime(o_orderdate, '{fmt}')"
    for a, b in _SPARK_DAY.items():
        fmt = fmt.replace(a, b)
    return f"date_format(o_orderdate, {json.dumps(fmt.replace('T', chr(39) + 'T' + chr(39)))})"


def _days(spark: bool) -> list[tuple[str, str]]:
    cols = [(n, f"CASE WHEN {skip} THEN NULL ELSE {_day(f, spark)} END" if skip else _day(f, spark)) for n, f, _, _, skip in DAYS]
    mix = MIX.format(iso=_day("%Y-%m-%d", spark), eu=_day("%d/%m/%Y", spark), text="string" if spark else "VARCHAR")
    return [*cols, ("mix", mix)]


def _days_sql() -> str:
    midnight = "o_orderdate::DATE::TIMESTAMP"
    parts = [(n, m, o, f"NOT ({skip})" if skip else "true", "make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))::TIMESTAMP" if n == "open" else midnight) for n, _, m, o, skip in DAYS]
    parts += [("mix", "9999-99-99", "ymd", "o_orderkey % 3 = 0", midnight), ("mix", "99/99/9999", "dmy", "o_orderkey % 3 = 1", midnight)]
    return " UNION ALL ".join(f"SELECT '{n}' AS column_name, '{m}' AS mask, '{o}' AS \"order\", count(*) AS cells, count(*) AS dates, strftime(min(t), '%Y-%m-%d %H:%M') AS date_min, strftime(max(t), '%Y-%m-%d %H:%M') AS date_max FROM (SELECT {t} AS t FROM orders WHERE {w})" for n, m, o, w, t in parts)


@query("date_formats_induced", _days_sql())
def _(spark, d):
    """Formats of dates by masks: day-first, month-first, open and named ones, times, and two formats in one column."""
    days = _t(spark, d, "orders").selectExpr(*(f"{e} AS {n}" for n, e in _days(True)))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return profile.induced_dates(frequencies({"days": days})).select("column_name", "mask", "order", "cells", "dates", iso("date_min"), iso("date_max"))


@query("date_types_and_values", f"""WITH t AS (SELECT o_orderkey, {", ".join(f"{e} AS {n}" for n, e in _days(False))} FROM orders)
SELECT o_orderkey, strftime(strptime(eu, '%d-%m-%Y'), '%Y-%m-%d') AS eu, strftime(strptime(us, '%m/%d/%Y'), '%Y-%m-%d') AS us, strftime(strptime(named, '%d %b %Y'), '%Y-%m-%d') AS named, strftime(coalesce(try_strptime(mix, '%Y-%m-%d'), try_strptime(mix, '%d/%m/%Y')), '%Y-%m-%d') AS mix FROM t""")
def _(spark, d):
    """Texts become dates by the induced order of their mask."""
    t = _t(spark, d, "orders").selectExpr("o_orderkey", *(f"{e} AS {n}" for n, e in _days(True))).select("o_orderkey", "eu", "us", "named", "mix")
    orders = profile.induced_dates(frequencies({"t": t}))
    out = profile.convert(t, {"o_orderkey": "int", **dict.fromkeys(("eu", "us", "named", "mix"), "date")}, orders)
    return out.select("o_orderkey", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("eu", "us", "named", "mix")))


# Previews -------------------------------------------------------------------------------------------------------------------
PLACES = "concat(o_orderstatus, ' \u00e9t\u00e9, \"', cast(o_custkey AS {text}), '\"')"


@query("csv_previews", "WITH t AS (" + " UNION ALL ".join(f"SELECT '{e}' AS encoding, {k} AS part, o_orderkey AS id, {_expr(PLACES, 'VARCHAR')} AS place FROM orders WHERE o_orderkey % 3 = {k}" for e, k in (("utf-8", 0), ("latin-1", 1), ("utf-8", 2))) + "), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS n FROM t QUALIFY n <= 7) "
    """SELECT part, encoding, count(*) AS n_rows, 'id,place' || chr(10) || string_agg(id || ',"' || replace(place, '"', '""') || '"' || chr(10), '' ORDER BY id) AS body FROM r GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """The first rows of CSV files in nested folders, one of them in Latin-1."""
    folder, orders = _scratch(spark), _t(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_expr(PLACES, 'string')} AS place")
    for k, encoding in enumerate(("UTF-8", "ISO-8859-1", "UTF-8")):
        orders.where(F.col("id") % 3 == k).repartitionByRange(1, "id").sortWithinPartitions("id").write.option("header", True).option("escape", '"').option("encoding", encoding).csv(f"{folder}/nested/part={k}")
    shown = csv_previews(spark, folder)
    body = F.rtrim(F.regexp_replace("preview", "^[^\n]*\n=+\n", ""))
    return shown.select(F.regexp_extract("path", "part=([0-9])", 1).cast("int").alias("part"), "encoding", "n_rows", F.concat(F.regexp_replace(body, "\n+$", ""), F.lit("\n")).alias("body"))


# Signatures -----------------------------------------------------------------------------------------------------------------
def _signature_sql(t: str, cols) -> str:
    text = ", ".join(f"coalesce(cast({c} AS VARCHAR), chr(30))" for c in cols)
    return f"SELECT '{t}' AS table_name, count(*) AS n_rows, bit_xor(h) AS hash_xor, cast(sum(h::HUGEINT) AS VARCHAR) AS hash_sum FROM (SELECT ('0x' || substr(md5(concat_ws(chr(31), {text})), 1, 15))::BIGINT AS h FROM {t})"


@query("content_signatures", " UNION ALL ".join(_signature_sql(t, c) for t, c in COLUMNS.items()))
def _(spark, d):
    return store.signatures(core(spark, d), portable=True).withColumn("hash_sum", F.col("hash_sum").cast("string"))


def _scratch(spark) -> str:
    """A new folder that driver and executors share; one of this machine in local sessions only."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='keyloom-')}/keyloom/{uuid.uuid4().hex}"


@query("frequencies_kept_and_added", "SELECT o, column_name, count(v) AS n_unique, sum(cnt)::BIGINT AS n_rows FROM (" + " UNION ALL ".join(f"SELECT '{o}' AS o, '{c}' AS column_name, cast({c} AS VARCHAR) AS v, count(*) AS cnt FROM orders WHERE {w} GROUP BY ALL" for o, w in (("1 counted", "o_orderkey % 3 > 0"), ("2 kept", "o_orderkey % 3 > 0"), ("3 appended", "true")) for c in COLUMNS["orders"]) + ") GROUP BY ALL")
def _(spark, d):
    """Counts two thirds of a table's files, takes them from the store at the next call, and adds the last third when it is there."""
    folder, orders = _scratch(spark), core(spark, d)["orders"]
    kept, out = store.FrequencyStore(spark, f"{folder}/store"), None
    for turn, rest in enumerate(([1, 2], [], [0]), 1):
        for r in rest:
            orders.where(F.col("o_orderkey") % 3 == r).write.mode("append").parquet(f"{folder}/orders")
        freq = kept.frequencies({"orders": spark.read.parquet(f"{folder}/orders")}, sql_clean, "sql")
        one = freq.groupBy("column_name").agg(F.count("v").alias("n_unique"), F.sum("cnt").alias("n_rows")).select(F.lit(f"{turn} {kept.outcome['orders']}").alias("o"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# Recommendations ------------------------------------------------------------------------------------------------------------
PK = """pk AS (SELECT u.table_name, u.column_name, round(least(1.0, 0.65 * u.unique_ratio_non_null + 0.25 * (1 - u.null_ratio) + CASE WHEN u.dtype_family = 'int' THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence, (SELECT count(*) FROM edges e WHERE e.pk_table = u.table_name AND e.pk_column = u.column_name) AS refs, u.dtype_family FROM ucc u),
pk1 AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY confidence DESC, column_name) AS place FROM pk)"""


def _pks(spark, d):
    freq, p, ucc, _, _, edges = _chain(spark, d)
    return recommend.primary_keys(ucc, p, edges), p, edges


@query("recommend_pk", f"{CHAIN}, {PK} SELECT table_name, column_name, place::INTEGER AS place, confidence, refs, 'pk_unique_high,pk_null_low' || CASE WHEN dtype_family = 'int' THEN ',pk_dtype_numeric' ELSE '' END || CASE WHEN refs > 0 AND place = 1 THEN ',pk_referenced_by_fks' ELSE '' END AS reason_codes FROM pk1 WHERE place <= 4")
def _(spark, d):
    return _round(_pks(spark, d)[0])


def _fks(spark, d, edges=None):
    edges = _chain(spark, d)[5] if edges is None else edges
    return recommend.foreign_keys(edges, recommend.orphan_ratios(edges))


@query("recommend_fk", f"{CHAIN} SELECT fk_table, fk_column, pk_table, pk_column, CASE WHEN 1 - matched_rows::DOUBLE / fk_non_null_rows >= 0.05 THEN 'blocked' ELSE 'recommended' END AS status, round(score, 6) AS confidence, 'fk_score_high,fk_inclusion_high' || CASE WHEN 1 - matched_rows::DOUBLE / fk_non_null_rows < 0.05 THEN ',fk_missing_parent_low' ELSE '' END AS reason_codes, CASE WHEN 1 - matched_rows::DOUBLE / fk_non_null_rows >= 0.05 THEN 'fk_missing_parent_high' ELSE '' END AS blockers FROM edges")
def _(spark, d):
    return _round(_fks(spark, d))


def _ratios_sql(cols, table: str) -> str:
    hole = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"SELECT '{table}' AS table_name, '{','.join(cols)}' AS columns, {len(cols)} AS k, count(*) FILTER ({hole}) AS holes, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {table} WHERE NOT ({hole}))) AS vals FROM {table}"


#: Columns of a derived table: (lot, slot) repeats in places, (lot, desk) is unique where it isn't null.
SLOTS = "o_orderkey - o_orderkey % 10 AS lot, o_orderkey % 9 AS slot, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 10 END AS desk, o_custkey AS client"
SLOT_SETS = [c for k in (2, 3) for c in itertools.combinations(("lot", "slot", "desk", "client"), k)]


@query("recommend_composite", f"""WITH slots AS (SELECT {SLOTS} FROM orders), s AS ({" UNION ALL ".join([_ratios_sql(c, "lineitem") for c in (*PAIRS, LINE)] + [_ratios_sql(c, "slots") for c in SLOT_SETS])}),
ok AS (SELECT * FROM s WHERE vals = n - holes AND n > holes), minimal AS (SELECT * FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.table_name = a.table_name AND b.k < a.k AND list_has_all(string_split(a.columns, ','), string_split(b.columns, ','))))
SELECT table_name, columns, round(0.7 * vals / (n - holes) + 0.3 * (1 - holes::DOUBLE / n), 6)::DOUBLE AS confidence, round(vals::DOUBLE / (n - holes), 6)::DOUBLE AS unique_ratio, round(holes::DOUBLE / n, 6)::DOUBLE AS null_ratio, CASE WHEN vals::DOUBLE / (n - holes) >= 0.999 THEN 'composite_unique_high' ELSE '' END AS reason_codes FROM minimal""")
def _(spark, d):
    tables = {"lineitem": (_t(spark, d, "lineitem"), LINE), "slots": (_t(spark, d, "orders").selectExpr(*SLOTS.split(", ")), ["lot", "slot", "desk", "client"])}
    found = [(t, list(f.columns), f.unique_ratio, f.null_ratio) for t, (df, columns) in tables.items() for f in composite.search(df, columns, allow_nulls=True).found]
    return _round(recommend.composite_keys(spark.createDataFrame(found, "table_name string, columns array<string>, unique_ratio double, null_ratio double"), 9))


TYPES = """CASE WHEN dtype_family = 'int' AND int_min >= -32768 AND int_max <= 32767 THEN 'SMALLINT' WHEN dtype_family = 'int' AND int_min >= -2147483648 AND int_max <= 2147483647 THEN 'INT' WHEN dtype_family = 'int' THEN 'BIGINT'
  WHEN max_len >= 1000 THEN 'TEXT' WHEN max_len BETWEEN 1 AND 5 AND unique_ratio < 0.2 THEN 'CHAR(' || max_len::INT || ')' WHEN max_len > 0 THEN 'VARCHAR(' || least(max_len, 255)::INT || ')' ELSE 'TEXT' END"""


@query("recommend_datatypes", f"{BASE} SELECT table_name, column_name, {TYPES} AS db_type, CASE {TYPES} WHEN 'SMALLINT' THEN 0.85 WHEN 'INT' THEN 0.9 WHEN 'BIGINT' THEN 0.92 ELSE CASE WHEN max_len >= 1000 THEN 0.85 WHEN max_len <= 5 AND unique_ratio < 0.2 THEN 0.65 ELSE 0.75 END END::DOUBLE AS confidence FROM prof")
def _(spark, d):
    return recommend.datatypes(_profiles(spark, d)).select("table_name", "column_name", "db_type", "confidence")


@query("recommend_indexes", f"""{CHAIN}, {PK} SELECT table_name, column_name AS columns, 'HIGH' AS priority, 'idx_primary_key' AS reason_code, 0.95::DOUBLE AS confidence, 'recommended' AS status FROM pk1 WHERE place = 1
UNION ALL SELECT fk_table, fk_column, 'HIGH', 'idx_foreign_key', round(score, 6), 'recommended' FROM edges WHERE 1 - matched_rows::DOUBLE / fk_non_null_rows < 0.05
UNION ALL SELECT table_name, column_name, 'AVOID', 'idx_text_avoid', 0.85, 'info' FROM prof WHERE max_len >= 1000 UNION ALL SELECT table_name, column_name, 'AVOID', 'idx_low_cardinality_avoid', 0.7, 'info' FROM prof WHERE max_len < 1000 AND n_rows >= 1000 AND unique_ratio <= 0.01""")
def _(spark, d):
    pks, p, edges = _pks(spark, d)
    return _round(recommend.indexes(pks, _fks(spark, d, edges), None, p))


_NO_CODES = "'' AS blockers, 'trim_whitespace,casefold_strings' AS applied"


@query("datatypes_uuid_and_blocked", "SELECT 'customer_uuid' AS column_name, 'UUID' AS db_type, 0.95::DOUBLE AS confidence, 'dtype_uuid_regex' AS reason_code, NULL::VARCHAR AS blocked, NULL::BIGINT AS high UNION ALL "
    "SELECT 'big_no', CASE WHEN max(c_custkey) * 10000000 > 2147483647 THEN 'BIGINT' ELSE 'INT' END, CASE WHEN max(c_custkey) * 10000000 > 2147483647 THEN 0.92 ELSE 0.9 END, CASE WHEN max(c_custkey) * 10000000 > 2147483647 THEN 'dtype_int_range_big' ELSE 'dtype_int_range_small' END, CASE WHEN max(c_custkey) * 10000000 > 2147483647 THEN 'INT: int_overflow_risk' END, CASE WHEN max(c_custkey) * 10000000 > 2147483647 THEN max(c_custkey) * 10000000 END FROM customer UNION ALL "
    "SELECT 'small_no', CASE WHEN max(c_custkey) <= 32767 THEN 'SMALLINT' ELSE 'INT' END, CASE WHEN max(c_custkey) <= 32767 THEN 0.85 ELSE 0.9 END, 'dtype_int_range_small', NULL, NULL FROM customer")  # fmt: skip
def _(spark, d):
    """UUIDs have a type of their own, and integers beyond four bytes tell what INT would risk."""
    freq = frequencies({"t": _t(spark, d, "customer").selectExpr(f"{_expr(UUID, 'string')} AS customer_uuid", "c_custkey * 10000000 AS big_no", "c_custkey AS small_no")}).persist()
    types = recommend.datatypes(profile.profile(freq), keys.uuid_like(freq))
    b = F.col("blocked_alternative")
    return types.select("column_name", "db_type", "confidence", "reason_code", F.concat(b["db_type"], F.lit(": "), b["blocker"]).alias("blocked"), b["high"].alias("high"))


@query("recommendation_records", f"""WITH k AS ({ORACLE["recommend_pk"]}), f AS ({ORACLE["recommend_fk"]}), y AS ({ORACLE["recommend_datatypes"]}), p AS (SELECT table_name, column_name, int_min, int_max FROM (WITH {freq_sql()}, {PROF} SELECT * FROM prof))
SELECT table_name, 'PRIMARY_KEY' AS decision, column_name AS item, 'recommended' AS status, confidence, reason_codes, {_NO_CODES}, coalesce((SELECT string_agg(o.column_name, ',' ORDER BY o.place) FROM k o WHERE o.table_name = k.table_name AND o.place > 1), '') AS alternatives FROM k WHERE place = 1
UNION ALL SELECT t, 'PRIMARY_KEY', '', 'info', 0.0, '', '', 'trim_whitespace,casefold_strings', '' FROM (SELECT unnest([{", ".join(repr(t) for t in COLUMNS)}]) AS t) WHERE t NOT IN (SELECT table_name FROM k)
UNION ALL SELECT fk_table, 'FOREIGN_KEY', fk_column || ' -> ' || pk_table || '.' || pk_column, status, confidence, reason_codes, blockers, '', '' FROM f
UNION ALL SELECT table_name, 'DATATYPE', column_name || ': ' || db_type, 'recommended', confidence, NULL, '', CASE WHEN int_max > 2147483647 THEN 'numeric_coercion' ELSE '' END, CASE WHEN int_max > 2147483647 THEN 'INT' ELSE '' END FROM y JOIN p USING (table_name, column_name)""")
def _(spark, d):
    """Recommendations as records with their reasons, blockers, disclosures and alternatives."""
    pks, p, edges = _pks(spark, d)
    parts = {"primary_key": small(pks), "foreign_keys": small(_fks(spark, d, edges)), "datatypes": recommend.datatypes(p)}
    found = recommend.records(parts, list(COLUMNS))
    reasons = F.when(F.col("decision") != "DATATYPE", F.array_join("reason_codes", ","))
    return _round(found.withColumns({"reason_codes": reasons, "alternatives": F.transform("alternatives", lambda a: a["name"])}))


@query("recommendation_document")
def _(spark, d):
    pks, p, edges = _pks(spark, d)
    return recommend.document({"primary_key": pks, "foreign_keys": _fks(spark, d, edges), "datatypes": recommend.datatypes(p)})


@query("erd_dot")
def _(spark, d):
    return spark.createDataFrame([(i, x) for i, x in enumerate(viz.to_dot(_chain(spark, d)[5]).split("\n"))], "line int, text string")


@query("erd_mermaid")
def _(spark, d):
    return spark.createDataFrame([(i, x) for i, x in enumerate(viz.to_mermaid(_chain(spark, d)[5]).split("\n"))], "line int, text string")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: relationships of the eight relational tables."""
    return _chain(spark, d)[5]


