"""Theta sketches of columns, and which pairs of columns they rule out before any value is joined.

A column's sketch is the set of those of its distinct values whose hash lies below a threshold. The profile knows how many distinct values there are, so the threshold is set to leave about
``size`` of them: a filter makes the sketch, without sorting or a top-k. Below the lower of two thresholds both sketches know all of their columns' values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMN = ["table_name", "column_name"]
#: Hashes below this many of 2^62.
_SPACE = 2**62


def _hash(v: Column) -> Column:
    """A hash of a value, from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(v), 2)


def theta_sketches(values: DataFrame, profiles: DataFrame, size: int = 512) -> DataFrame:
    """(table_name, column_name, theta, hashes) of each column of ``profiles`` (a small frame); ``values`` are rows of frequencies without nulls. About ``size`` hashes, all if there are no more values."""
    theta = F.when(F.col("n_unique") <= size, F.lit(_SPACE)).otherwise(F.floor(F.lit(float(size)) / F.col("n_unique") * _SPACE)).cast("long")
    wanted = profiles.select(*_COLUMN, theta.alias("theta"))
    # a row per column; the filter runs where the values are, so what is shuffled is the sketches alone
    low = values.select(*_COLUMN, "v").join(F.broadcast(wanted), _COLUMN).select(*_COLUMN, "theta", _hash(F.col("v")).alias("h")).where("h < theta")
    return low.groupBy(*_COLUMN, "theta").agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def rules_out(hits: Column, seen: Column, least: float, risk: float) -> Column:
    """Whether ``hits`` of ``seen`` values at random make a true share of at least ``least`` less likely than ``risk`` (Chernoff's bound; it holds for draws without replacement, too)."""
    p = F.try_divide(hits.cast("double"), seen.cast("double"))
    term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    divergence = term(p, F.lit(least)) + (term(1 - p, F.lit(1 - least)) if least < 1 else F.when(p < 1, float("inf")).otherwise(0.0))
    return F.coalesce((p < least) & (seen * divergence > math.log(1 / risk)), F.lit(False)) if risk > 0 else F.lit(False)


def gated_pairs(values: DataFrame, children: DataFrame, parents: DataFrame, least: float, size: int = 512, risk: float = 1e-12) -> DataFrame:
    """All pairs (child, parent) of different tables and one family, with ``gate``: null, or why most of the child's values can't be among the parent's.

    ``distinct_counts``, ``ranges`` (of integers) and ``lengths`` (of text) are certain, and so is ``sketch`` where both sketches are complete; else ``sketch`` errs for a pair
    with a probability of ``risk`` at most, and not at all if that is 0. ``children`` and ``parents`` are profiles: a row per column, so that the pairs are few.
    """
    side = lambda p, s: p.select(*(F.col(c).alias(f"{s}_{d}") for c, d in (("table_name", "table"), ("column_name", "column"), ("dtype_family", "family"), ("n_unique", "distinct"), ("int_min", "min"), ("int_max", "max"), ("min_len", "shortest"), ("max_len", "longest"))))
    apart = lambda a, b, c, d: F.coalesce((F.col(b) < F.col(c)) | (F.col(d) < F.col(a)), F.lit(False))
    pairs = side(children, "fk").join(side(parents, "pk"), (F.col("fk_family") == F.col("pk_family")) & (F.col("fk_table") != F.col("pk_table")))
    first = F.when(F.col("pk_distinct") < least * F.col("fk_distinct"), "distinct_counts").when(apart("fk_min", "fk_max", "pk_min", "pk_max"), "ranges").when((F.col("fk_family") == "string") & apart("fk_shortest", "fk_longest", "pk_shortest", "pk_longest"), "lengths")
    pairs = pairs.select("fk_table", "fk_column", "pk_table", "pk_column", "fk_distinct", first.alias("first"))
    used = children.unionByName(parents.select(*children.columns)).dropDuplicates(_COLUMN)
    # both sides take their sketches from one join, so that the values are read once
    four = ("fk_table", "fk_column", "pk_table", "pk_column")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_table").alias("table_name"), F.col(f"{s}_column").alias("column_name")) for s in ("fk", "pk")))
    of = lambda s: F.max(F.when(F.col("side") == s, F.struct("theta", "hashes"))).alias(s)
    pairs = pairs.select(*four, "fk_distinct", "first", F.inline(sides)).join(theta_sketches(values, used, size), _COLUMN, "left").groupBy(*four, "fk_distinct", "first").agg(of("fk"), of("pk"))
    pairs = pairs.select(*four, "fk_distinct", "first", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("fk", "pk") for c in ("theta", "hashes")))
    theta = F.least("fk_theta", "pk_theta")
    known = F.filter("fk_hashes", lambda h: h < theta)
    seen, hits = F.size(known), F.size(F.array_intersect(known, F.col("pk_hashes")))
    complete = (theta == _SPACE) & (hits < least * F.col("fk_distinct"))
    pairs = pairs.select("fk_table", "fk_column", "pk_table", "pk_column", "first", seen.alias("seen"), hits.alias("hits"), F.coalesce(complete, F.lit(False)).alias("complete"))
    out = F.col("complete") | rules_out(F.col("hits"), F.col("seen"), least, risk)
    return pairs.select("fk_table", "fk_column", "pk_table", "pk_column", F.coalesce("first", F.when(out, "sketch")).alias("gate"))
