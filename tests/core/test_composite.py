from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import composite, recommend


def brute(rows, names, max_k, allow_nulls):
    found = []
    for k in range(2, max_k + 1):
        for c in combinations(range(len(names)), k):
            if any(set(f) <= set(c) for f in found):
                continue
            vals = [tuple(r[i] for i in c) for r in rows]
            whole = [v for v in vals if None not in v]
            if whole and len(set(whole)) == len(whole) and (allow_nulls or len(whole) == len(vals)):
                found.append(c)
    return [tuple(names[i] for i in f) for f in found]


@pytest.mark.parametrize("allow_nulls", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, allow_nulls):
    dice = np.random.default_rng(seed)
    rows = [tuple(int(v) if dice.random() > 0.03 * (i % 2) else None for i, v in enumerate(dice.integers(0, [40, 30, 12, 9, 50]))) for _ in range(60)]
    names = ["a", "b", "c`d", "e", "f"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` int" for n in names)).toDF("a", "b", "c", "e", "f")
    names = list(df.columns)
    got = composite.search(df, names, 3, allow_nulls, sample=10**6)
    assert [f.columns for f in got.found] == brute(rows, names, 3, allow_nulls)
    few = composite.search(df, names, 3, allow_nulls, sample=1)
    assert few.found == got.found and few.tested >= got.tested
    assert got.tested == len(got.found)  # a sample of all rows refutes all that can be refuted


def test_the_sample_refutes_before_any_pass_over_the_rows(spark):
    n = 20000
    df = spark.range(n).select((F.col("id") % 100).alias("a"), (F.col("id") % 77).alias("b"), F.floor(F.col("id") / 100).alias("c"), *((F.col("id") % m).alias(f"m{m}") for m in range(20, 34)))
    got = composite.search(df, df.columns, 2, sample=512)
    assert [f.columns for f in got.found] == [("a", "c")]
    assert got.refuted + got.tested == len(list(combinations(df.columns, 2))) and got.tested <= 5 and got.passes == 1
    none = composite.search(df.unionByName(df), df.columns, 2, sample=512)
    assert none.found == [] and none.tested == none.passes == 0


def test_counts_rule_out_sets_without_looking(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), (F.col("id") % 90).alias("b"), F.col("id").alias("c"))
    assert composite.search(df, ["a", "b"], 2, distinct={"a": 10, "b": 90}).passes == 0


def test_ratios_and_recommendations(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (2, 1, 5), (2, 2, 6)], "a int, b int, c int")
    found = composite.search(df, ["a", "b", "c"], allow_nulls=True).found
    assert {f.columns: (f.rows, f.unique_ratio, f.null_ratio) for f in found} == {("a", "b"): (4, 1.0, 0.0), ("a", "c"): (3, 1.0, 0.25), ("b", "c"): (3, 1.0, 0.25)}
    rows = [("t", list(f.columns), f.unique_ratio, f.null_ratio) for f in found]
    rec = recommend.composite_keys(spark.createDataFrame(rows, "table_name string, columns array<string>, unique_ratio double, null_ratio double"), 1)
    assert [(r["columns"], r["confidence"], r["reason_codes"]) for r in rec.orderBy(F.desc("confidence")).collect()] == [(["a", "b"], 1.0, ["composite_unique_high"]), (["a", "c"], 0.925, ["composite_unique_high"])]


def test_empty_tables_repeated_rows_and_null_columns(spark):
    assert composite.search(spark.createDataFrame([], "a int, b int"), ["a", "b"]).found == []
    assert composite.search(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), ["a", "b"]).found == []
    assert composite.search(spark.createDataFrame([(1, None), (2, None)], "a int, b int"), ["a", "b"], allow_nulls=True).found == []


def test_slices_of_the_hashes_and_their_verdicts(spark, monkeypatch):
    """Sets are refuted by a slice of the hashes, or by the rest; hashes that repeat by chance alone refute nothing."""
    monkeypatch.setattr(composite, "TASK_HASHES", 1000)
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), F.floor(F.col("id") / 50).alias("b"), F.floor(F.col("id") / 2).alias("c"), F.greatest("id", F.lit(1)).alias("d"), F.when(F.col("id") > 5, F.col("id")).alias("e"))
    sets = [("a", "b"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "b")]
    assert composite.repeating(df, sets, 3000) == [False, True, True, False, False]
    assert composite.repeating(df.withColumn("a", F.lit(1)), [("a", "d")], 3000) == [True]
    monkeypatch.setattr(composite, "_hash", lambda columns, whole=composite._hash: F.shiftrightunsigned(whole(columns), 54))
    assert composite.repeating(df, sets, 3000) == [False, True, True, False, False]


def test_hashes_are_spread_over_as_many_tasks_as_rows_need(spark, monkeypatch):
    """No task gets more hashes when there are more rows, and counts aren't shuffled along."""
    monkeypatch.setattr(composite, "TASK_HASHES", 1000)
    df = spark.range(20_000).select((F.col("id") % 200).alias("a"), F.floor(F.col("id") / 200).alias("b"))
    seen = []
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by, whole=type(df).repartition: seen.append(n) or whole(self, n, *by))
    assert composite.repeating(df, [("a", "b")], 20_000) == [False]
    assert seen == [8, 20]
