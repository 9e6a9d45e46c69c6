import random

import pytest
from pyspark.sql import functions as F

from keyloom.config import StrictConfig
from keyloom.operators import inclusion, keys, profile
from keyloom.operators.sketches import _SPACE, rules_out, theta_sketches
from keyloom.plans.cells import frequencies, small


def _tables(spark):
    n = 3000
    return {
        "parent": spark.range(n).select(F.col("id"), F.concat(F.lit("c"), F.col("id")).alias("code"), (F.col("id") * 7).alias("sevens")),
        "far": spark.range(n).select((F.col("id") + 10**6).alias("id"), F.concat(F.lit("long-enough-to-differ-"), F.col("id")).alias("code")),
        "child": spark.range(9000).select((F.col("id") % n).alias("parent_id"), F.when(F.col("id") % n < 2850, F.concat(F.lit("c"), F.col("id") % n)).otherwise(F.concat(F.lit("x"), F.col("id") % n)).alias("parent_code"), (F.col("id") % 1000 * 3).alias("threes")),
        "tiny": spark.range(30).select(F.col("id")),
    }


def _parts(spark):
    freq = frequencies(_tables(spark)).persist()
    p = small(profile.profile(freq))
    return freq, p, small(keys.unary_ucc(p))


def test_gates_drop_pairs_and_no_inclusion(spark):
    freq, p, ucc = _parts(spark)
    pairs = {tuple(r)[:4]: r["gate"] for r in inclusion.strict_pairs(freq, p, ucc).collect()}
    assert pairs["child", "parent_id", "tiny", "id"] == "distinct_counts"
    assert pairs["child", "parent_id", "far", "id"] == "ranges"
    assert pairs["child", "parent_code", "far", "code"] == "lengths"
    assert pairs["child", "parent_id", "parent", "sevens"] == "sketch" and pairs["child", "threes", "parent", "sevens"] == "sketch"
    left = {k for k, g in pairs.items() if g is None}
    assert left == {("child", "parent_id", "parent", "id"), ("child", "parent_code", "parent", "code"), ("child", "threes", "parent", "id")}
    got = {tuple(r)[:4]: (r["intersection_distinct"], r["matched_rows"]) for r in inclusion.strict_inclusions(freq, p, ucc).collect()}
    pk = {("child", "parent_id", "parent", "id"): (3000, 9000), ("child", "parent_code", "parent", "code"): (2850, 8550), ("child", "threes", "parent", "id"): (1000, 9000)}
    assert {tuple(k[i] for i in (0, 1, 2, 3)): v for k, v in got.items()} == pk


def test_only_gated_pairs_are_compared(spark):
    freq, p, ucc = _parts(spark)
    all_pairs = inclusion.strict_pairs(freq, p, ucc)
    met = {tuple(r)[:0] or (r["fk_table"], r["fk_column"], r["pk_table"], r["pk_column"]) for r in inclusion.shared_values(freq, all_pairs.where("gate is null")).collect()}
    assert len(met) == 3 < all_pairs.count()


@pytest.mark.parametrize("risk", [0.0, 1e-12])
def test_same_inclusions_with_and_without_sketches(spark, risk):
    freq, p, ucc = _parts(spark)
    rows = lambda cfg: sorted(map(str, inclusion.strict_inclusions(freq, p, ucc, cfg).collect()))
    assert rows(StrictConfig(sketch_risk=risk, sketch_size=64)) == rows(StrictConfig(sketch_size=10**9))


def test_sketch_sizes_and_thresholds(spark):
    freq, p, _ = _parts(spark)
    got = {(r["table_name"], r["column_name"]): (r["theta"], len(r["hashes"])) for r in theta_sketches(freq.where("v is not null"), p, 256).collect()}
    assert got["tiny", "id"] == (_SPACE, 30)
    assert 180 < got["parent", "id"][1] < 340 and got["parent", "id"][0] < _SPACE


def test_the_bound_never_drops_what_is_likely(spark):
    dice = random.Random(1)
    rows = [(sum(dice.random() < share for _ in range(500)), 500, share) for share in (0.9, 0.92, 1.0, 0.5, 0.1) for _ in range(200)] + [(0, 0, 1.0)]
    df = spark.createDataFrame(rows, "hits int, seen int, share double").withColumn("out", rules_out(F.col("hits"), F.col("seen"), 0.9, 1e-12))
    got = {r["share"]: (r["a"], r["b"]) for r in df.groupBy("share").agg(F.min("out").alias("a"), F.max("out").alias("b")).collect()}
    assert got == {0.9: (False, False), 0.92: (False, False), 1.0: (False, False), 0.5: (True, True), 0.1: (True, True)}


def test_empty_columns_and_single_values(spark):
    freq = frequencies({"a": spark.createDataFrame([], "x int"), "b": spark.createDataFrame([(1,)], "x int")})
    p = small(profile.profile(freq))
    assert inclusion.strict_inclusions(freq, p, keys.unary_ucc(p)).collect() == []


def test_one_reading_of_the_values_serves_both_sides(spark):
    freq = frequencies(_tables(spark)).localCheckpoint()
    p = small(profile.profile(freq))
    pairs = inclusion.strict_pairs(freq, p, small(keys.unary_ucc(p)))
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[table_name") == 1
