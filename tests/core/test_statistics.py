import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import profile, quality, statistics
from keyloom.plans.cells import frequencies, small
from keyloom.plans.topk import examples, first_of_groups


@pytest.mark.parametrize("limit", [1, 7, 100_000])
def test_moments_and_quantiles_against_numpy(spark, limit, monkeypatch):
    monkeypatch.setattr(statistics, "BINS", 8)
    dice = random.Random(4)
    cols = {"small": [dice.randrange(5) for _ in range(400)], "wide": [dice.choice([-1, 1]) * 10 ** dice.uniform(-9, 9) for _ in range(400)], "same": [3.5] * 400, "one": [7.0] + [None] * 399, "gone": [None] * 400}
    rows = list(zip(*cols.values(), strict=True))
    df = spark.createDataFrame(rows, "small int, wide double, same double, one double, gone double")
    got = {r["column_name"]: r for r in statistics.numeric_statistics(frequencies({"t": df}), (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), limit).collect()}
    assert set(got) == {"small", "wide", "same", "one"}
    for c, r in got.items():
        x = np.array([v for v in cols[c] if v is not None], float)
        assert r["num_count"] == len(x) and (r["num_min"], r["num_max"]) == (x.min(), x.max())
        assert np.allclose(r["num_quantiles"], np.quantile(x, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]), rtol=1e-12)
        assert np.isclose(r["num_mean"], x.mean()) and np.isclose(r["num_std_dev"], x.std(ddof=1) if len(x) > 1 else 0.0, atol=1e-9)
        n, m2 = len(x), ((x - x.mean()) ** 2).mean()
        want = ((x - x.mean()) ** 3).mean() / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 1e-18 else 0.0
        assert np.isclose(r["num_skewness"], want, rtol=1e-6)


def test_nan_infinity_and_no_numbers_at_all(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (1.0, "c"), (2.0, None)], "x double, s string")
    got = statistics.numeric_statistics(frequencies({"t": df}, lambda c: c.cast("string"))).collect()
    assert [(r["column_name"], r["num_count"], r["num_quantiles"]) for r in got] == [("x", 2, [1.25, 1.5, 1.75])]
    assert statistics.numeric_statistics(frequencies({"t": df.select("s")})).collect() == []


def test_one_frame_of_all_statistics(spark):
    df = spark.range(100).select("id", (F.col("id") / 4).alias("x"), F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("t"), F.lit("s").alias("s"))
    freq = frequencies({"t": df}).persist()
    got = {r["column_name"]: r for r in statistics.enhanced_statistics(freq, small(profile.profile(freq)), "2020-04-09").collect()}
    assert got["id"]["pk_continuity"] == 100.0 and got["id"]["num_median"] == 49.5 and got["id"]["date_min"] is None
    assert got["x"]["num_iqr"] == 12.375 and got["x"]["pk_continuity"] is None
    assert (got["t"]["date_min"], got["t"]["date_range_days"], got["t"]["freshness_score"]) == ("2020-01-01 00:00:00", 99, 100.0)
    assert got["s"]["num_count"] is None and got["s"]["freshness_score"] is None


def test_first_of_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v")).repartition(4)
    got = {r["g"]: r["examples"] for r in examples(df, ["g"], "v", 4).collect()}
    assert got == {g: sorted({i % 50 for i in range(1000) if i % 3 == g})[:4] for g in range(3)}
    plan = first_of_groups(df, ["g"], ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Partial")


def test_numbers_meet_across_types(spark):
    tables = {"a": spark.createDataFrame([(7, "7"), (8, " 8 ")], "i int, s string"), "b": spark.createDataFrame([(7.0, 7.0), (9.0, 7.5)], "f double, g double"), "c": spark.createDataFrame([(None,)], "n double")}
    freq = frequencies(tables)
    got = {(r["column_a"], r["column_b"]): (r["shared"], r["examples"]) for r in quality.with_examples(quality.overlaps(freq, small(profile.profile(freq))), freq).collect()}
    assert got == {("i", "f"): (1, ["7"]), ("s", "f"): (1, ["7"])}


def test_example_rows_of_conflicts_are_few_and_merged(spark):
    df = spark.createDataFrame([(i, i // 4, "same") for i in range(40)] + [(None, None, "same"), (99, 99, "other")], "a int, b int, s string")
    parts = [quality.with_example_rows(quality.signature_conflicts(df, c, ["s"]), df, c, ["s"], 3) for c in ("a", "b")]
    assert [r["example_rows"] for r in parts[0].collect()] == [[f'{{"a":{i},"s":"same"}}' for i in range(3)]]
    merged = quality.collapse_signatures(parts[0].unionByName(parts[1]), 5).collect()
    assert len(merged) == 1 and len(merged[0]["example_rows"]) == 5 == len(set(merged[0]["example_rows"]))


def test_numeric_stats_ranks_rows_without_gathering_a_column(spark):
    import math

    from keyloom.operators import profile

    inf, nan = float("inf"), float("nan")
    values = [float((i * 7919) % 1000) for i in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(v, -inf if i < 2000 else inf if i < 4500 else nan, float(i)) for i, v in enumerate(values)], "a double, b double, c double")
    got = {r["column_name"]: r for r in profile.numeric_stats(df, ["a", "b", "c"], limit=10).collect()}
    for c in "ac":
        want = df.selectExpr(f"percentile({c}, array(0.25D, 0.5D, 0.75D))").first()[0]
        assert [got[c][f"num_{q}"] for q in ("q25", "median", "q75")] == pytest.approx(want)
    assert (got["b"]["num_q25"], got["b"]["num_median"], got["b"]["num_q75"]) == (-inf, inf, inf) and math.isnan(got["b"]["num_max"])
    assert profile.numeric_stats(df.limit(0), ["a"]).count() == 0
