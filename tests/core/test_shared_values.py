"""Values that columns share, counted in rows of fixed width."""

import random

from pyspark.sql import functions as F

from keyloom.operators import inclusion

_FREQ = "table_name string, column_name string, family string, v string, cnt long"
_PAIRS = "fk_table string, fk_column string, pk_table string, pk_column string"


def test_more_children_and_parents_than_a_row_and_a_long_hold(spark):
    dice = random.Random(3)
    columns = [(f"t{i % 5}", f"c{i:03}", "int" if i % 3 else "string") for i in range(150)]
    freq = {c: {str(v): dice.randint(1, 9) for v in dice.sample(range(60), dice.randint(1, 25))} for c in columns}
    rows = [(*c, v, n) for c, vs in freq.items() for v, n in vs.items()] + [("t0", "c000", "string", None, 7)]
    pairs = [(a, b) for a in columns[:20] for b in columns if a[0] != b[0]] + [(a, b) for a in columns[140:] for b in columns[130:140] if a[0] != b[0]]
    want = {}
    for a, b in pairs:
        both = freq[a].keys() & freq[b].keys() if a[2] == b[2] else ()
        if both:
            want[a[:2] + b[:2]] = (len(both), sum(freq[a][v] for v in both))
    got = inclusion.shared_values(spark.createDataFrame(rows, _FREQ), spark.createDataFrame([a[:2] + b[:2] for a, b in pairs], _PAIRS))
    found = {(r["fk_table"], r["fk_column"], r["pk_table"], r["pk_column"]): (r["intersection_distinct"], r["matched_rows"]) for r in got.collect()}
    assert found == want and len(want) > 1000


def test_values_are_neither_listed_nor_sorted(spark):
    freq = spark.range(100).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("table_name"), F.lit("x").alias("column_name"), F.lit("int").alias("family"), F.col("id").cast("string").alias("v"), F.lit(1).cast("long").alias("cnt"))
    met = inclusion.shared_values(freq, spark.createDataFrame([("a", "x", "b", "x")], _PAIRS))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
    assert [(r["intersection_distinct"], r["matched_rows"]) for r in met.collect()] == [(100, 100)]


def test_no_pairs(spark):
    assert inclusion.shared_values(spark.createDataFrame([("a", "x", "int", "1", 1)], _FREQ), spark.createDataFrame([], _PAIRS)).collect() == []
