"""Overlaps of columns: many columns, and no shuffle that brings a column's values together."""

from pyspark.sql import functions as F

from keyloom.operators import profile, quality
from keyloom.plans.cells import frequencies


def brute(rows, within):
    sets = {c: {r[2] for r in rows if r[:2] == c} for c in {r[:2] for r in rows}}
    pairs = [(a, b) for a in sets for b in sets if (a[0] == b[0] and a[1] < b[1] if within else a[0] < b[0])]
    shared = {(*a, *b): len(sets[a] & sets[b]) for a, b in pairs if len(sets[a] & sets[b]) >= 0.1 * min(len(sets[a]), len(sets[b]))}
    return {k: (n, len(sets[k[:2]]), len(sets[k[2:]])) for k, n in shared.items() if n}


def test_overlaps_of_more_columns_than_a_long_has_bits(spark):
    rows = [(f"t{c % 2}", f"c{c:03}", str(v)) for c in range(150) for v in range(c % 7, 40, 1 + c % 11)]
    freq = spark.createDataFrame(rows, "table_name string, column_name string, v string").withColumns({"family": F.lit("string"), "cnt": F.lit(1).cast("long")})
    for within in (False, True):
        got = {tuple(r[:4]): tuple(r[4:7]) for r in quality.overlaps(freq, freq, within=within).collect()}
        assert got == brute(rows, within) and len(got) > 1000


def test_no_task_takes_a_column(spark):
    """Values aren't shuffled by the column that they are of, as a join with the columns would."""
    table = spark.range(40_000).selectExpr("id AS a", "id + 20000 AS b")
    freq = frequencies({"t": table}).localCheckpoint()
    columns = profile.profile(freq).localCheckpoint()
    assert [r["shared"] for r in quality.overlaps(freq, columns, within=True).collect()] == [20_000]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality._compared(freq, columns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
