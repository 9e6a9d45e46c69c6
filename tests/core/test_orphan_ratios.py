"""Ratios of orphans from what the inclusions have counted."""

import pytest
from pyspark.sql import functions as F

from keyloom import queries
from keyloom.config import StrictConfig
from keyloom.operators import inclusion, keys, profile, quality, recommend, selection
from keyloom.plans.cells import frequencies, small

DATA = "/root/testdata/sf0.001"
FOUR = ["fk_table", "fk_column", "pk_table", "pk_column"]


def test_same_ratios_as_joins_of_the_tables(spark):
    """Orphans, nulls, null tokens and blanks around values."""
    key = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(" N/A ")).when(F.col("id") % 17 == 0, F.concat(F.lit("lost"), F.col("id") % 7)).otherwise(F.concat(F.lit(" k"), F.col("id") % 100))
    tables = {"parent": spark.range(120).select(F.concat(F.lit("k"), F.col("id")).alias("code")), "child": spark.range(3000).select(key.alias("code_ref"), (F.col("id") % 125).alias("n")), "numbers": spark.range(119).select("id")}
    freq = frequencies(tables).persist()
    p = small(profile.profile(freq))
    found = inclusion.strict_inclusions(freq, p, keys.unary_ucc(p), StrictConfig(min_distinct_coverage=0.5))
    edges = small(selection.score(found).withColumn("optional", F.lit(False)))
    freq.unpersist()
    listed = [r.asDict() for r in edges.collect()]
    want = {tuple(r[c] for c in FOUR): r["orphan_fk_ratio"] for r in quality.missing_for_edges(tables, listed).collect()}
    got = {tuple(r[c] for c in FOUR): r["orphan_fk_ratio"] for r in recommend.orphan_ratios(edges).collect()}
    assert got == want and len(got) == 2 and all(0 < x < 1 for x in got.values())


@pytest.mark.parametrize("name", ["recommend_fk", "recommend_indexes"])
def test_no_table_is_joined_again(spark, monkeypatch, name):
    monkeypatch.setattr(quality, "missing_for_edges", lambda *a: pytest.fail("tables are read again"))
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_no_references(spark, monkeypatch):
    chain = queries._chain
    monkeypatch.setattr(queries, "_chain", lambda *a: (*chain(*a)[:5], chain(*a)[5].limit(0)))
    assert queries.QUERIES["recommend_fk"](spark, DATA).collect() == []
