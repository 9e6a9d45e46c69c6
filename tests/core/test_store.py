import os

from pyspark.sql import functions as F

from keyloom.engine import Engine
from keyloom.functions.normalize import sql_clean
from keyloom.plans.cells import frequencies
from keyloom.sources.catalog import Catalog
from keyloom.sources.store import FrequencyStore, Signature, signatures


def _rows(df):
    return sorted(map(str, df.select("table_name", "column_name", "ordinal", "family", "v", "len", "cnt").collect()))


def test_signatures_ignore_order_and_partitions_and_add_up(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))

    def of(d):
        r = signatures({"t": d}).first()
        return Signature(r["n_rows"], r["hash_xor"], int(r["hash_sum"]))

    whole = of(df)
    assert whole == of(df.orderBy(F.desc("id")).repartition(7)) and whole.n_rows == 1000
    assert whole == of(df.where("id < 300")) + of(df.where("id >= 300"))
    assert whole != of(df.where("id > 0").unionByName(df.where("id = 1"))) and whole != of(df.withColumn("s", F.lit("1")))
    assert of(spark.createDataFrame([("a", None)], "x string, y string")) != of(spark.createDataFrame([(None, "a")], "x string, y string"))
    assert of(df.where("false")) == Signature(0, 0, 0)


def test_a_second_engine_reads_no_table(spark, tmp_path):
    spark.range(500).select("id", (F.col("id") % 50).alias("group_id")).write.parquet(str(tmp_path / "items.parquet"))
    spark.range(50).select("id").write.parquet(str(tmp_path / "groups.parquet"))
    paths = {n: str(tmp_path / f"{n}.parquet") for n in ("items", "groups")}
    first = Engine(Catalog.of_paths(spark, paths), store=FrequencyStore(spark, str(tmp_path / "store")))
    want = sorted(map(str, first.profiles.collect()))
    first.close()
    again = Engine(Catalog.of_paths(spark, paths), store=FrequencyStore(spark, str(tmp_path / "store")))
    assert all("/store/data/" in f for f in again.freq.inputFiles()) and again.store.outcome == {"items": "kept", "groups": "kept"}
    assert sorted(map(str, again.profiles.collect())) == want
    again.close()


def test_appended_changed_and_other_files(spark, tmp_path):
    path, kept = str(tmp_path / "t"), FrequencyStore(spark, str(tmp_path / "store"))
    add = lambda lo, hi, mode="append": spark.range(lo, hi).select("id", (F.col("id") % 7).cast("string").alias("s")).write.mode(mode).parquet(path)
    read = lambda: {"t": spark.read.parquet(path)}
    add(0, 100)
    for change, outcome in ((lambda: None, "counted"), (lambda: None, "kept"), (lambda: add(90, 150), "appended"), (lambda: None, "kept"), (lambda: add(5, 10, "overwrite"), "counted")):
        change()
        got = kept.frequencies(read(), sql_clean, "sql")
        assert kept.outcome == {"t": outcome} and _rows(got) == _rows(frequencies(read()))
        r = signatures(read()).first()
        assert kept.signature("t") == Signature(r["n_rows"], r["hash_xor"], int(r["hash_sum"]))
    assert kept.frequencies(read(), sql_clean, "memory") and kept.outcome == {"t": "counted"}


def test_tables_that_are_no_files_are_kept_by_their_contents(spark, tmp_path):
    kept = FrequencyStore(spark, str(tmp_path / "store"))
    of = lambda rows: {"t": spark.createDataFrame(rows, "a int, b string")}
    for rows, outcome in (([(1, "x"), (2, None)], "counted"), ([(2, None), (1, "x")], "kept"), ([(2, None)], "counted"), ([], "counted"), ([], "kept")):
        assert _rows(kept.frequencies(of(rows), sql_clean, "sql")) == _rows(frequencies(of(rows))) and kept.outcome == {"t": outcome}
    assert os.listdir(tmp_path / "store") != []
