import json

import pytest
from pyspark.sql import functions as F

import fixtures
from keyloom import api, viz
from keyloom.config import EngineConfig, SelectConfig
from keyloom.engine import Engine, EngineError, parse_stages
from keyloom.operators.types import TypeModel
from keyloom.operators import inclusion, keys, profile, quality, recommend, selection
from keyloom.plans.cells import frequencies
from keyloom.sources.catalog import Catalog, CatalogError, json_safe, table_name, write_csv
from keyloom.streaming import incremental


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(Catalog(spark, fixtures.retail(spark)))
    yield e
    e.close()


def test_finds_the_true_edges(engine):
    found = {(r["fk_table"], r["fk_column"], r["pk_table"], r["pk_column"]) for r in engine.edges.collect()}
    assert fixtures.TRUE_EDGES <= found


def test_run_gives_payloads(engine):
    out = engine.run("profiles,ucc_unary,relationships,recommendations", dot=True)
    assert {s: x["status"] for s, x in out["stages"].items()} == dict.fromkeys(["profiles", "ucc_unary", "relationships", "recommendations", "rel_missing", "duplicates", "default_fk", "surrogate_keys", "ucc_composite"], "ok")
    assert out["summary"]["total"] >= 4 and out["summary"]["required"] == out["summary"]["total"]
    scores = [r["score"] for r in out["stages"]["relationships"]["data"]]
    assert scores == sorted(scores, reverse=True)
    columns = [(r["table_name"], r["column_name"]) for r in out["stages"]["profiles"]["data"]]
    assert columns == sorted(columns)
    assert {"key_values", "exact_rows", "subset_rows"} <= set(out["stages"]["duplicates"]["data"])
    assert out["dot"].startswith("digraph") and '"customers" -> "orders"' in out["dot"]
    assert all(r["orphan_fk_ratio"] == 0 for r in out["stages"]["rel_missing"]["data"])
    text = json.loads(recommend.to_json(engine.recommendations, engine.catalog.list_tables()))
    assert text["tables"]["orders"]["primary_key"][0]["column_name"] == "OrderID"
    assert text["tables"]["orders"]["constraints"] == []


def test_stage_names():
    assert parse_stages(None) == ["relationships"]
    assert parse_stages("ind, ind,") == ["ind"]
    assert parse_stages("recommendations")[1:] == ["rel_missing", "duplicates", "default_fk", "surrogate_keys", "ucc_composite"]
    with pytest.raises(EngineError) as e:
        parse_stages("ind,nope")
    assert e.value.code == "UNKNOWN_STAGE"


def test_a_failing_stage_stops_no_other(spark):
    e = Engine(Catalog(spark, {"t": spark.range(30).toDF("id")}))
    e.__dict__["ind"] = None
    out = e.run("scored,ucc_unary")["stages"]
    assert out["scored"]["status"] == "STAGE_FAILED" and out["ucc_unary"]["status"] == "ok"


def test_soft_mode(spark):
    acc = spark.createDataFrame([(f"{i:010d}", f"name {i}") for i in range(1, 61)], "AccountNo string, Label string")
    use = spark.createDataFrame([(i, f"{1 + i % 60}.0") for i in range(300)], "UseID int, AccountNo string")
    e = Engine(Catalog(spark, {"accounts": acc, "uses": use}), mode="soft", nulls="memory")
    r = e.ind.where("fk_table = 'uses' and fk_column = 'AccountNo'").first()
    assert (r["pk_column"], r["fk_rep"], r["distinct_coverage"]) == ("AccountNo", "num_int_str", 1.0)
    assert r["pk_rep"] in ("num_int_str", "digits_lstrip_zeros")
    assert set(e.rejects.columns) >= {"fk_table", "pk_table", "reason"}
    with pytest.raises(EngineError):
        Engine(Catalog(spark), mode="odd")


def test_faults(spark):
    t = fixtures.faulty(spark)
    r = quality.relational_missing(t["orders"], "customer_id", t["customers"], "customer_id").first()
    bad = t["orders"].where("customer_id = 999999").count()
    assert (r["orphan_fk_rows"], r["orphan_examples"]) == (bad, ["999999"])
    assert r["parents_missing_children"] == t["customers"].count() - t["orders"].where("customer_id < 999999").select("customer_id").distinct().count()
    d = {x["v"]: x for x in quality.default_keys(t["orders"], "customer_id", t["customers"], "customer_id", partners=("order_id",), labels=("customer_name",)).collect()}
    assert d["0"]["flagged"] and "high_frequency_sentinel_value" in d["0"]["reasons"] and "pairs_with_many_distinct_partner_ids" in d["0"]["reasons"]
    assert quality.duplicate_rows(t["orders"]).first()["duplicate_rows"] == 12
    s = quality.signature_conflicts(t["identities"], "customer_id", ["email"])
    assert s.count() == 20 and s.agg(F.max("distinct_ids")).first()[0] == 2
    assert quality.cardinality_violations(t["identities"], "email", "customer_id", "one_to_one").count() == 20


def test_default_guard_for_small_domains(spark):
    child = spark.createDataFrame([(1 + (i > 40),) for i in range(60)], "fk int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "pk int")
    assert not quality.default_keys(child, "fk", parent, "pk").where("flagged").count()


def test_composite_keys_are_minimal(spark):
    df = spark.createDataFrame([(i // 20, i % 20, i % 3, None if i == 5 else i) for i in range(400)], "a int, b int, c int, d int")
    assert keys.composite_ucc(df, ["a", "b", "c"]) == [("a", "b")]
    assert keys.unique_combinations(df, [("a", "d")]) == []
    assert keys.unique_combinations(df, []) == []


def test_profiles_of_odd_tables(spark):
    t = {"empty": spark.createDataFrame([], "x int, y string"), "nulls": spark.createDataFrame([(None, " N/A "), (None, "")], "x int, y string"), "odd": spark.createDataFrame([([1], True)], "`a.b` array<int>, `c d` boolean")}
    p = {r["column_key"]: r for r in profile.with_health(profile.with_empty_tables(profile.profile(frequencies(t)), t)).collect()}
    assert p["nulls.y"]["n_null"] == 2 and p["nulls.y"]["health_status"] == "fail"
    assert p["odd.a.b"]["dtype_family"] == "other" and p["odd.c d"]["dtype_family"] == "bool"
    assert (p["empty.x"]["n_rows"], p["empty.x"]["health_score"], p["empty.x"]["health_status"]) == (0, 0, "fail")
    assert keys.prune(profile.profile(frequencies(t))).where("reject").count() == 4


def test_score_is_bounded_and_monotone(spark):
    rows = [("a", "x_id", "b", "x_id", 100, 100, 200, 90, 80, dc / 10, 0.9, 1, 100, 1, 200) for dc in range(11)]
    names = "fk_table fk_column pk_table pk_column fk_non_null_rows fk_distinct pk_distinct intersection_distinct matched_rows distinct_coverage row_coverage fk_min fk_max pk_min pk_max".split()
    got = [r["score"] for r in selection.score(spark.createDataFrame(rows, names)).orderBy("distinct_coverage").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_csv_and_sinks(spark, tmp_path):
    p = tmp_path / "my.table.csv"
    p.write_text('id,txt\n1,NULL\n2,n/a\n3,ok\n4,"a ""b""\nc"\n5\n')
    c = Catalog.of_uploads(spark, [str(p)])
    assert c.list_tables() == ["my.table"] and table_name("/a/b.csv") == "b"
    assert [r["txt"] for r in c.tables["my.table"].orderBy("id").collect()] == [None, None, "ok", 'a "b"\nc', None]
    assert c.describe("my.table") == [("id", "string"), ("txt", "string")] and c.count_rows("my.table") == 5
    assert "id,txt" in c.preview("my.table", 2)
    with pytest.raises(CatalogError):
        Catalog.of_uploads(spark, [])
    with pytest.raises(CatalogError):
        Catalog.of_uploads(spark, ["x.csv"] * 31)
    with pytest.raises(ValueError):
        c.add_path("x", "x.txt")
    c.add_csv("typed", str(p), multi_line=True)
    assert c.describe("typed")[0] == ("id", "int")
    assert c.scalar("select max(id) from typed") == 5 and c.scalar("select null", 7) == 7
    df = spark.createDataFrame([(1, [1, 2], float("inf"))], "a int, b array<int>, c double")
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["b"] == "[1,2]"
    assert json_safe(df).first()["c"] is None
    c.close()


def test_diagrams(engine):
    text = viz.to_mermaid(engine.edges)
    assert "customers ||--o{ orders" in text and text.startswith("erDiagram")


def test_selection_cap(spark, engine):
    cfg = EngineConfig(select=SelectConfig(max_edges_per_fk=1, min_score=0.0))
    one = selection.select_edges(engine.scored, engine.profiles, cfg.select)
    assert one.groupBy("fk_table", "fk_column").count().where("count > 1").count() == 0


def test_streamed_frequencies(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(i % 5, f"v{i % 3}") for i in range(100)], "a int, b string")
    df.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    incremental.start(stream, "t", str(tmp_path / "freq"), str(tmp_path / "ck")).awaitTermination(60)
    got = {tuple(r) for r in incremental.read(spark, str(tmp_path / "freq")).collect()}
    assert got == {tuple(r) for r in frequencies({"t": df}).collect()}


def test_inclusion_of_itself(spark):
    t = spark.createDataFrame([(i,) for i in range(50)], "id int")
    freq = frequencies({"a": t, "b": t.union(t)})
    p = profile.profile(freq)
    r = inclusion.strict_inclusions(freq, p, keys.unary_ucc(p)).first()
    assert (r["fk_table"], r["pk_table"], r["distinct_coverage"], r["row_coverage"]) == ("b", "a", 1.0, 1.0)


def test_long_text_is_compared_by_digest(spark):
    df = spark.createDataFrame([("x" * 1000,), ("x" * 1000,), ("x" * 999 + "y",)], "t string")
    freq = frequencies({"a": df})
    assert {(r["len"], r["cnt"], len(r["v"])) for r in freq.collect()} == {(1000, 2, 71), (1000, 1, 71)}
    assert profile.profile(freq).first()["max_len"] == 1000.0


def test_type_model(spark, tmp_path):
    df = spark.createDataFrame([(str(i), ["yes", "no"][i % 2], f"199{i % 10}-01-02", f"{i}.5", "a", None) for i in range(20)], "n string, b string, d string, f string, s string, e string")
    m = TypeModel()
    out = m.fit_transform(df, numeric_bool=True)
    assert m.schema() == {"n": "int", "b": "bool", "d": "date", "f": "float", "s": "string", "e": "string"}
    assert dict(out.dtypes) == {"n": "bigint", "b": "int", "d": "timestamp", "f": "double", "s": "string", "e": "string"}
    m.save_schema(str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["e"]["confidence"] == 0.0


def test_api(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id,name\n" + "\n".join(f"{i:05d},n{i}" for i in range(40)))
    b.write_text("bid,id\n" + "\n".join(f"b{i},{i % 40:05d}" for i in range(200)))
    out = api.discover(spark, [str(a), str(b)], "relationships,profiles_enhanced", min_edge_score=0.5)
    assert out["config"]["select"]["min_score"] == 0.5
    assert [r["relationship"] for r in out["stages"]["relationships"]["data"]] == ["b.id -> a.id"]
    assert {"overall_quality", "atomic_type"} <= set(out["stages"]["profiles_enhanced"]["data"][0])
    assert {r["column_name"]: r["dtype_family"] for r in out["stages"]["profiles_enhanced"]["data"] if r["table_name"] == "a"} == {"id": "int", "name": "string"}
    codes = [api.discover(spark, [str(a)], **k)["error"]["code"] for k in ({"include": "x"}, {"mode": "x"}, {"soft_routing_sim": 0.1}, {"min_edge_score": 2}, {"max_rows": 0}, {"what": 1})]
    assert codes == ["UNKNOWN_STAGE", "INVALID_PARAM_COMBO", "INVALID_PARAM_COMBO", "PARAM_OUT_OF_RANGE", "PARAM_OUT_OF_RANGE", "UNKNOWN_PARAM"]
    assert api.discover(spark, [])["error"]["code"] == "NO_FILES" and api.health()["status"] == "ok"
