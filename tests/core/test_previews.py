from pyspark.sql import functions as F

from keyloom.operators import recommend
from keyloom.sources.previews import csv_previews, write_previews


def _write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_previews_of_many_files(spark, tmp_path):
    _write(tmp_path, "in/a.csv", "id,name\n1,é\n2,\"two\nlines\"\n3,x,too,many\n4\n".encode())
    _write(tmp_path, "in/deep/er/b.csv", "id,name\n1,café\n".encode("latin-1"))
    _write(tmp_path, "in/c.csv", b"only,header\n")
    _write(tmp_path, "in/d.csv", b"")
    _write(tmp_path, "in/e.txt", b"no,csv\n")
    _write(tmp_path, "in/f.csv", b"\xef\xbb\xbfid\r\n" + b"".join(b"%d\r\n" % i for i in range(5000)))
    got = {r["name"]: (r["encoding"], r["n_rows"], r["preview"]) for r in csv_previews(spark, str(tmp_path / "in"), 3).collect()}
    assert got == {
        "a.csv": ("utf-8", 3, 'a.csv\n=====\nid,name\n1,é\n2,"two\nlines"\n4,\n\n\n'),
        "b.csv": ("latin-1", 1, "b.csv\n=====\nid,name\n1,café\n\n\n"),
        "c.csv": ("utf-8", 0, "c.csv\n=====\n[INFO] File read successfully but returned 0 rows.\n\n"),
        "f.csv": ("utf-8", 3, "f.csv\n=====\nid\n0\n1\n2\n\n\n"),
    }
    assert {r["name"] for r in csv_previews(spark, str(tmp_path / "in"), recursive=False).collect()} == {"a.csv", "c.csv", "f.csv"}
    write_previews(csv_previews(spark, str(tmp_path / "in"), 3), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert all(p in text for _, _, p in got.values())


def test_files_of_several_blocks_are_read_from_their_first(spark, tmp_path):
    _write(tmp_path, "x/big.csv", b"n\n" + b"".join(b"%07d\n" % i for i in range(60000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert [r["preview"] for r in csv_previews(spark, str(tmp_path / "x"), 2).collect()] == ["big.csv\n=======\nn\n0000000\n0000001\n\n\n"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_document_of_records(spark):
    pks = spark.createDataFrame([("t", "id", 1, 1.0, 0, ["pk_unique_high"]), ("t", "code", 2, 0.9, 0, ["pk_unique_high"])], "table_name string, column_name string, place int, confidence double, refs long, reason_codes array<string>")
    p = spark.createDataFrame([("t", "id", "int", 1, 5 * 10**9, 10.0, 1.0)], "table_name string, column_name string, dtype_family string, int_min long, int_max long, max_len double, unique_ratio double")
    found = recommend.records({"primary_key": pks, "datatypes": recommend.datatypes(p)}, ["t", "u"])
    doc = recommend.schema_document(found, {"t": 3, "u": 0}, "now")
    t, u = doc["tables"]
    assert t["structure"]["primary_key"]["item"] == "id" and [a["name"] for a in t["structure"]["primary_key"]["alternatives"]] == ["code"]
    assert t["structure"]["primary_key"]["normalisation_disclosure"]["applied"] == ["trim_whitespace", "casefold_strings"]
    (column,) = t["datatypes"]["columns"]
    assert column["item"] == "id: BIGINT" and column["alternatives"] == [{"name": "INT", "confidence": 0.4, "blocker": "int_overflow_risk"}] and column["normalisation_disclosure"]["applied"] == ["numeric_coercion"]
    assert u["structure"]["primary_key"]["status"] == "info" and doc["normalisation_policy"]["trim_whitespace"]
    assert found.where(F.col("confidence").isNull()).count() == 0
