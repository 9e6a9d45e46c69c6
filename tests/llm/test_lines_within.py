from keyloom.llm import lines as ld


def test_op8_extends_runs_within_a_document(spark, tmp_path):
    run = [" ".join(f"p{i}x{j}" for j in range(11)) for i in range(5)] + ["short tail", "last of it"]
    text = "\n".join(["head", *run, "between", *run, "end"])
    spark.createDataFrame([(1, text), (2, "alone")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["clean_chars"]) for r in ld.op8_line_dedup(spark, str(tmp_path)).collect()}
    clean = "\n".join(["head", *run, "between", "end"])
    assert got == {1: (17, 7, len(clean)), 2: (1, 0, 5)}
