import random
import time

import pytest
from pyspark.sql import functions as F

from keyloom.llm import lines as ld


def deleted(rows, words, lines, order):
    """{(doc_id, text): set of deleted line numbers}: on every diagonal of every pair of documents, and of each with itself, the whole runs of equal lines that are passages."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda d: (d[0], d[1], order[d[2]]))
    split = [d[2].split("\n") for d in docs]
    gone = [set() for _ in docs]
    for k, mine in enumerate(split):
        for j, other in enumerate(split[: k + 1]):
            for shift in range(1 if j == k else 1 - len(other), len(mine)):
                run = []
                for p in range(max(shift, 0), len(mine) + 1):
                    if p < len(mine) and 0 <= p - shift < len(other) and mine[p] == other[p - shift]:
                        run.append(p)
                        continue
                    if len(run) >= lines or sum(len(mine[q].split(" ")) if mine[q] else 0 for q in run) >= words:
                        gone[k] |= set(run)
                    run = []
    return {(d[1] if d[0] else None, d[2]): gone[k] for k, d in enumerate(docs)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 6))) for _ in range(30)] + ["hot line"] * 10
    passages = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(5)] + [["one long line " * 5]]
    rows = []
    for i in range(60):
        ls = []
        while len(ls) < rng.randint(1, 15):
            ls += rng.choice(passages) if rng.random() < 0.4 else [f"own {i} {len(ls)} " + rng.choice(pool)] if rng.random() < 0.7 else [rng.choice(pool)]
        rows.append((i if i else None, "\n".join(ls)))
    rows += [rows[5], (6, "other text under a known id"), (100, None), (101, ""), (102, "\n\n\n"), (103, rows[9][1])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, n_lines int").repartition(3)
    hashes = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    want = deleted(rows, 10, 4, hashes)
    out = ld.dedup_lines(df, 10, 4)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_removed", "clean_text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ls, gone = (r["text"] or "").split("\n"), want[(r["doc_id"], r["text"] or "")]
        assert (r["n_lines"], r["n_removed"]) == (len(ls), len(gone)), r
        assert r["clean_text"] == "\n".join(x for i, x in enumerate(ls) if i not in gone)
    assert any(r["n_removed"] for r in got)
    flat = ld.split_lines(df)
    places = ld.selected_places(flat, 10, 4)
    assert ld.repeated_lines(ld.extended(flat, ld.meeting_places(places), 10, 4)).count() == sum(map(len, want.values()))


def test_passages_of_fifty_words(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(11)) for i in range(5))
    single = " ".join(f"s{j}" for j in range(55))
    rows = [(i, f"start {i}\n{passage}\nend {i}\n{single}\nlast {i}") for i in range(4)] + [(9, "clean\nshort line"), (10, "short line\nclean too")]
    got = {r["doc_id"]: r for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and got[9]["n_removed"] == got[10]["n_removed"] == 0
    for i in (1, 2, 3):
        assert got[i]["clean_text"] == f"start {i}\nend {i}\nlast {i}"
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_repeat_goes_on_after_a_passage_known_from_elsewhere(spark):
    passage, tail = " ".join(f"p{j}" for j in range(82)), ["ten " * 9 + "words", "nine short", "x", "the end of it"]
    rows = [(1, passage), (2, "\n".join([passage, *tail])), (3, "\n".join([passage, *tail]))]
    got = {r["doc_id"]: r["clean_text"] for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "\n".join(tail), 3: ""}


def test_long_texts_of_equal_lines(spark):
    began = time.time()
    df = spark.createDataFrame([(i, "\n".join(["the same line"] * 50_000)) for i in (1, 2)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_removed"]) for r in ld.dedup_lines(df).orderBy("doc_id").collect()] == [(1, 49_999), (2, 50_000)]
    assert time.time() - began < 60


def test_long_texts_of_different_lines_with_one_repeat(spark):
    began = time.time()
    passage = [f"passage line {i} of eight" for i in range(8)]
    rows = [(1, "\n".join([*(f"first {i}" for i in range(50_000)), *passage])), (2, "\n".join([*passage, *(f"second {i}" for i in range(50_000))]))]
    got = {r["doc_id"]: (r["n_removed"], r["clean_text"]) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, rows[0][1]), 2: (8, rows[1][1][len("\n".join(passage)) + 1 :])}
    assert time.time() - began < 60


def test_selection_is_sparse_and_decides_what_is_compared(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(f"line {i} {rng.random()}" for _ in range(200))) for i in range(20)]
    rows += [(100 + i, "\n".join([f"head {i}", *(f"shared {k}" for k in range(12)), f"tail {i}"])) for i in range(3)]
    flat = ld.split_lines(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    places, all_windows = ld.selected_places(flat), ld.windows(flat)
    met = ld.meeting_places(places)
    assert places.count() < 0.4 * all_windows.count()
    around = ld.extended(flat, met)
    assert {r["doc"]["doc_id"] for r in around.select("doc").distinct().collect()} == {100, 101, 102}
    unselected = flat.select("doc", F.posexplode("arr").alias("low", "x")).select("doc", "low", F.col("x.h").alias("lh"))
    assert ld.meeting_places(unselected).count() > met.count() > 0  # each shared line would meet, not a few of them
    assert ld.repeated_lines(around).count() == 2 * 12
    assert ld.repeated_lines(ld.extended(flat, met.where("doc.doc_id < 101"))).count() == 0


def test_ties_of_doc_ids_are_broken_by_the_text(spark):
    passage = "\n".join(f"p{i}" for i in range(8))
    rows = [(1, passage + "\nx"), (1, passage + "\ny"), (1, passage + "\ny")]
    got = [(r["text"], r["n_removed"]) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(n for _, n in got) in ([0, 0, 8], [0, 8, 8]) and len({(t, n) for t, n in got}) == 2
