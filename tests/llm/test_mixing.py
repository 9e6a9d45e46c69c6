import math
import random
from collections import defaultdict

import pytest

from keyloom.llm import mixing

COLS = "doc_id long, text string, lang string, source string, n_chars long, key string, copies long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", 9) for i, t, s in rows], COLS)


def brute_targets(totals, weights=mixing.WEIGHTS, most=3):
    order = sorted([s for s in totals if s is not None]) + [None] * (None in totals)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(totals.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * totals[s] for s in capped)
        new = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * totals[s]}
        if not new:
            return {s: most * totals[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in order}
        capped |= new


def rows_of(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["hot"] * 8 + ["b", "c", "é", "z", None, ""]) if rng.random() < 0.97 else "tiny"
        k = 7 if s == "hot" and rng.random() < 0.7 else int(rng.lognormvariate(3, 1))
        rows.append((i, None if rng.random() < 0.01 else " ".join(["w x"] * k), s))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = rows_of(seed)
    df = docs_of(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    text = {i: (t, s) for i, t, s in rows}
    totals, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        totals[s] += len((t or "").encode().split())
    want = brute_targets(totals)
    for r in got:
        t, s = text[r["doc_id"]]
        assert (r["source"], r["size"], r["source_size"]) == (s, len((t or "").encode().split()), totals[s])
        assert math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5, (s, taken[s], t)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(again) == sorted(got) if all(x is not None for r in got for x in r) else {tuple(r) for r in again} == {tuple(r) for r in got}


def test_rates_are_exponential_tilts(spark):
    rows = [(i, "w " * (1 + i % 30), "ab"[i % 2]) for i in range(600)]
    cells = docs_of(spark, rows).selectExpr("concat('s', source) AS key", "cast(size(split(trim(text), ' ')) AS long) AS size").groupBy("key", "size").count().withColumnRenamed("count", "n")
    totals = cells.groupBy("key").agg({"key": "count"}).selectExpr("substr(key, 2) AS source", "key").join(cells.selectExpr("key", "n * size AS t").groupBy("key").sum("t").withColumnRenamed("sum(t)", "total"), "key")
    src = mixing.source_targets(totals)
    state = {r["key"]: r for r in mixing.balance(cells, src).collect()}
    for key, s in state.items():
        tokens = sum(r["n"] * r["size"] * min(3, math.exp(s["lam"] * r["size"] / s["mean"])) for r in cells.collect() if r["key"] == key)
        assert math.isclose(tokens, s["target"], rel_tol=1e-6)


def test_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    none = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a"), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 3
    one = mixing.mix(docs_of(spark, [(None, "a b", "a"), (3, "a b c", "a")])).collect()
    assert sum(r["taken"] for r in one) == 5


def test_mixed_documents(spark):
    rows = rows_of(3, 500) + [(7, "repeated row", "b")] * 3
    df = docs_of(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r["source"]] += len((r["text"] or "").split(" "))
    sizes = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    for s, t in sizes.items():
        assert abs(taken[s] - t) <= 0.1 * t + 10
