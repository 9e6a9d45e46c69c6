"""Nearest neighbours against brute force: recall of the search, and exact results where all leaves are visited."""

import numpy as np
import pytest

from keyloom.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q in sorted({i for i, _ in ok if i in queries}):
        best = {}
        for j, v in ok:
            if j != q:
                s = max(float(v @ w / np.sqrt((v @ v) * (w @ w))) for i, w in ok if i == q)
                best[j] = max(best.get(j, -2), round(s, 12))
        for n, (j, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, n, j))
    return out


def _find(spark, rows, every=50, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": ann.F.lit(1), "key": ann.F.lit("k"), "ids": ann.F.lit(2)})
    return ann.neighbours(df, df.where(f"vec_id % {every} = 0"), **kw)


def _vectors(n, d, seed=0):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


@pytest.mark.parametrize("table", ["sf0.01", "random", "clusters"])
def test_recall_and_scores(spark, table):
    if table == "sf0.01":
        rows = [(r[0], list(r[1])) for r in ann.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    elif table == "random":
        rows = list(enumerate(_vectors(4000, 24).tolist()))
    else:
        dice = np.random.default_rng(3)
        centres = dice.normal(size=(40, 32))
        rows = list(enumerate((centres[dice.integers(0, 40, 4000)] + 0.1 * dice.normal(size=(4000, 32))).astype(np.float32).tolist()))
    found = [tuple(r) for r in _find(spark, rows, sample=1500).collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    place = {i: n for n, (i, _) in enumerate(rows)}
    queries = [i for i, _ in rows if i % 50 == 0]
    assert {(q, r) for q, r, _, _ in found} == {(q, r) for q in queries for r in range(1, 6)}
    assert all(abs(s - x[place[q]] @ x[place[v]]) < 1e-12 and q != v for q, _, v, s in found)
    hits = 0
    for q in queries:
        s = x @ x[place[q]]
        s[place[q]] = -2
        hits += len({rows[i][0] for i in np.argsort(-s)[:5]} & {v for a, _, v, _ in found if a == q})
    assert hits / (5 * len(queries)) >= 0.9


def test_ties_copies_repeated_rows_and_what_takes_no_part(spark):
    base = _vectors(30, 6, 1).tolist()
    rows = [(i, base[i % 7]) for i in range(60)] + [(100 + i, v) for i, v in enumerate(base)] + [(5, base[5]), (5, base[5]), (0, base[9]), (0, base[0])]
    rows += [(200, None), (250, []), (300, [0.0] * 6), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, base[0]), (500, [1.0, 2.0]), (550, [1e-30] * 6), (600, [1e30] * 6)]
    got = {tuple(r)[:3] for r in _find(spark, rows, 10, leaf=4, recall=1.0).collect()}
    queries = {i for i, _ in rows if i is not None and i % 10 == 0}
    assert got == brute([r for r in rows if r[0] not in (500,)], queries)


def test_few_candidates_and_empty_tables(spark):
    assert _find(spark, []).collect() == []
    assert _find(spark, [(0, [0.0, 0.0])]).collect() == []
    assert _find(spark, [(0, [1.0, 0.0])]).collect() == []
    assert [tuple(r) for r in _find(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0])]).collect()] == [(0, 1, 1, 0.0)]


def test_crowded_copies_and_near_copies_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "CROWD", 4)
    dice = np.random.default_rng(5)
    one = dice.normal(size=16)
    rows = [(i, one.astype(np.float32).tolist()) for i in range(700)] + [(i, (one + 0.001 * dice.normal(size=16)).astype(np.float32).tolist()) for i in range(700, 1200)]
    rows += [(i, v) for i, v in enumerate(_vectors(300, 16, 6).tolist(), 1200)]
    found = {(q, v) for q, _, v, _ in map(tuple, _find(spark, rows).collect())}
    want = {(q, v) for q, _, v in brute(rows, {i for i, _ in rows if i % 50 == 0})}
    assert {x for x in found if x[0] < 700} == {x for x in want if x[0] < 700}
    assert len(found & want) / len(want) >= 0.9


def test_the_queue_orders_leaves_by_violation_and_a_small_reach_visits_few():
    u = ann.units(_vectors(2000, 16, 7).astype(float))
    forest = ann.grow(u, 3, 50)
    v = forest.violations(u[:5])
    for i in range(5):
        margins = forest.normal @ u[i] - forest.cut
        everything = forest.search(margins, np.inf)
        assert sorted(everything) == list(range(forest.leaves)) and (np.diff(v[i][everything]) >= -1e-12).all()
        assert set(forest.search(margins, 0.0)) == set(forest.route(u[i : i + 1])[0].tolist())
