"""Whitening against exact integer sums and a covariance of all rows at once."""

import numpy as np

from keyloom.llm import whiten

SF = "/root/testdata/sf0.01"


def _run(spark, rows, kind="array<float>", parts=5):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(parts)
    return [tuple(r) for r in whiten.whiten(df.withColumns({"x": whiten.F.lit(1), "n": whiten.F.lit("clash"), "component": whiten.F.lit(2)})).collect()]


def check(got, rows):
    x = np.floor(1024 * np.array([v for _, v in rows], float)) + 100_000
    n, d = x.shape
    cov = np.cov(x.T.astype(np.longdouble).astype(float), bias=True).reshape(d, d)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    sums = [sum(int(c) for c in col) for col in x.T]
    whitened = (x - x.mean(0)) @ v / np.sqrt(np.maximum(e, 1e-300))
    assert len(got) == n * min(8, d)
    place = {}
    for k, (i, _) in enumerate(rows):
        place.setdefault(i, k)
    sign = {}
    for i, c, count, deviation, w, explained, error in got:
        k = place[i]
        assert count == n and deviation == sum((n * int(a) - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert abs(explained - e[c - 1] / e.sum()) <= 1e-9 and error < 1e-9
        want = whitened[k, c - 1]
        if abs(want) > 1e-6:
            assert sign.setdefault(c, np.sign(w * want)) == np.sign(w * want)
        assert abs(abs(w) - abs(want)) < 1e-6


def test_against_numpy_at_once(spark):
    rows = [(r[0], list(r[1])) for r in whiten.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    check(_run(spark, rows), rows)


def test_far_from_the_origin_few_dimensions_and_repeated_rows(spark):
    dice = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate((1e6 + dice.normal(size=(200, 3)) * [1, 5, 0.5]).tolist())]
    rows += rows[:7]
    check(_run(spark, rows, "array<double>"), rows)


def test_rows_that_take_no_part_and_components_without_variance(spark):
    bad = [(90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, []), (95, [1.0]), (96, [1e306, 0.0])]
    rows = [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (None, [2.5, 1.0])]
    got = _run(spark, rows + bad, "array<double>")
    assert {r[0] for r in got} == {1, 2, None} and len(got) == 6
    for _, c, n, _, w, explained, error in got:
        assert n == 3 and error < 1e-12 and (w is None) == (c == 2) and abs(explained - (c == 1)) < 1e-12
    assert {r[3] for r in got if r[0] == 1} == {(3 * 512 - 512 - 1536 - 2560) ** 2}


def test_single_rows_equal_rows_and_empty_tables(spark):
    assert _run(spark, []) == [] and _run(spark, [(1, None)]) == []
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4):
        assert set(_run(spark, rows)) == {(1, c, len(rows), 0, None, 0.0, None) for c in (1, 2)}


def test_deviations_that_leave_a_long_are_exact_or_null(spark):
    rows = [(1, [1e9]), (2, [-1e9]), (3, [1.0]), (4, [3e4])]
    got = {r[0]: r[3] for r in _run(spark, rows, "array<double>")}
    x = [int(1024 * v[0] // 1) + 100_000 for _, v in rows]
    exact = {i: (4 * a - sum(x)) ** 2 for (i, _), a in zip(rows, x, strict=True)}
    assert got == {i: v if v < 2**63 else None for i, v in exact.items()} and None in got.values()


def test_merging_partials_is_what_one_partial_gives():
    x = np.random.default_rng(4).normal(size=(100, 4)) + 1e5
    parts = [whiten.partial(x[i:j])._replace(sums=[0] * 4) for i, j in ((0, 0), (0, 1), (1, 60), (60, 100))]
    one, many = whiten.partial(x), parts[0]
    for p in parts[1:]:
        many = whiten.merge(many, p)
    assert many.n == one.n and np.allclose(many.mean, one.mean, rtol=1e-14) and np.allclose(many.scatter, one.scatter, rtol=1e-9)
