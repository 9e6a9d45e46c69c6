import math

import numpy as np
import pytest

from keyloom.llm import embed


def brute(x, weight, cosine):
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near @ weight, near


def clusters(rng, n, d):
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(6, size=n)] + rng.normal(size=(n, d)) * rng.choice([0.0, 0.02, 0.1, 0.3, 1.0], size=(n, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@pytest.mark.parametrize("leaf", [1, 8, 32])
@pytest.mark.parametrize("d", [2, 8, 40])
def test_dual_traversal(d, leaf):
    rng = np.random.default_rng(d + leaf)
    x, w = clusters(rng, 150, d), rng.integers(1, 4, 150)
    for cosine in (0.93, 0.5, 0.999):
        count, near = brute(x, w, cosine)
        links = embed.Links(w)
        embed.dual_traversal(embed.CoverTree(x, leaf), None, links, cosine)
        assert links.count.tolist() == count.tolist()
        both = embed.Links(w)
        embed.dual_traversal(embed.CoverTree(x[:70], leaf), embed.CoverTree(x[70:], leaf), both, cosine)
        assert both.count.tolist() == np.concatenate((near[:70, 70:] @ w[70:], near[70:, :70] @ w[:70])).tolist()


def test_covering_radii():
    x = clusters(np.random.default_rng(1), 300, 5)
    t = embed.CoverTree(x, 4)
    for k in range(len(t.first)):
        p = t.points(k)
        assert t.centre[k] in p
        assert np.linalg.norm(x[p] - x[t.centre[k]], axis=1).max() <= t.radius[k] + 1e-7
        if t.children[k]:
            assert sorted(np.concatenate([t.points(c) for c in t.children[k]])) == sorted(p)
            assert t.centre[k] in [t.centre[c] for c in t.children[k]]


@pytest.mark.parametrize("block", [16, 8192])
def test_near_groups(spark, block):
    rng = np.random.default_rng(7)
    x = np.vstack([clusters(rng, 220, 6), np.repeat(clusters(rng, 1, 6), 20, 0)]).astype(np.float32)
    rows = [(i + 10, int(i % 2) if i < 200 else 0, [float(c) for c in v * (1 + i % 3)]) for i, v in enumerate(x)]
    odd = [(0, 0, None), (1, 0, [0.0] * 6), (2, 0, [math.nan] + [1.0] * 5), (3, 0, [math.inf] * 6), (4, 0, [None, 1.0]), (5, None, rows[0][2]), (6, 0, [1.0, 0.0]), (7, 0, [2.0, 0.1]), (8, 0, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, label int, embedding array<float>, kind string")
    got = {r["vec_id"]: r for r in embed.near_groups(df, block=block).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, _, v in rows}
    near = {i: {j for j, m, _ in rows if m == lab and j != i and unit[i] @ unit[j] >= 0.93} for i, lab, _ in rows}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near[i]), min(seen), min(seen) == i)
    for i in (0, 1, 2, 3, 4, 5, 8):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (6, 7)] == [(1, 6), (1, 6)]
    assert embed.near_groups(df.limit(0)).count() == 0


def test_many_blocks_of_one_label(spark):
    """Over 512 blocks around pivots of pivots, vectors of one direction among them: the links are those of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 12))
    x = centres[rng.integers(150, size=1500)] + rng.normal(size=(1500, 12)) * rng.choice([0.05, 0.2], size=(1500, 1))
    x[:60] = x[0] * rng.uniform(1, 2, size=(60, 1))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    flat = spark.createDataFrame([(i, "0:12", 1, v.tolist()) for i, v in enumerate(x)], "rep long, kind string, copies long, embedding array<double>")
    blocks, levels = embed._blocks(flat, 4)
    sizes = [r["count"] for r in blocks.groupBy("cell").count().collect()]
    assert sum(sizes) == 1500 and len(sizes) > 512 and len(levels) > 2
    pairs = embed._block_pairs(blocks, levels, 0.93)
    assert pairs.count() == pairs.distinct().count() < len(sizes) ** 2 / 8
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    count, near = brute(unit, np.ones(1500, np.int64), 0.93)
    least = np.arange(1500)
    while True:
        new = np.minimum(least, np.where(near, least[None, :], 1500).min(1))
        if (new == least).all():
            break
        least = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_groups(df, block=4).collect()}
    assert got == {i: (int(count[i]), int(least[i])) for i in range(1500)}


def test_a_near_group_among_many_lone_points_takes_few_steps(monkeypatch):
    """Nodes of one point are compared with an inner node's children together, not one by one."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=12) + 0.7 * rng.normal(size=(300, 12))
    x = np.vstack([group, rng.normal(size=(900, 12))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    steps, real = [], embed.Links.some
    monkeypatch.setattr(embed.Links, "some", lambda *a: (steps.append(1), real(*a)))
    links, w = embed.Links(np.ones(len(x), np.int64)), np.ones(len(x), np.int64)
    embed.dual_traversal(embed.CoverTree(x), None, links, 0.93)
    assert links.count.tolist() == brute(x, w, 0.93)[0].tolist()
    assert len(steps) < 3 * len(x)
