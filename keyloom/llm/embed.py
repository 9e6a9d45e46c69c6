"""Embedding near-dedup: exact cosine links by dual traversal of cover trees.

Unit vectors link when their distance is at most sqrt(2 - 2 * cosine). Equal vectors of a label are reduced to one first. The
vectors of a label (and dimension) form blocks of about BLOCK vectors: the leaves of a tree of cells around pivots, which Spark splits level by level. Pairs of cells whose covering balls are
too far apart are dropped on every level; the other pairs of blocks go to a task each, which builds a cover tree (nested levels, radii halving) of either block and walks pairs of nodes from
the roots: a pair is dropped if its balls are too far apart, counted whole if its farthest points still link, and else opened; at the leaves cosines are
computed in double precision. A task gives each vector's number of links and its group within the task, not the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, materialize, table

COSINE = 0.93
#: Vectors of a block, about; children of a cell on average at most, and levels of cells; points of a leaf.
BLOCK, FAN, DEPTH, LEAF = 8192, 256, 6, 32
#: Distances of nearly equal points are off by about 1e-8.
_SLACK = 1e-6
_BATCH = 512


class CoverTree:
    """Nodes with a centre, a covering radius and their points ``order[first:last]``; children are nested, their radii halve level by level."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.first, self.last, self.centre, self.radius, self.children = [0], [len(x)], [0], [0.0], [[]]
        todo = [(0, 2.0)] if len(x) else []
        while todo:
            node, r = todo.pop()
            i, j = self.first[node], self.last[node]
            members = self.order[i:j]
            far = self._distance(members, self.centre[node])
            self.radius[node] = float(far.max())
            if j - i <= leaf or self.radius[node] <= _SLACK:
                continue
            while r >= self.radius[node]:
                r /= 2
            # a node's centre is a centre of the next level, too
            left, parts = np.concatenate(([self.centre[node]], members[members != self.centre[node]])), []
            while len(left):
                some = left[:_BATCH]
                close, chosen = self._between(some, some) <= r, []
                free = np.ones(len(some), bool)
                for k in range(len(some)):
                    if free[k]:
                        chosen.append(k)
                        free &= ~close[k]
                near = self._between(some[chosen], left) <= r
                near[np.arange(len(chosen)), chosen] = True
                taken, owner = near.any(0), near.argmax(0)
                owner[chosen] = np.arange(len(chosen))
                for k, i0 in enumerate(chosen):
                    parts.append((int(some[i0]), left[taken & (owner == k)]))
                left = left[~taken]
            for centre, part in parts:
                self.order[i : i + len(part)] = part
                self.first.append(i)
                self.last.append(i + len(part))
                self.centre.append(centre)
                self.radius.append(0.0)
                self.children.append([])
                self.children[node].append(len(self.first) - 1)
                todo.append((len(self.first) - 1, r))
                i += len(part)
        self.first, self.last = np.array(self.first), np.array(self.last)

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[centre])))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[a] @ self.x[b].T)))

    def points(self, node: int) -> np.ndarray:
        return self.order[self.first[node] : self.last[node]]

    def points_of(self, nodes: np.ndarray) -> np.ndarray:
        """The points of several nodes, one after the other."""
        first = self.first[nodes]
        size = self.last[nodes] - first
        return self.order[np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)]


class Links:
    """Weighted link counts, and groups of linked points."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.parent = weight, np.zeros(len(weight), np.int64), list(range(len(weight)))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def pair(self, i: int, j: int) -> None:
        self.count[i] += self.weight[j]
        self.count[j] += self.weight[i]
        self.join(i, j)

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each of a links to each of b."""
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        for i in (*a.tolist(), *b.tolist()):
            self.join(int(a[0]), i)

    def all_within(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        for i in a.tolist():
            self.join(int(a[0]), i)

    def some(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        self.count[a] += linked @ self.weight[b]
        self.count[b] += self.weight[a] @ linked
        for i, j in zip(*np.nonzero(linked), strict=True):
            self.join(int(a[i]), int(b[j]))


def dual_traversal(a: CoverTree, b: CoverTree | None, links: Links, cosine: float) -> None:
    """Add to ``links`` every link between points of a and b, or within a if b is None. Points of b count from len(a.x) on.

    The stack holds nodes of a, each with the nodes of b that may hold links with it (itself alone, if it is one of them); the children of both are compared as a matrix, some rows at a time.
    A node may be near thousands of nodes of one point, so these are never taken pair by pair.
    """
    same, shift = b is None, 0 if b is None else len(a.x)
    b = a if b is None else b
    if not len(a.x) or not len(b.x):
        return
    reach = np.sqrt(2 - 2 * cosine)
    ra, rb, ca, cb = (np.array(v) for v in (a.radius, b.radius, a.centre, b.centre))
    na, nb = (t.last - t.first for t in (a, b))
    leaf_a, leaf_b = (np.array([not c for c in t.children]) for t in (a, b))
    stack = [(0, np.array([0]))]
    while stack:
        m, ns = stack.pop()
        own = same and ns[0] == m
        if leaf_a[m] and leaf_b[ns].all():
            p, q = a.points(m), b.points_of(ns)
            found = a.x[p] @ b.x[q].T >= cosine
            if own:
                found = np.triu(found, 1)
            links.some(p, q + shift, found)
            continue
        left = np.array(a.children[m] or [m])
        right = np.concatenate([b.children[n] or [n] for n in ns])
        for at in range(0, len(left), _BATCH):
            rows = left[at : at + _BATCH]
            cos = a.x[ca[rows]] @ b.x[cb[right]].T
            d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
            apart = ra[rows][:, None] + rb[right]
            keep = d - apart <= reach + _SLACK
            if own:
                keep &= np.arange(at, at + len(rows))[:, None] <= np.arange(len(right))
                diagonal = np.arange(at, at + len(rows))[:, None] == np.arange(len(right))
            else:
                diagonal = np.zeros_like(keep)
            single = keep & ~diagonal & ((na[rows] == 1)[:, None] & (nb[right] == 1))
            linked = single & (cos >= cosine)
            for i, j in zip(*np.nonzero(linked), strict=True):
                links.pair(int(ca[rows[i]]), int(cb[right[j]]) + shift)
            whole = keep & ~single & (d + apart < reach - _SLACK)
            for i, j in zip(*np.nonzero(whole), strict=True):
                if diagonal[i, j]:
                    links.all_within(a.points(rows[i]))
                else:
                    links.all_between(a.points(rows[i]), b.points(right[j]) + shift)
            opened = keep & ~single & ~whole & ~(diagonal & (na[rows] == 1)[:, None])
            leaves = opened & ~diagonal & leaf_a[rows][:, None] & leaf_b[right]
            for i in np.flatnonzero(leaves.any(1)):
                p, q = a.points(rows[i]), b.points_of(right[leaves[i]])
                links.some(p, q + shift, a.x[p] @ b.x[q].T >= cosine)
            stack += [(int(rows[i]), right[j : j + 1]) for i, j in zip(*np.nonzero(opened & diagonal), strict=True)]
            opened &= ~leaves & ~diagonal
            stack += [(int(rows[i]), right[opened[i]]) for i in np.flatnonzero(opened.any(1))]


def _units(vectors: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null and zero vectors and those with null or non-finite components."""
    out = []
    for v in vectors:
        v = v.values if v.is_valid else None
        x = v.to_numpy(zero_copy_only=False).astype(np.float64) if v is not None and not v.null_count else np.empty(0)
        top = np.abs(x).max(initial=0.0)
        if np.isfinite(top) and top > 0:
            x = x / top  # so that no square over- or underflows
            out.append(x / np.sqrt(x @ x))
        else:
            out.append(None)
    return out


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, kind (label and dimension; null if the vector links with nothing), digest, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, labels = _units(b.column(2)), b.column(1).to_pylist()
            kind = [None if u is None or lab is None else f"{lab}:{len(u)}" for u, lab in zip(units, labels, strict=True)]
            digest = [None if k is None else hashlib.blake2b((v.values.to_numpy(zero_copy_only=False) + 0.0).tobytes(), digest_size=16).digest() for k, v in zip(kind, b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kind, pa.string()), pa.array(digest, pa.binary()), b.column(2)], ["vec_id", "kind", "digest", "embedding"])

    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.mapInArrow(run, "vec_id long, kind string, digest binary, embedding array<double>")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors, a row each, of vectors of one dimension that have some."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _pivots(crowded: DataFrame, level: int, block: int) -> DataFrame:
    """(cell, pivot, centre): of each crowded cell about as many vectors, as units, as it should have children; FAN on average at most."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            centres = pa.array(_units(b.column(2)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), centres], ["cell", "pivot", "centre"])

    children = F.least(F.lit(float(FAN)), F.ceil(2 * F.col("n") / F.lit(block)))
    picked = crowded.where("rep is not null").where(_uniform(F.lit(f"pivot {level}"), F.col("rep")) < children / F.col("n"))
    return materialize(picked.select("cell", F.col("rep").alias("pivot"), "embedding").mapInArrow(units, "cell string, pivot long, centre array<double>"))


def _nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Adds pivot (the nearest one; of equally near ones the smallest) and gap (its distance); null without pivots."""
    rows = rows.select(["rep", "kind", "copies", "embedding", "cell"])
    if not rows.num_rows or not pivots.num_rows:
        return rows.append_column("pivot", pa.nulls(rows.num_rows, pa.int64())).append_column("gap", pa.nulls(rows.num_rows, pa.float64()))
    pivots = pivots.sort_by("pivot").combine_chunks()
    centres = _matrix(pivots["centre"].combine_chunks())
    parts = [_distances(_matrix(b.column("embedding")), centres) for b in rows.to_batches(_BATCH)]
    nearest = np.concatenate([d.argmin(1) for d in parts])
    gaps = np.concatenate([d.min(1) for d in parts])
    return rows.append_column("pivot", pa.array(pivots["pivot"].to_numpy()[nearest])).append_column("gap", pa.array(gaps))


def _blocks(distinct: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, kind, copies, embedding, cell): the leaves of a tree of cells, of about ``block`` vectors at most; and its levels (parent, cell, centre, radius).

    A kind is a root. Cells that are too large are split around pivots of their own, level by level; a cell's vectors and pivots meet in tasks of a few blocks. Only cells that
    DEPTH levels leave too large, as vectors of one direction do, are split by a hash; the parts keep their cell's ball.
    """
    rows, leaves, levels = distinct.withColumn("cell", F.col("kind")), [], []
    for level in range(DEPTH + 1):
        sizes = materialize(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block))
        leaves.append(rows.join(sizes, "cell", "left_anti"))
        if sizes.isEmpty():
            break
        crowded = rows.join(sizes, "cell")
        if level == DEPTH:
            part = F.pmod(F.xxhash64(F.lit("part"), F.col("rep")), F.ceil(F.col("n") / F.lit(block)))
            parts = materialize(crowded.withColumn("parent", F.col("cell")).withColumn("cell", F.concat_ws("#", "cell", part.cast("string"))).drop("n"))
            levels.append(parts.select("parent", "cell").distinct().withColumns({"centre": F.lit(None).cast("array<double>"), "radius": F.lit(None).cast("double")}))
            leaves.append(parts.drop("parent"))
            break
        pivots = _pivots(crowded, level, block)
        slices = F.ceil(F.col("n") / F.lit(4 * block))
        sliced = crowded.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), F.col("rep")), slices))
        sent = pivots.join(sizes, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("n")
        moved = sliced.groupBy("cell", "slice").cogroup(sent.groupBy("cell", "slice")).applyInArrow(_nearest, "rep long, kind string, copies long, embedding array<double>, cell string, pivot long, gap double")
        moved = materialize(moved)
        child = F.concat_ws("/", "cell", F.col("pivot").cast("string"))  # the cell itself, if it has no pivot this time
        balls = moved.where("pivot is not null").groupBy("cell", "pivot").agg(F.max("gap").alias("radius"))
        levels.append(materialize(balls.join(pivots, ["cell", "pivot"]).select(F.col("cell").alias("parent"), child.alias("cell"), "centre", "radius")))
        rows = moved.select("rep", "kind", "copies", "embedding", child.alias("cell"))
    names = ["rep", "kind", "copies", "embedding", "cell"]
    return materialize(reduce(DataFrame.unionByName, (x.select(*names) for x in leaves))), levels


def _block_pairs(blocks: DataFrame, levels: list[DataFrame], cosine: float) -> DataFrame:
    """(a, b): pairs of leaf cells of a kind, each with itself, too, whose covering balls come within reach.

    The pairs of a level are those of its children whose parents' balls come within reach, so that cells far apart never meet.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    ball = {f"{x}_{s}": F.lit(None).cast(t) for s in "ab" for x, t in (("centre", "array<double>"), ("radius", "double"))}
    pairs = blocks.select("kind").distinct().select(F.col("kind").alias("a"), F.col("kind").alias("b")).withColumns(ball)
    for level in levels:
        own = F.col("a") == F.col("b")
        pairs = pairs.withColumn("own", own)
        for s in "ab":
            kids = level.select(F.col("parent").alias(s), F.col("cell").alias("kid"), F.col("centre").alias("kid_centre"), F.col("radius").alias("kid_radius"))
            inner = {s: F.coalesce("kid", s), f"centre_{s}": F.coalesce("kid_centre", f"centre_{s}"), f"radius_{s}": F.coalesce("kid_radius", f"radius_{s}")}
            pairs = pairs.join(kids, s, "left").withColumns(inner).drop("kid", "kid_centre", "kid_radius")
        dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) - F.col("radius_a") - F.col("radius_b") > reach
        pairs = materialize(pairs.where("not own or a <= b").where(~F.coalesce(apart, F.lit(False))).drop("own"))
    return pairs.select("a", "b")


def near_groups(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors of one label that is not null link at a cosine of ``cosine`` or more. Null and zero vectors, and those with null or non-finite components, link with nothing, as do vectors of
    different dimension. n_links counts the other rows that a row links to; component_id is the smallest vec_id reachable. Repeated rows link with
    each other. An empty table gives no rows.
    """
    keyed = materialize(_keyed(vectors))
    distinct = materialize(keyed.where("kind is not null").groupBy("kind", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    blocks, levels = _blocks(distinct.select("rep", "kind", "copies", "embedding"), block)
    pairs = _block_pairs(blocks, levels, cosine)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        x = _matrix(t["embedding"].combine_chunks())[order]
        rep, weight, n = t["rep"].to_numpy()[order], t["copies"].to_numpy()[order], int((side == 0).sum())
        links = Links(weight)
        a = CoverTree(x[:n])
        if n == len(x):
            dual_traversal(a, None, links, cosine)
        else:
            dual_traversal(a, CoverTree(x[n:]), links, cosine)
        root = rep[[links.find(i) for i in range(len(rep))]]
        return pa.table({"rep": rep, "links": links.count, "root": root})

    sides = F.array(*(F.struct(F.col(c).alias("cell"), F.lit(i).alias("side")) for i, c in enumerate("ab")))
    tasks = pairs.select("a", "b", F.inline(sides)).where("side = 0 or a <> b").join(blocks.select("cell", "rep", "copies", "embedding"), "cell")
    found = materialize(tasks.select("a", "b", "side", "rep", "copies", "embedding").groupBy("a", "b").applyInArrow(run, "rep long, links long, root long"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.select("kind", "digest", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("kind", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "kind", "digest").join(named, ["kind", "digest"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.c = l.a
), comp AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = vec_id
"""
