"""Approximate nearest neighbours by cosine: a forest of random-projection trees, searched through a shared priority queue, then exact reranking.

The trees are fitted to a sample of SAMPLE distinct vectors at most: a node's direction is the difference of two of its points, its cut their median. Every distinct vector is indexed: it goes
to one leaf of each tree. A query walks all trees through one queue ordered by violation, the sum of squared margins of the cuts it has crossed, and stops when that exceeds its reach: its
distance to the nearest vectors of the sample, times a factor that is fitted on the sample, too, so that of a sampled point's true neighbours RECALL lie in the leaves visited. So the
work follows the data and not a fixed budget: where neighbours are close few leaves are visited, where vectors are spread at random most of them are.

Leaves next to each other form buckets of about BLOCK rows, larger leaves are split by a hash, and crowds of queries too: each (bucket, part, crowd) is a task of bounded size, which
compares a query with the rows of its leaves by cosine in double precision and keeps the best. Equal vectors are one row with their smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table
from .vectors import finite, matrix, usual_dimension

NEAREST, EVERY = 5, 50
#: Sampled vectors that the trees are fitted to, at most about; trees; sampled vectors of a leaf at most.
SAMPLE, TREES, LEAF = 32_768, 3, 64
#: The share of true neighbours that the leaves visited are to hold, on the sample; sampled points that it is measured on.
RECALL, PROBES = 0.985, 512
#: Rows and queries of a task, about.
BLOCK, CROWD = 8192, 512
_SLACK = 1e-9
_SEED = 11


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, also where squares would overflow or vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the vector b, in double precision; the same for equal vectors, wherever they stand."""
    top = np.abs(a).max(1), np.abs(b).max()
    if not (1e-100 < min(top[0].min(), top[1]) and max(top[0].max(), top[1]) < 1e100):
        a, b = a / top[0][:, None], b / top[1]
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))


class Forest(NamedTuple):
    """Trees in flat arrays: node i sends a point to ``kids[i, 0]`` if its product with ``normal[i]`` is at most ``cut[i]``, else to ``kids[i, 1]``; -1 - leaf is a leaf.

    Leaves count through all trees, in the order of their places, so that neighbours in number are neighbours in the tree.
    """

    normal: np.ndarray
    cut: np.ndarray
    kids: np.ndarray
    roots: np.ndarray
    first_leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.first_leaf[-1])

    def route(self, u: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree."""
        out = np.empty((len(u), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(u), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                i = at[inner]
                side = (u[inner] * self.normal[i]).sum(1) > self.cut[i]
                at[inner] = self.kids[i, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, margins: np.ndarray, most: float) -> list[int]:
        """Leaves by rising violation, up to ``most``, of all trees through one queue. ``margins``: of the query to every node's cut."""
        queue, found = [(0.0, int(r)) for r in self.roots], []
        heapq.heapify(queue)
        while queue and queue[0][0] <= most:
            v, i = heapq.heappop(queue)
            if i < 0:
                found.append(-1 - i)
                continue
            m, (low, high) = float(margins[i]), self.kids[i].tolist()
            heapq.heappush(queue, (v, low if m <= 0 else high))
            heapq.heappush(queue, (v + m * m, high if m <= 0 else low))
        return found

    def violations(self, u: np.ndarray) -> np.ndarray:
        """What it takes each of a few vectors to get into each leaf."""
        out, todo = np.empty((len(u), self.leaves)), [(int(r), np.zeros(len(u))) for r in self.roots]
        while todo:
            i, v = todo.pop()
            if i < 0:
                out[:, -1 - i] = v
                continue
            m = u @ self.normal[i] - self.cut[i]
            todo += [(int(self.kids[i, 0]), v + np.where(m > 0, m * m, 0)), (int(self.kids[i, 1]), v + np.where(m <= 0, m * m, 0))]
        return out


def grow(u: np.ndarray, trees: int, leaf: int) -> Forest:
    """A forest over the sample ``u`` of unit vectors; a set of points that no direction splits stays a leaf."""
    dice = np.random.default_rng(_SEED)
    normal, cut, kids, roots, first, leaves = [], [], [], [], [0], 0
    for _ in range(trees):
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(u)), -1, 0)]
        while todo:
            points, parent, side = todo.pop()
            here, low = -1 - leaves, None
            if len(points) > leaf:
                for _ in range(8):  # two equal points give no direction
                    a, b = u[dice.choice(points, 2, replace=False)]
                    d = a - b
                    if (size := np.sqrt(d @ d)) > 1e-9:
                        at = u[points] @ (d / size)
                        c = np.median(at)
                        low = at <= c
                        if 0 < low.sum() < len(points):
                            break
                    low = None
            if low is not None:
                here = len(cut)
                normal.append(d / size)
                cut.append(c)
                kids.append([0, 0])
                todo += [(points[~low], here, 1), (points[low], here, 0)]
            else:
                leaves += 1
            if parent < 0:
                roots.append(here)
            else:
                kids[parent][side] = here
        first.append(leaves)
    return Forest(np.array(normal).reshape(-1, u.shape[1]), np.array(cut), np.array(kids, np.int64).reshape(-1, 2), np.array(roots), np.array(first))


def _reaches(u: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The distance of each vector to its k-th nearest of the sample, itself included; 2 if there are too few."""
    if len(sample) < k:
        return np.full(len(u), 2.0)
    kth = np.partition(u @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
    return np.sqrt(np.maximum(0.0, 2 - 2 * kth))


def fitted_factor(u: np.ndarray, forest: Forest, nearest: int, recall: float) -> float:
    """By which a query's reach is multiplied, so that ``recall`` of the sampled points' nearest neighbours in the sample are found."""
    probes, leaf, k, ratios = u[:: max(1, len(u) // PROBES)][:PROBES], forest.route(u), min(nearest + 1, len(u)), [np.zeros(0)]
    for at in range(0, len(probes), 32):  # a few rows of the distances at a time
        part = probes[at : at + 32]
        close = part @ u.T
        near = np.argpartition(close, len(u) - k, axis=1)[:, len(u) - k :]
        reach, v = _reaches(part, u, k), forest.violations(part)
        need = np.sqrt(np.array([v[i][leaf[n]].min(1) for i, n in enumerate(near)]))
        ratios.append(np.where(need > 0, need / np.maximum(reach, 1e-12)[:, None], 0.0).ravel())
    ratio = np.concatenate(ratios)
    return float(np.quantile(ratio, recall)) if len(ratio) else 1.0


class Index(NamedTuple):
    forest: Forest
    sample: np.ndarray
    factor: float

    def leaves(self, u: np.ndarray, nearest: int) -> Iterator[list[int]]:
        """The leaves that each query visits."""
        f, some = self.forest, max(1, 2**22 // max(1, len(self.sample), len(self.forest.cut)))
        for at in range(0, len(u), some):
            part = u[at : at + some]
            reach = (self.factor * _reaches(part, self.sample, nearest + 1)) ** 2 * (1 + _SLACK)
            margins = part @ f.normal.T - f.cut
            for m, r in zip(margins, reach, strict=True):
                yield f.search(m, r)


def buckets(forest: Forest, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By leaf: its bucket; by bucket: into how many parts its rows are split. Leaves of a tree fill a bucket one after the other, up to BLOCK of ``rows``."""
    bucket, sizes, starts = np.zeros(len(rows), np.int32), [], set(forest.first_leaf[:-1].tolist())
    for leaf, n in enumerate(rows.tolist()):
        if leaf in starts or sizes[-1] + n > BLOCK:
            sizes.append(0)
        sizes[-1] += n
        bucket[leaf] = len(sizes) - 1
    return bucket, np.maximum(1, -(-np.array(sizes, np.int64) // BLOCK))


def _best(rows: pa.Table, queries: pa.Table, dimension: int, nearest: int) -> pa.Table:
    """For each query of a task the nearest of the rows in its leaves, as (key, vec_id, score)."""
    if not rows.num_rows or not queries.num_rows:
        return pa.table({"key": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    order = np.argsort(rows["leaf"].to_numpy(), kind="stable")
    leaf = rows["leaf"].to_numpy()[order]
    x, ids = matrix(rows["x"], dimension)[order], rows["ids"].combine_chunks()
    first_id, at, flat = ids.offsets.to_numpy(), order, ids.values.to_numpy()
    q, wanted, keys = matrix(queries["x"], dimension), queries["leaves"].combine_chunks(), queries["key"].combine_chunks()
    score = np.full((len(q), len(x)), -np.inf)
    of = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
    by = np.argsort(wanted.flatten().to_numpy(), kind="stable")
    asked, of = wanted.flatten().to_numpy()[by], of[by]
    ux, uq = units(x), units(q)
    for k in np.unique(leaf):
        i, j = np.searchsorted(leaf, [k, k + 1])
        m = of[slice(*np.searchsorted(asked, [k, k + 1]))]
        if len(m):
            score[m, i:j] = uq[m] @ ux[i:j].T
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for n, s in enumerate(score):
        some = min(nearest, int(np.isfinite(s).sum()))
        if not some:
            continue
        close = np.flatnonzero(s >= np.partition(s, len(s) - some)[len(s) - some] - _SLACK)
        exact = cosines(x[close], q[n])
        least = flat[first_id[at[close]]]
        close, exact = (v[np.lexsort((least, -exact))[:some]] for v in (close, exact))
        found = sorted((-e, int(v)) for e, c in zip(exact.tolist(), at[close], strict=True) for v in flat[first_id[c] : first_id[c + 1]])[:nearest]
        out[0].extend([n] * len(found))
        out[1].extend(v for _, v in found)
        out[2].extend(-e for e, _ in found)
    return pa.table({"key": keys.take(pa.array(out[0], pa.int64())), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """For each id of ``queries`` its nearest found of ``vectors`` (both: vec_id long, embedding): query_id, rank (from 1), vec_id, score (the cosine in double precision).

    Other rows with the query's own id are no candidates. Of equal scores the smaller vec_id comes first. Rows take no part if their id is null, their vector null, empty or zero, if it holds null
    or non-finite entries, or if its length isn't the most frequent one. Rows that share an id count as one item, whose score is the best of theirs. With fewer candidates, and
    only then, there are fewer than ``nearest`` rows for a query. An empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
        return df.where(F.col("vec_id").isNotNull() & finite(F.col("x")) & F.exists("x", lambda c: c != 0))

    rows = sound(vectors)
    dimension = usual_dimension(rows, "x")
    if dimension is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dimension)
    # equal vectors are one row, with as many of their ids as any query can want
    some_ids = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("n") <= nearest + 1)
    distinct = materialize(some_ids.groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    total = distinct.count()
    share = min(1.0, sample / max(1, total))
    some = distinct.where(F.pmod(F.xxhash64("ids"), F.lit(2**31)) < F.lit(int(share * 2**31))).select("ids", "x").toArrow()
    order = np.argsort([i[0].as_py() for i in some["ids"]], kind="stable")
    u = units(matrix(some["x"], dimension))[order] if len(order) else np.zeros((0, dimension))
    forest = grow(u, trees, leaf)
    index = Index(forest, u.astype(np.float32), fitted_factor(u, forest, nearest, recall))
    shared = spark.sparkContext.broadcast(index)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = shared.value.forest.route(units(matrix(b.column(0), dimension)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(leaves.ravel(), leaves.shape[1]).cast(pa.list_(pa.int32()))], [*b.schema.names, "leaves"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = list(shared.value.leaves(units(matrix(b.column(0), dimension)), nearest))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int32()))], [*b.schema.names, "leaves"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    asked = sound(queries).where(F.size("x") == dimension).select("x", F.sha2(F.to_json(F.struct("x")).cast("binary"), 256).alias("key"), "vec_id")
    homes = distinct.select("x", "ids").mapInArrow(routed, f"x {kind}, ids array<long>, leaves array<int>")
    walks = materialize(asked.select("x", "key").dropDuplicates(["key"]).mapInArrow(visiting, f"x {kind}, key string, leaves array<int>"))

    def counts(df: DataFrame, by: str, size: int) -> np.ndarray:
        """Of leaves or buckets, so a few thousand rows at most."""
        out = np.zeros(size, np.int64)
        for r in df.groupBy(by).count().collect():
            out[r[by]] = r["count"]
        return out

    bucket, parts = buckets(forest, counts(homes.select(F.explode("leaves").alias("leaf")), "leaf", forest.leaves))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bucket, with the leaves of the bucket that the query visits."""
        for b in batches:
            leaves = b.column(2)
            flat = leaves.flatten().to_numpy()
            query, to = np.repeat(np.arange(b.num_rows), np.diff(leaves.offsets.to_numpy())), bucket[flat]
            by = np.lexsort((to, query))
            query, to, flat = query[by], to[by], flat[by]
            starts = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(to, prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int32()))
            whose = pa.array(query[starts])
            yield pa.RecordBatch.from_arrays([pa.array(to[starts], pa.int32()), b.column(0).take(whose), b.column(1).take(whose), lists], ["bucket", "x", "key", "leaves"])

    visits = walks.mapInArrow(sent, f"bucket int, x {kind}, key string, leaves array<int>")
    crowds = np.maximum(1, -(-counts(visits, "bucket", len(parts)) // CROWD))
    of_leaf = F.broadcast(spark.createDataFrame([(i, int(b), int(parts[b]), int(crowds[b])) for i, b in enumerate(bucket)], "leaf int, bucket int, parts int, crowds int"))
    of_bucket = F.broadcast(spark.createDataFrame([(b, int(p), int(c)) for b, (p, c) in enumerate(zip(parts, crowds, strict=True))], "bucket int, parts int, crowds int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = homes.select("x", "ids", F.explode("leaves").alias("leaf")).join(of_leaf, "leaf")
    left = left.select("bucket", F.pmod(F.xxhash64("ids"), "parts").cast("int").alias("part"), upto("crowds").alias("crowd"), "x", "ids", "leaf")
    right = visits.join(of_bucket, "bucket").select("bucket", F.pmod(F.xxhash64("key"), "crowds").cast("int").alias("crowd"), upto("parts").alias("part"), "x", "key", "leaves")

    def task(rows: pa.Table, queries: pa.Table) -> pa.Table:
        return _best(rows, queries, dimension, nearest + 1)

    group = ["bucket", "part", "crowd"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(task, "key string, vec_id long, score double")
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    found = materialize(found.withColumn("n", place("key")).where(F.col("n") <= nearest + 1).drop("n"))
    out = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(found, "key").where("query_id <> vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place("query_id"))
    return out.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
