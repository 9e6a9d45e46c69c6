"""Reading tables, cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the batches in which texts go to Python workers, but for what the last text of a batch has beyond that.
BATCH = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only for local sessions that have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keyloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives; a Python worker keeps it for its next tasks, one value for each first part of ``key``."""
    store = vars(sys.modules.setdefault("_keyloom_kept", types.ModuleType("_keyloom_kept")))
    kind = str(key[0])
    if kind not in store or store[kind][0] != key:
        store[kind] = (key, make())
    return store[kind][1]


def release(keeps: tuple[str, ...] = ()) -> None:
    """Drops what this process has kept, but for the kinds in ``keeps``."""
    store = vars(sys.modules.get("_keyloom_kept", types.ModuleType("")))
    others = [k for k in store if not k.startswith("__") and k not in keeps]
    for k in others:
        del store[k]
    if others:
        pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: tuple[str, ...] = ()) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory: batches have about BATCH bytes, however long texts are, and a worker first drops what it has kept for other operators.

    By default a batch has up to 10,000 rows, and an executor holds each several times: in Arrow's buffers of both directions and in Python. The session's setting is lowered, as plans read it when they run.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH):
        conf.set(name, str(BATCH))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from run(batches)

    return df.mapInArrow(own, schema)


def to_hex64(c: Column) -> Column:
    """A signed long as 16 lower-case hex digits of its bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: every round replaces a link by one to a smaller node,
    so the number of links never grows, and a hub's links are spread over its neighbours. Each
    round is written to the shared folder. Loops are ignored, and repeated links are harmless.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
