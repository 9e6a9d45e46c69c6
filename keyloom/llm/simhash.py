"""SimHash near-dedup: pigeonhole blocks of 64-bit fingerprints, verified by Hamming distance.

Two fingerprints that differ in at most two bits agree on at least two of four 16-bit blocks. Each distinct
fingerprint is therefore filed under its six pairs of blocks (32 bits each), and only fingerprints filed together are
compared. A small bucket compares its pairs. In a bucket of more than SMALL fingerprints the remaining 32 bits are split again in the same way
(six pairs of 8-bit blocks), and what is still crowded is linked through shared one-bit neighbours: two values within two
bits have a neighbour in common that is within one bit of both. So the work per fingerprint is bounded, and
no bucket emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, materialize, table, to_hex64

#: Words of a shingle, and the bits in which linked fingerprints may differ.
SHINGLE, MAX_BITS = 3, 2
#: The largest bucket whose pairs are compared directly.
SMALL = 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    hashes = np.fromiter((h(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _block_pairs(value: Column, width: int) -> Column:
    """The keys of a value of ``width`` bits: each pair of its four blocks, as (which pair, its bits)."""
    part = width // 4
    mask = (1 << part) - 1
    block = [F.shiftrightunsigned(value, part * i).bitwiseAND(F.lit(mask).cast("long")) for i in range(4)]
    pairs = [F.struct(F.lit(k).alias("which"), (F.shiftleft(block[i], part).bitwiseOR(block[j])).alias("bits"), *_rest(block, i, j, part)) for k, (i, j) in enumerate(combinations(range(4), 2))]
    return F.inline(F.array(*pairs))


def _rest(block: list[Column], i: int, j: int, part: int) -> list[Column]:
    """The bits outside of the pair (i, j)."""
    k, m = (x for x in range(4) if x not in (i, j))
    return [F.shiftleft(block[k], part).bitwiseOR(block[m]).alias("rest")]


def _least_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Links from every member of a group to its smallest member."""
    low = df.groupBy(*keys).agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return df.join(low, keys).where("fp <> b").select(F.col("fp").alias("a"), "b")


def _pairs(df: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    other = df.select(*keys, F.col("fp").alias("b"))
    return df.join(other, keys).where(F.col("fp") > F.col("b")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits).select(F.col("fp").alias("a"), "b")


def _crowds(df: DataFrame, keys: list[str], small: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with 2 to ``small`` members, and of larger ones."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    sized = materialize(df.join(n, keys))
    return sized.where(F.col("n") <= small).drop("n"), sized.where(F.col("n") > small).drop("n")


def near_links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) within two bits: with their transitive closure, all of them.

    In crowded buckets not each pair is listed, but every pair within two bits is joined by a chain of listed links, and
    every listed link is within two bits.
    """
    filed = fps.select("fp", _block_pairs(F.col("fp"), 64))
    few, many = _crowds(filed, ["which", "bits"], small)
    links = _pairs(few, ["which", "bits"], MAX_BITS)
    again = many.select("fp", "which", "bits", F.col("rest").alias("value"))
    again = again.select("fp", F.col("which").alias("w1"), F.col("bits").alias("b1"), _block_pairs(F.col("value"), 32))
    keys = ["w1", "b1", "which", "bits"]
    few, many = _crowds(again, keys, small)
    links = links.unionByName(_pairs(few, keys, MAX_BITS))
    flips = F.array(F.col("rest"), *(F.col("rest").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(16)))
    near = many.select("fp", *keys, F.explode(flips).alias("near"))
    return links.unionByName(_least_of(near, [*keys, "near"]))


def simhash_components(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, fp, component_id for every row of ``prints`` (doc_id, fp): fingerprints link at MAX_BITS or fewer differing bits."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(near_links(distinct.select("fp"), small))
    named = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (the smallest doc_id reachable by links, itself included).

    A null or wordless text has the fingerprint zero and links like any other. Null doc_ids are passed over when the smallest is taken; a
    group of nothing else has a null component_id. Repeated rows give repeated rows; an empty table gives none.
    """
    return simhash_components(materialize(fingerprints(docs, shingle)), small)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", to_hex64(F.col("fp")).alias("fingerprint"), "component_id")
