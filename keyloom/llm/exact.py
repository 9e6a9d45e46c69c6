"""Exact dedup: frequent digests by Misra-Gries leave by a broadcast, the other digests by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

#: Counters of a Misra-Gries summary. No digest with over 2/COUNTERS of all rows stays for the shuffle.
COUNTERS = 4096


def misra_gries(counts: dict, items, counters: int) -> None:
    """Add items to the summary ``counts``, which keeps at most ``counters`` of them.

    An item that occurs over (items seen) / (counters + 1) times is always kept, with a count short by that much at most.
    """
    for x in items:
        if x in counts:
            counts[x] += 1
        elif len(counts) < counters:
            counts[x] = 1
        else:
            for k in [k for k in counts if counts[k] == 1]:
                del counts[k]
            for k in counts:
                counts[k] -= 1


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n, keep_id) of each digest with over 2 / counters of all rows of (doc_id, digest), and with two at least; of no more than ``counters`` digests.

    Every partition gives its Misra-Gries summary; the sums of these lower bounds miss no such digest. The
    candidates are then counted exactly.
    """
    spark = digests.sparkSession

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            misra_gries(counts, b.column(0).to_pylist(), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    total = digests.count()
    low = digests.select("digest").mapInArrow(summary, "digest binary, low long")
    least = max(1.0, 2 * total / counters)
    # a digest with over `least` rows lost at most total / (counters + 1) of them; fewer than `counters` digests sum to that
    found = low.groupBy("digest").agg(F.sum("low").alias("low")).where(F.col("low") > least - total / (counters + 1)).select("digest")
    exact = digests.join(F.broadcast(materialize(found)), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    return materialize(exact.where(F.col("n") > least))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group, of which the row with the largest doc_id stays. A null text counts as empty. Of rows that
    repeat a doc_id and its text, one stays marked as kept. A null doc_id ranks below all
    others. Texts never move: only their SHA-256 does. An empty table gives no rows.
    """
    digests = materialize(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")))
    heavy = frequent_digests(digests, counters)
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    rest = marked.where("n is null").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    light = rest.join(groups, "digest")
    out = marked.where("n is not null").select("doc_id", "digest", "keep_id", "n").unionByName(light.select("doc_id", "digest", "keep_id", "n"))
    return out.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; of rows that repeat a doc_id and its text, one stays."""
    names = docs.columns  # columns are renamed meanwhile, so that none clashes

    def key(digest):
        return F.concat(digest, F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("row_key")

    stays = exact_dedup(docs, counters).where("kept").select(key(F.col("text_sha256")))
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), key(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return keyed.join(stays, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
