"""Near-dedup by exact Jaccard similarity of word shingles: prefix filter, then the shares of common shingles.

Order the shingles of all texts in one way. Two sets with a similarity of at least 4/5 share a shingle among the first n - ceil(4n/5) + 1 of
each one's n, so that only texts that meet there are compared, and no pair is missed. The order puts common shingles last, so that common passages bring
no texts together. It rests on a sample, but as any order will do, nothing is lost by that. Pairs leave where the places of the shingle or the parity sketches
(bits that differ are no more than shingles that do) show that they can't be similar. Of texts that meet at a shingle each is first
compared with one of them. What this joins into one component needs no more comparing; the other pairs are then compared one by one.

Before all that SimHash links sets by its pigeonhole blocks and the Hamming distance of their fingerprints, each link checked by the similarity itself. Sets of a similarity of 4/5 differ in more bits
than blocks allow for, so that it finds a part of the pairs only. MinHash finds most of the others, some for each text, so that large groups of similar texts come to be one component
before their pairs would be listed. The prefix filter adds those that both have missed, between texts that aren't joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, map_texts, materialize
from .simhash import _LOWER, near_links

#: Words of a shingle. Linked texts have 4/5 or more of their shingles in common.
SHINGLE = 5
#: The order of shingles rests on this share of the texts, on about SAMPLE at most, and lists so many common shingles at most.
SHARE, SAMPLE, LISTED = 1 / 8, 200_000, 1 << 18
#: Longs of a parity sketch.
LONGS = 16
#: Tables of two MinHashes each.
TABLES = 6
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) | 1 for i in range(2 * TABLES)], np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's shingles, sorted. A shorter text is one shingle, a wordless one the empty shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def _common(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of times each hash is listed with, 0 if it isn't."""
    listed, n = common
    if not len(listed):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return np.where(listed[at] == hashes, n[at], 0)


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in three or more of a sample of texts, LISTED of them at most, sorted, and in how many they do."""
    share = min(SHARE, SAMPLE / max(docs.count(), 1))
    sample = docs.where(F.shiftrightunsigned(row_key(), 11) < F.lit(int(share * (1 << 53))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), shingle).view(np.int64))], ["h"])

    counts = materialize(map_texts(sample.select(F.col("text").cast("string")), run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3"))
    sizes = counts.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*").alias("m")).collect()
    least, room = 1 << 62, LISTED
    for r in sorted(sizes, key=lambda r: -r["n"]):
        room -= r["m"]
        if room < 0:
            break
        least = r["n"]
    rows = counts.where(F.col("n") >= least).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text).cast("string"))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bits of LONGS longs; each tells whether an odd number of hashes falls on it."""
    odd = np.bincount((hashes % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: a bit is set if it is set in over half of them."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set of hashes in each of 2 * TABLES orders of all longs."""
    return np.array([(hashes * odd).min() for odd in _ODD]).view("<i8")


def prefixes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rk, sid, n, bits, keys, fp, mins) of every row of ``docs``: its row key, its set of shingles as a digest, the set's size, parities, first shingles, SimHash and MinHashes."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for b in batches:
            sids, sizes, bits, keys, fps, mins = [], [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), shingle)
                sids.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                sizes.append(len(s))
                bits.append(parities(s))
                fps.append(set_fingerprint(s))
                mins.append(minhashes(s))
                order = np.argsort(_common(s, common), kind="stable")  # of equally common ones the smaller hash first
                keys.append(s[order[: len(s) - (4 * len(s) + 4) // 5 + 1]].view(np.int64))
            cols = [b.column(0), b.column(1), pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32)), lists(bits), lists(keys), pa.array(np.concatenate([np.zeros(0, np.int64), *fps])), lists(mins)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "sid", "n", "bits", "keys", "fp", "mins"])

    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("rk"), F.col("text").cast("string"))
    return map_texts(texts, run, "doc_id long, rk long, sid long, n int, bits array<long>, keys array<long>, fp long, mins array<long>")


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(sid, set) of every row of ``texts`` (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1)):
                s = pa.array(shingles(t.as_py(), shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), s)], ["sid", "set"])

    return map_texts(texts.select("sid", "text"), run, "sid long, set array<long>")


def _may_be_similar(n: str, pos: str, other_n: str, other_pos: str) -> Column:
    """Whether texts that first meet at these places of their orders have enough shingles from there on."""
    return F.least(F.col(n) - F.col(pos), F.col(other_n) - F.col(other_pos)) * 9 >= (F.col(n) + F.col(other_n)) * 4


def _differing(a: str, b: str) -> Column:
    """In how many parities two sketches differ: no more than their sets do."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(LONGS)), F.lit(0))


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of sids that have 4/5 or more of their shingles in common; those whose parities differ too much aren't looked up."""
    of = rows.groupBy("sid").agg(F.first("bits").alias("bits"), F.first("n").alias("n"), F.min("rk").alias("rk"))

    def side(x: str) -> DataFrame:
        return of.select(F.col("sid").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}"))

    left = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(_differing("bits_a", "bits_b") * 9 <= F.col("n_a") + F.col("n_b")).select("a", "b"))
    wanted = left.select(F.col("a").alias("sid")).union(left.select("b")).distinct().join(of, "sid").select("sid", "rk")
    texts = docs.select(row_key().alias("rk"), F.col("text").cast("string").alias("text")).join(wanted, "rk")
    sets = materialize(shingle_sets(texts, shingle))
    both = F.size(F.array_intersect("sa", "sb"))
    found = left.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("sb")), "b")
    return materialize(found.where(both * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b"))


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sids, a > b, that SimHash links: each set with the least one of its fingerprint, and these ones where fingerprints are within the bits that link."""
    least = rows.select("sid", "fp").distinct().groupBy("fp").agg(F.min("sid").alias("least"))
    least = materialize(least)
    same = rows.select("sid", "fp").distinct().join(least, "fp").where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    near = near_links(least.select("fp"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"sid_{c}"))
    linked = near.join(of("a"), "a").join(of("b"), "b").select(F.greatest("sid_a", "sid_b").alias("a"), F.least("sid_a", "sid_b").alias("b"))
    return materialize(same.unionByName(linked).distinct())


def minhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sids, a > b, that agree in both MinHashes of a table: each set with the least one of its bucket, and with the next one in the order of another MinHash, so that there are no more than two a set and table."""
    at = [F.struct(F.lit(i).alias("i"), *(F.col("mins")[(2 * i + k) % (2 * TABLES)].alias(f"m{k}") for k in range(4))) for i in range(TABLES)]
    bucket = Window.partitionBy("i", "m0", "m1")
    filed = rows.select("sid", F.col("mins")).distinct().select("sid", F.inline(F.array(*at)))
    seen = filed.withColumns({"least": F.min("sid").over(bucket), "next": F.lead("sid").over(bucket.orderBy("m2", "m3", "sid"))})
    pairs = seen.select("sid", F.explode(F.array("least", "next")).alias("other")).where("sid <> other")  # a null is none
    return materialize(pairs.select(F.greatest("sid", "other").alias("a"), F.least("sid", "other").alias("b")).distinct())


def listed_pairs(apart: DataFrame) -> DataFrame:
    """(a, b), once for each key where they meet: the pairs of ``apart`` (key, sid, n, pos, c, bits) of different components c that places and parities allow to be similar."""
    other = apart.select("key", F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("bpos"), F.col("c").alias("bc"), F.col("bits").alias("bbits"))
    close = _differing("bits", "bbits") * 9 <= F.col("n") + F.col("bn")
    pairs = apart.join(other, (apart["key"] == other["key"]) & (F.col("sid") > F.col("b")) & (F.col("c") != F.col("bc")) & _may_be_similar("n", "pos", "bn", "bpos") & close)
    return pairs.select(F.col("sid").alias("a"), "b")


def similar_links(rows: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the sids of ``rows`` (prefixes of ``docs``), which join all pairs of similar sets, directly or by a chain."""
    each = Window.partitionBy("key")
    filed = rows.select("sid", "n", F.posexplode("keys").alias("pos", "key"))
    met = filed.withColumns({"low": F.min(F.struct("sid", "n", "pos")).over(each), "high": F.max("sid").over(each)}).where("low.sid <> high")
    met = materialize(met.select("key", "sid", "n", "pos", F.col("low.sid").alias("low"), F.col("low.n").alias("low_n"), F.col("low.pos").alias("low_pos")).distinct())
    near = confirmed(simhash_pairs(rows).unionByName(minhash_pairs(rows)).distinct(), rows, docs, shingle)
    known = connected_components(near).select("node", "component")
    first = met.where("sid <> low").where(_may_be_similar("n", "pos", "low_n", "low_pos")).select(F.col("sid").alias("a"), F.col("low").alias("b")).distinct()
    # texts that SimHash and MinHash have joined need no more comparing
    first = first.join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
    first = materialize(first)
    links = near.unionByName(confirmed(first, rows, docs, shingle))
    of = connected_components(links).select(F.col("node").alias("sid"), "component")
    named = met.where("sid <> low").select("key", "sid", "n", "pos").join(of, "sid", "left").withColumn("c", F.coalesce("component", "sid"))
    apart = named.withColumns({"c0": F.min("c").over(each), "c1": F.max("c").over(each)}).where("c0 <> c1")
    # the sketches go along, so that only pairs whose parities are close enough come out of the join
    sketch = rows.groupBy("sid").agg(F.first("bits").alias("bits"))
    apart = materialize(apart.select("key", "sid", "n", "pos", "c").join(sketch, "sid"))
    rest = materialize(listed_pairs(apart).distinct().join(first, ["a", "b"], "left_anti"))
    return links.unionByName(confirmed(rest, rows, docs, shingle))


def similar_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rk, component_id) of every row of ``docs`` (doc_id, text): component_id is the smallest doc_id reachable by links, itself included.

    Texts with equal sets of shingles are linked like others, wordless ones among them. Null doc_ids are passed over when the smallest
    is taken; a group of nothing else has a null component_id. Repeated rows give repeated rows; an empty table gives none.
    """
    rows = materialize(prefixes(docs, shingle))
    comps = connected_components(similar_links(rows, docs, shingle)).withColumnRenamed("node", "sid")
    named = materialize(rows.select("doc_id", "rk", "sid").join(comps, "sid", "left").select("doc_id", "rk", F.coalesce("component", "sid").alias("component")))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "rk", "component_id")


def drop_similar(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. Rows with a null doc_id stay."""
    gone = similar_components(docs, shingle).where("doc_id <> component_id").select("rk").distinct()
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), row_key().alias("rk"))  # no name of theirs can clash with ours
    return named.join(gone, "rk", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
