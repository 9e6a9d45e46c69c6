import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import exact, simhash
from keyloom.llm.shared import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 7) for i, t in rows], DOCS)


def brute_components(nodes, linked):
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            at[n] = at[at[n]]
            n = at[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                at[hi] = lo
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("counters", [4, 4096])
def test_exact_dedup(spark, counters):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "", None, "a", "b", f"t{i}", "x" * 200_000])) for i in range(400)]
    got = {r["doc_id"]: r for r in exact.exact_dedup(docs_of(spark, rows).repartition(5), counters).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == 400
    for i, t in rows:
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), i == max(g))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    assert exact.exact_dedup(docs_of(spark, [])).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "z"), (2, "b")]
    assert exact.exact_dedup(docs_of(spark, rows)).count() == 5
    left = exact.drop_exact_copies(docs_of(spark, rows))
    assert left.columns == docs_of(spark, rows).columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == [(-1, "z"), (1, "a"), (2, "b")]


def test_misra_gries_keeps_frequent():
    rng = random.Random(2)
    items = [rng.choice("abc") if rng.random() < 0.6 else rng.randrange(10**6) for _ in range(5000)]
    counts = {}
    exact.misra_gries(counts, items, 9)
    assert len(counts) <= 9
    for x in "abc":
        assert items.count(x) - 5000 / 10 <= counts[x] <= items.count(x)


def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint(spark):
    texts = ["", None, "One", "a b", "a b c", "A B C d é\u00a0x\x0bÉ", "the same the same the same the same", " \t\n", "w " * 70000]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs_of(spark, list(enumerate(texts)))).collect()}
    assert {i: v % 2**64 for i, v in got.items()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("small", [1, 4, 16])
def test_simhash_components(spark, small):
    rng = random.Random(small)
    fps = [0, -1]
    for _ in range(6):
        fps.append(rng.getrandbits(64) - 2**63)
    centre = rng.getrandbits(64)
    for _ in range(70):  # a crowd around one value, and chains away from it
        fps.append((centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12))) % 2**64 - 2**63)
    for _ in range(60):
        x = fps[rng.randrange(len(fps))] % 2**64
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.append((x + 2**63) % 2**64 - 2**63)
    fps += fps[:20]
    rng.shuffle(fps)
    rows = [(i * 3 + 1, f) for i, f in enumerate(fps)]
    want = brute_components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 if (fps[a] ^ fps[b]) >= 0 else ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2)
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(prints, small).collect()}
    assert got == {i * 3 + 1: c * 3 + 1 for i, c in want.items()}
    pairs = simhash.near_links(prints.select("fp").distinct(), small).collect()
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 2 for r in pairs)


def test_simhash_odd_rows(spark):
    assert simhash.simhash_dedup(docs_of(spark, [])).count() == 0
    rows = [(5, None), (4, ""), (7, "a b c"), (7, "a b c"), (9, "A b C"), (None, "q r s")]
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.simhash_dedup(docs_of(spark, rows)).collect())
    assert got == [(-1, None), (4, 4), (5, 4), (7, 7), (7, 7), (9, 7)]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 60), (60, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 60: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
