import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import langid, quality

DATA = "/root/testdata/sf0.01"


def brute_bits(train, text, order=3):
    """Code length of text by PPM, method C, frozen, no exclusions; contexts of up to three bytes."""
    alphabet = 256
    counts = {}
    for t in train:
        b = langid._PAD + t.lower().encode()
        for i in range(3, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1
    b, bits = langid._PAD + text.lower().encode(), 0.0
    for i in range(3, len(b)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += math.log2(alphabet)
                break
            c = counts.get(b[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                bits += math.log2((n + d) / c[b[i]])
                break
            bits += math.log2((n + d) / d)
    return bits


TRAIN = {"en": ["the cat and the hat", "then there was thunder"], "de": ["der hund und das Öhr", "schule über alles", "und"], "fr": ["le chat été"]}


def test_code_lengths(spark):
    rows = [(i, t, lang, "clash", 1.5) for i, (lang, t) in enumerate((x, t) for x, ts in TRAIN.items() for t in ts)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double"))
    assert trees.langs == ["de", "en", "fr"]
    for text in ["the", "Über den Hund", "zzz 99 été", "\U0001f389 x" * 20, "a" * 3000]:
        got = trees.code_lengths([text, "x"])[0]
        assert np.allclose(got, [brute_bits(TRAIN[x], text) for x in trees.langs], rtol=1e-5)


def test_cut_trees_are_smaller_and_still_right(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in TRAIN.items() for t in ts)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_cells=0)
    assert trees.bits.shape[0] == trees.a**3
    assert np.allclose(trees.code_lengths(["under the hut"])[0], [brute_bits(TRAIN[x], "under the hut", 2) for x in trees.langs], rtol=1e-5)


def test_identify_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 ²① _!"), (4, "und der"), (4, "und der"), (None, "the"), (6, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = langid.learn(spark.createDataFrame([(i, t, x) for i, (x, ts) in enumerate(TRAIN.items()) for t in ts] + [(9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string"))
    got = langid.identify(docs, trees).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[i] for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "de", "en"]
    assert langid.identify(docs.limit(0), trees).count() == 0
    nothing = langid.learn(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = langid.op10_language(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def brute_ngrams(text):
    """Buckets of the words of one text, word for word."""
    kinds, b = quality._byte_kinds(), (text or "").encode()
    mask, out, shapes, prev = (1 << 64) - 1, [], [], None

    def bucket(h, k):
        return ((((h ^ (h >> 29)) * quality._MIX) & mask) >> (64 - quality.BITS[k])) + quality._STARTS[k]

    for w in b.split():
        h = sum((c + 1) * pow(quality._BASE, j, 1 << 64) for j, c in enumerate(w)) & mask
        bits = 0
        for c in w:
            bits |= int(kinds[c])
        tail = w[-1] if kinds[w[-1]] & 48 else 0
        s = ((((bits << 8 | tail) << 8 | int(kinds[w[0]])) << 2 | min(len(w), 12) // 4) << 1 | (w == prev)) + 1
        shapes.append(s)
        prev = w
        s1 = shapes[-2] if len(shapes) > 1 else 0
        s2 = shapes[-3] if len(shapes) > 2 else 0
        two = (s * quality._BASE + s1) & mask
        out.append([bucket(h, 0), bucket(s, 1), bucket(two, 2), bucket((two * quality._BASE + s2) & mask, 3)])
    return out


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_ngrams(most):
    rng = random.Random(5)
    texts = [None, "", " ", "One", "a a A a!!", "x\ny | z", "été É"] + [" ".join(rng.choice(["the", "THE!!", "a***", "9,", "|", "é", ""]) for _ in range(30)) for _ in range(9)]
    seen = 0
    for at, end, data, ends in quality.pieces(pa.array(texts), most):
        buckets, doc = quality.ngrams(data, ends)
        for i in range(at, end):
            assert buckets[doc == i - at].tolist() == brute_ngrams(texts[i])
        seen = end
    assert seen == len(texts)


def test_sliced_arrays():
    got = list(quality.pieces(pa.array(["aa", "bb", None, "cc"])[1:]))
    assert [(a, e, bytes(d), n.tolist()) for a, e, d, n in got] == [(0, 3, b"bbcc", [2, 2, 4])]


def test_kth_largest(spark):
    rng = random.Random(6)
    v = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 100 + [-1e9, 1e9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 2, 200, 260, 400, 601):
        assert quality.kth_largest(df, k, bins=8) == sorted(v, reverse=True)[k - 1]
    assert quality.kth_largest(df, 602) == -np.inf and quality.kth_largest(df, 0) == np.inf


def test_best_cut():
    s, g = np.array([0.0, 1, 1, 2, 3]), np.array([False, False, True, True, True])
    assert quality.best_cut(s, g) == 1.5
    assert quality.best_cut(s, np.ones(5, bool)) == -np.inf
    assert quality.best_cut(np.zeros(4), np.array([True, False, True, False])) == -np.inf


def test_quality_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    rest = quality.classify(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rest) / len(rest) > 0.97
    left = quality.drop_low_quality(docs, half)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in quality.classify(docs, half).where("kept").collect()}
    assert {r["doc_id"] for r in left.collect()} == kept


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "a b", 0.5), (4, "w " * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (9, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(r["kept"] for r in got)
    assert quality.classify(docs, labels.limit(0)).where("kept").count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.drop_low_quality(docs, labels).columns == docs.columns


def test_classify_is_the_top_k_of_log_weight_plus_gumbel_noise(spark):
    rng = random.Random(9)
    good, bad = [f"g{i} word" for i in range(40)], [f"B{i}#!" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.choice([1, 2, 3, 30])))) for i in range(120)] + [(500, None)] * 2 + [(501, rng.choice(good))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    at = {i: quality.ngrams(np.frombuffer((t or "").encode(), np.uint8), np.array([len((t or "").encode())]))[0] for i, t in rows}
    raw, target = (np.zeros(quality._STARTS[-1]) for _ in range(2))
    for i, _ in rows:
        np.add.at(raw, at[i].ravel(), 1)
        if i < 60 and i % 2:
            np.add.at(target, at[i].ravel(), 1)
    ratio = np.zeros(len(raw))
    for i, j in zip(quality._STARTS, quality._STARTS[1:], strict=False):
        p, q = target[i:j] + quality.SMOOTHING, raw[i:j] + quality.SMOOTHING
        ratio[i:j] = np.log(p / p.sum()) - np.log(q / q.sum())
    weight = {i: ratio[b].sum() / len(quality.BITS) for i, b in at.items()}
    mean = {i: weight[i] / len(b) if len(b) else 0.0 for i, b in at.items()}
    cut = quality.best_cut(np.array([mean[i] for i in range(60)]), np.array([i % 2 == 1 for i in range(60)]))
    hashes = {r[0]: r[1] % (1 << 64) >> 11 for r in docs.select("doc_id", F.xxhash64(F.lit("gumbel"), F.col("doc_id"))).distinct().collect()}
    key = {i: weight[i] - cut * len(at[i]) - np.log(-np.log((hashes[i] + 0.5) / (1 << 53))) for i in at}
    for k in (None, 17):
        n = sum(mean[i] >= cut for i, _ in rows) if k is None else k
        least = sorted((key[i] for i, _ in rows), reverse=True)[n - 1]
        got = quality.classify(docs, labels, k=k).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"] for r in got if r["kept"]} == {i for i in key if key[i] >= least - 1e-9}
        assert all(abs(r["key"] - key[r["doc_id"]]) < 1e-6 for r in got)
