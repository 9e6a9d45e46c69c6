"""The whole pipeline against its stages one after the other, each by brute force or by an operator that is tested so."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from keyloom.llm import mixing, quality
from test_bpe import reference
from test_dedup import brute_components, docs_of
from test_jaccard import planted, similar


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    rng = random.Random(2)
    good = [w for i, t in planted() if t for w in t.split()]
    rows = planted() + [(1000 + i, " ".join(f"{chr(33 + rng.randrange(14))}{rng.randrange(9)}" for _ in range(40))) for i in range(40)]
    rows += [(2000 + i, t) for i, t in rows[:30]]
    rows += [(3000 + i, " ".join(rng.choice(good) for _ in range(60))) for i in range(40)]
    sources = {i: ("hot", "b", None)[min(rng.randrange(5), 2)] for i, _ in rows}
    docs = docs_of(spark, rows).drop("source").join(spark.createDataFrame(list(sources.items()), "doc_id long, source string"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not 1000 <= i < 1040), 0) for i, _ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    docs, text = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(rows)
    kept = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("kept").collect()}
    assert not kept & set(range(1000, 1040)) and len(kept) > 0.9 * (len(rows) - 40)
    last = {text[i] or "": i for i in sorted(kept)}
    unique = sorted(last.values())
    of = brute_components(unique, lambda a, b: similar(text[a], text[b]))
    left = sorted({of[i] for i in unique})
    assert 0 < len(left) < len(unique) < len(kept) < len(rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.where(docs.doc_id.isin(left))).collect()}
    assert max(copies.values()) > 1
    tiktoken, want = reference(), Counter()
    for i in left:
        t = text[i] or ""
        ids = tiktoken.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    assert got == +want
