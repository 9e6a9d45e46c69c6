import random

import corpus_pipeline
from pyspark.sql import functions as F

from keyloom.llm import jaccard
from test_dedup import brute_components, docs_of


def brute_set(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def similar(a, b):
    a, b = brute_set(a), brute_set(b)
    return len(a & b) / len(a | b) >= 0.8


def planted():
    """Texts with edited copies of similarity 0.6 to 1, chains of them, common passages and a large group."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(40)]
    texts = [[word() for _ in range(rng.choice([8, 30, 60, 200]))] for _ in range(50)]
    texts += [common + [word() for _ in range(20)] for _ in range(25)] + [texts[0]] * 20
    for _ in range(90):
        t = list(texts[rng.randrange(len(texts))])
        for _ in range(rng.choice([1, 1, 2, max(1, len(t) // 60), max(1, len(t) // 40)])):
            t[rng.randrange(len(t))] = word()
        texts.append(t if rng.random() < 0.7 else t[: -max(1, len(t) // 12)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, " \n"), (902, None), (903, "one"), (904, "One"), (905, "one two")]
    rng.shuffle(rows)
    return rows


def test_similar_components(spark):
    rows = planted()
    text = dict(rows)
    want = brute_components(sorted(text), lambda a, b: similar(text[a], text[b]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs_of(spark, rows).repartition(3)).collect()}
    assert got == want
    shares = [len(a & b) / len(a | b) for i, x in rows for j, y in rows if i < j for a, b in [(brute_set(x), brute_set(y))]]
    assert sum(0.8 <= s <= 0.95 for s in shares) > 20 and sum(0.6 <= s < 0.8 for s in shares) > 20
    assert any(i not in (want[i],) and not similar(text[i], text[want[i]]) for i in text)  # joined by a chain


def test_stage_drops_edited_copies(spark):
    rows = planted()
    text = dict(rows)
    want = brute_components(sorted(text), lambda a, b: similar(text[a], text[b]))
    docs = docs_of(spark, rows)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_similar_odd_rows(spark):
    assert jaccard.similar_components(docs_of(spark, [])).count() == 0
    rows = [(7, "a b c"), (7, "a b c"), (9, "A b C"), (9, "other text under a known id"), (None, "q r s"), (None, "a b c")]
    left = jaccard.drop_similar(docs_of(spark, rows))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == [(-1, "a b c"), (-1, "q r s"), (7, "a b c"), (7, "a b c"), (9, "other text under a known id")]


def test_columns_of_the_input_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 7), (2, "a b c d e f", "y", 8)], "doc_id long, text string, _rk string, rk int")
    left = jaccard.drop_similar(df)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(1, "a b c d e f", "x", 7)]


def test_simhash_links_near_texts_and_each_link_is_checked(spark):
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:399] + ["other"])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, " ".join(reversed(words)))], "doc_id long, text string")
    rows = jaccard.prefixes(docs).localCheckpoint()
    sid = {r["doc_id"]: r["sid"] for r in rows.collect()}
    close = {r["doc_id"]: r["fp"] for r in rows.collect()}
    assert bin((close[1] ^ close[2]) & (2**64 - 1)).count("1") <= 2
    pairs = {tuple(r) for r in jaccard.simhash_pairs(rows).collect()}
    assert pairs == {(max(sid[1], sid[2]), min(sid[1], sid[2]))}
    one = rows.withColumn("fp", F.lit(0).cast("long"))  # fingerprints that agree by chance link nothing
    assert jaccard.confirmed(jaccard.simhash_pairs(one), one, docs).count() == 1
    assert {frozenset(r) for r in jaccard.similar_links(one, docs).select("a", "b").collect()} == {frozenset((sid[1], sid[2]))}


def test_few_pairs_of_a_group_of_edited_copies_are_listed(spark, monkeypatch):
    """Copies that the least set of their shingles doesn't join are joined by others before their pairs would be listed."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    seen, real = [], jaccard.confirmed

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "confirmed", counting)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(docs_of(spark, rows)).collect()}
    text = dict(rows)
    assert got == brute_components(sorted(text), lambda a, b: similar(text[a], text[b]))
    assert seen[-1] < 160, seen
