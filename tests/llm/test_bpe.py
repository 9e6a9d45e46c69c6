import base64
import errno
import hashlib
import os
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "\x1c\x1d a\x85b　  c", "it's WE'LL 'x  \n\n  y", "日本語テスト 🎉🎉👩‍👩‍👧 é", "\x00﻿", "12345678901 ①²", "<|endoftext|><|im_end|>", "=" * 700, " " * 500 + "x", "\r\n\r\n\t", "a" * 300]
    blob = "".join(rng.choice("abcdefghijklmnoprstuABCé") for _ in range(600))
    letters = "".join(rng.choice(["schule", "erei", "ung", "ing", "tion", "x", "ß"]) for _ in range(150))
    prose = [" ".join("".join(rng.choice(["the", "on", "ß", "Über", "é", "tion", "9", "-"]) for _ in range(rng.randint(1, 4))) for _ in range(50)) for _ in range(20)]
    return odd + [blob, letters, "".join(chr(rng.randrange(32, 0x2000)) for _ in range(400)), *prose]


@pytest.mark.parametrize("hot", [0, 100, bpe.HOT])
def test_matches_tiktoken(spark, hot):
    enc, rows = reference(), list(enumerate(texts())) * 2
    df = spark.createDataFrame([(t, i, "x", "y") for i, t in rows], "text string, doc_id int, ids string, word string")
    got = bpe.encode_texts(df, hot=hot).collect()
    assert len(got) == len(rows)
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    for r in got:
        assert r["ids"] == ",".join(map(str, want[r["doc_id"]])), rows[r["doc_id"]]
        assert bytes(r["decoded"]) == (rows[r["doc_id"]][1] or "").encode()
    digests = {r["doc_id"]: r for r in bpe.token_digests(df, hot=hot).collect()}
    for i, ids in want.items():
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_latin_pattern():
    plain, latin = bpe.plain_pattern(public_tokenizers.PATTERN), bpe.latin_pattern(public_tokenizers.PATTERN)
    chars = [chr(i) for i in range(0x250) if i < 128 or chr(i).isalpha() and i >= 0xC0]
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choices(chars, k=60)) + " it's 12 a'll  \n x"
        assert bpe.regex.compile(plain).findall(t) == bpe.re.compile(latin).findall(t)
    assert bpe.latin_pattern(r"\p{Lu}+|\s+") is None


def test_very_long_word(spark):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnop") for _ in range(5000))
    df = spark.createDataFrame([(1, word)], "doc_id long, text string")
    assert bpe.encode_texts(df).first()["ids"] == ",".join(map(str, reference().encode_ordinary(word)))
    assert bpe.encode_texts(df.limit(0)).select(F.count("*")).first()[0] == 0


def test_frequent_words_are_bounded(spark):
    words = spark.createDataFrame([(f"w{i}", 1 + i % 40) for i in range(400)] + [("x" * 100, 999)], "word string, n long")
    for most in (0, 9, 10, 57, 1000):
        got = {r["word"] for r in bpe.frequent_words(words, most).collect()}
        assert len(got) <= most and "x" * 100 not in got
    assert bpe.frequent_words(words, 1000).count() == 400


def test_known_words_need_no_rename_of_folders(spark, tmp_path, monkeypatch):
    """Some file systems refuse it; and a folder that a lost worker left half-written is written again."""
    coded = pa.table({"word": [b"b", b"a"], "digest": pa.array([xxhash.xxh64_intdigest(w, 42) for w in (b"b", b"a")], pa.uint64()).cast(pa.int64(), safe=False), "ids": ["2", "1,1"]})
    name = f"{tmp_path.name}.parquet"
    pq.write_table(coded, tmp_path / name)
    spark.sparkContext.addFile(str(tmp_path / name))

    def refuse(*_):
        raise OSError(errno.EXDEV, "Invalid cross-device link")

    monkeypatch.setattr(os, "rename", refuse)
    folder = bpe._mapped([name])
    os.remove(f"{folder}/whole")
    os.remove(f"{folder}/ids.npy")
    assert bpe.KnownWords(bpe._mapped([name])).codes(["a", "c", "b"]) == ["1,1", None, "2"]


@pytest.mark.parametrize("together", [1, 40, bpe.TOGETHER])
def test_short_runs_are_decoded_together(monkeypatch, together):
    rng, tokens, calls, real = random.Random(6), [b"a", b"bc", b"\xc3", b"  d"], [], bpe.np.fromstring
    runs = [[rng.randrange(4) for _ in range(rng.choice([1, 2, 30]))] for _ in range(200)]
    monkeypatch.setattr(bpe, "TOGETHER", together)
    monkeypatch.setattr(bpe.np, "fromstring", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    got = list(bpe.Decoder(tokens).decode([",".join(map(str, r)) for r in runs]))
    assert got == [(len(r), b"".join(tokens[i] for i in r)) for r in runs]
    assert len(calls) == 1 if together > 1000 else len(calls) > 50
    assert list(bpe.Decoder(tokens).decode([])) == []
