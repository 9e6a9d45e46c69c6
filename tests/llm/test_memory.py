"""What Python workers are given at once, and what they keep when another operator's work begins."""

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bpe, jaccard, quality, shared

OPERATORS = {
    "quality": lambda docs: quality.score(docs, np.zeros(quality._STARTS[-1])),
    "shingle_sets": lambda docs: jaccard.shingle_sets(docs.withColumnRenamed("doc_id", "sid")),
    "prefixes": lambda docs: jaccard.prefixes(docs),
    "tokens": lambda docs: bpe.encode_texts(docs, hot=10),
}


@pytest.fixture
def sent(monkeypatch):
    """The frames that operators send to Python, with their functions."""
    calls, kind = [], "mapInArrow"

    def watch(docs):
        plain = getattr(type(docs), kind)

        def seen(self, run, *a, **b):
            calls.append((self, run))
            return plain(self, run, *a, **b)

        monkeypatch.setattr(type(docs), kind, seen)
        return calls

    return watch


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_are_bounded_by_bytes(spark, sent, name):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: F.concat(F.lit("w"), (F.col("id") % 7 * 1000 + i).cast("string"))))
    docs = spark.range(0, 1800, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    calls = sent(docs)
    OPERATORS[name](docs)
    frame = calls[-1][0]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    got = frame.mapInArrow(sizes, "bytes long, n long").agg(F.max("bytes"), F.sum("bytes"), F.sum("n")).first()
    assert got[0] <= shared.BATCH + 100_000 and got[1] > 4 * shared.BATCH and got[2] == 1800


@pytest.mark.parametrize("name", OPERATORS)
def test_workers_drop_what_others_kept(spark, sent, name):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    calls = sent(docs)
    OPERATORS[name](docs)
    store = vars(sys.modules.setdefault("_keyloom_kept", type(sys)("_keyloom_kept")))
    try:
        for kind in ("aligner", "bpe parts"):
            shared.kept((kind, "x"), dict)
        assert list(calls[-1][1](iter([]))) == []
        assert "aligner" not in store and ("bpe parts" in store) == (name == "tokens")
    finally:
        for kind in ("aligner", "bpe parts"):
            store.pop(kind, None)
