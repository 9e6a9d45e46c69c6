import numpy as np

from keyloom.llm import langid
from test_classifiers import TRAIN, brute_bits


def test_stray_bytes_cost_no_contexts(spark):
    """With over 125 distinct bytes a dense table of 8 million numbers had no room for any context of three."""
    stray = "".join(chr(c) for c in [*range(33, 127), *range(0x400, 0x460), *range(0x4E00, 0x9FFF, 97), *range(0x1F300, 0x1F6FF, 31)])
    train = {x: [*ts, stray] for x, ts in TRAIN.items()} | {"ru": ["это не кошка"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((x, t) for x, ts in train.items() for t in ts)]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.a > 125
    for text in ["under the hut", "Über den Hund", "zzz 99 été", "кошка \U0001f389 x", stray[::-1]]:
        got = trees.code_lengths([text, "x"])[0]
        assert np.allclose(got, [brute_bits(train[x], text) for x in trees.langs], rtol=1e-5)
