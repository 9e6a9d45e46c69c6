"""Alignment against a walk over byte offsets, pair by pair, with both libraries on whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keyloom.llm import align

A = Tokenizer.from_file(P.path(align.A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path(align.B))
BYTES = {c: bytes([b]) for c, b in align.byte_of_character().items()}

SF = "/root/testdata/sf0.01"


def _aligner() -> align.Aligner:
    with open(P.path(align.A), encoding="utf-8") as a, open(P.path(align.B), "rb") as b:
        return align.Aligner(align.ByteLevel(a.read()), align.Pieces(b.read()))


ALIGNER = _aligner()


def brute(text):
    """Groups as text and the linked pairs of one text, or None without tokens."""
    if not text:
        return None
    e = A.encode(" " + text, add_special_tokens=False)
    ia, ib = e.ids, B.encode(text)
    ba = [b"".join(BYTES[c] for c in A.id_to_token(i)) for i in ia]
    bb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return None
    spans = []
    for ids, parts in ((ia, ba), (ib, bb)):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            out.append((i, at, at + len(p)))
            at += len(p)
        spans.append(out)
    cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
    groups = [[[], []] for _ in cuts]
    for k in (0, 1):
        for i, _, end in spans[k]:
            groups[next(n for n, c in enumerate(cuts) if c >= end)][k].append(str(i))
    links = [(a, b) for a, a0, a1 in spans[0] for b, b0, b1 in spans[1] if a0 < b1 and b0 < a1]
    return len(ia), len(ib), len(cuts), ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in groups), links


def statistics(rows):
    found = [(i, brute(t)) for i, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[4]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, *f[:3], len(f[4]), sum(count[p] == most[p[0]] for p in f[4]), sum(count[p] for p in f[4]), hashlib.sha256(f[3].encode()).hexdigest()))
    return out


TEXTS = ["a", "the the cat", " two  spaces ", "tail  ", "\n new\n line\t x ", "don't <|endoftext|> <s> </s> <unk>", "café текст 漢字かな \U0001f600‍\U0001f525 ᠎ x", "▁ lower", "﻿bom ​ zero", "x" * 5000, "12 345,67 %", "  nbsp　 wide", " ", "\x00 null", "á ẛ̣ ﬁ"]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statistics_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "HEAVY", 20)  # so that some pairs are joined by a shuffle
    rows = [(i, t) for i, t in enumerate([*TEXTS, *TEXTS[:3], None, ""])] + [(3, "the cat"), (3, "the cat"), (None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": align.F.lit(1), "pairs": align.F.lit("x"), "n_a": align.F.lit(2)})
    assert _rows(align.alignment_statistics(docs)) == sorted(statistics(rows), key=str)


def test_empty_table(spark):
    assert align.alignment_statistics(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_a_share_of_the_table_by_brute_force(spark):
    docs = align.table(spark, SF, "documents").where("n_chars < 1500").limit(60).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert _rows(align.alignment_statistics(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(statistics(rows), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab's.▁　é漢"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_pieces_give_what_whole_texts_give(text):
    counts, groups, pairs, links = next(ALIGNER.align([text]))
    want = brute(text)
    if want is None:
        assert not counts.any() and groups == "" and not len(pairs)
    else:
        assert (*counts[:3].tolist(), groups) == want[:4]
        assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == Counter(a << 20 | b for a, b in want[4])


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} the cat" for i in range(50)]
    want = [(c.tolist(), g) for c, g, _, _ in ALIGNER.align(texts)]
    monkeypatch.setattr(align, "PIECES", 5)
    one = _aligner()
    assert [(c.tolist(), g) for t in texts for c, g, _, _ in one.align([t])] == want
