"""Cross-tokenizer alignment: where two tokenizers cut a text at the same byte, which of their tokens overlap, and how often over the corpus.

Texts are cut where neither tokenizer can make a token across: before a space that follows a character that isn't white space, if pattern and vocabularies allow. Each worker aligns every
distinct piece once: the ends of tokens are cumulative sums of their byte lengths, common cuts are ``intersect1d`` of both, ``searchsorted`` labels tokens with their group, and links are an
expansion by ``repeat`` of the range of tokens of B that each token of A overlaps. A document is the sequence of its pieces. How many documents hold a pair of ids linked is counted
in two shuffles, the first by pair and salt; pairs that are frequent enough to be at most HEAVY meet the documents by a broadcast, the others by an ordinary join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import kept, materialize, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a worker remembers, and their links; it forgets all of them when there are more.
PIECES, LINKS = 300_000, 4_000_000
#: Pairs of ids that are broadcast at most; salts of the first shuffle; documents aligned at a time.
HEAVY, SALTS, DOCS = 65_536, 16, 64
_SHIFT = 20
#: Fixed value: the pattern by which the byte-level pre-tokenizer of the first file's kind splits texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in any of the libraries.
_SPACE = r"\s" + "".join(map(chr, (0x180E, 0x200B, 0xFEFF)))
#: Blocks of characters whose classes are the same in all versions of Unicode that libraries come with, as first and last code point.
_COMMON = ((0x0, 0x52F), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_ENDS_IN_SPACE = re.compile(r"\s\Z").search
_RARE = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _COMMON) + "]")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 characters as themselves, and the other bytes as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and where each list ends."""
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]) if len(ends) else 0), ends


class ByteLevel:
    """Tokenizer A, from its JSON. Its ids come from the faster library of the same algorithm where that is sure to give the same ones."""

    def __init__(self, text: str):
        d = json.loads(text)
        self.own = Tokenizer.from_str(text)
        self.own.encode_special_tokens = True
        of, special = byte_of_character(), {t["content"] for t in d.get("added_tokens", [])}
        vocab = {t: i for t, i in d["model"]["vocab"].items() if t not in special}
        self.bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
        self.size = np.array([len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)], np.int64)
        pre = d.get("pre_tokenizer") or {}
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not d.get("normalizer")
        self.fast = None
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in d["model"]["merges"]]
        if self.splits and [vocab.get(t) for t in joined] == list(range(256, 256 + len(joined))) and len(vocab) == 256 + len(joined) and not d["model"].get("dropout"):
            self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts with a space before each, one after the other, and where each one's end. ``sizes`` in bytes, with that space. Texts that don't end in white space are encoded as one."""
        whole = " " + " ".join(texts)
        if self.fast and not _RARE.search(whole) and not any(map(_ENDS_IN_SPACE, texts)):
            ids = self.fast.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
            return ids, np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes), "right")
        spaced = [f" {t}" for t in texts]
        rare = [self.fast is None or _RARE.search(t) is not None for t in spaced]
        slow = iter(self.own.encode_batch([t for t, r in zip(spaced, rare, strict=True) if r], add_special_tokens=False))
        return _flat([next(slow).ids if r else self.fast.encode_ordinary(t) for t, r in zip(spaced, rare, strict=True)])


class Pieces:
    """Tokenizer B, from its serialized model."""

    def __init__(self, model: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = {i: bytes([int(p[1:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        self.splits = not any(re.search("[^▁]▁", p) for p in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.own.encode(texts, num_threads=1))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Tokens:
    """The bytes of a tokenizer's ids in one array, and the ids as text: followed by a comma, or by ``last`` behind a group's last one."""

    def __init__(self, of: dict[int, bytes], last: str):
        ids = range(max(of) + 1)
        self.flat = np.frombuffer(b"".join(of.get(i, b"") for i in ids), np.uint8)
        self.size = np.array([len(of.get(i, b"")) for i in ids], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.text = [f"{i}{c}" for i in ids for c in (",", last)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_runs(self.start[ids], self.size[ids])]


class Aligner:
    """Aligned pieces of texts: for each its numbers of tokens of A and B, groups and links, its groups as text, and the pairs of ids of its links."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.tokens_a, self.tokens_b = Tokens(a.bytes, "|"), Tokens(b.bytes, ";")
        self.text = self.tokens_a.text + self.tokens_b.text
        self.cut = re.compile(rf"(?<=[^{_SPACE}])(?= +[^ ])").split if a.splits and b.splits else None
        self.plain = re.compile(rf"^ |[{_SPACE}] | $").search
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.ends, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        """A text, cut before spaces, without these: a space belongs before each piece."""
        if self.cut is None or not text:
            return [text]
        if self.plain(text):
            return [p[1:] for p in self.cut(" " + text)]
        return text.split(" ")

    def _sound(self, raw: list[bytes], sizes: np.ndarray, ids: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which pieces both tokenizers give back byte by byte. ``of``: the piece of each token."""
        kinds = (self.tokens_a, self.tokens_b)
        sound = np.logical_and(*(np.bincount(o, t.size[i], len(raw)) == sizes for t, i, o in zip(kinds, ids, of, strict=True)))
        if not sound.all():
            raw = [r for r, g in zip(raw, sound, strict=True) if g]
        want, ends = np.frombuffer(b" " + b" ".join(raw) if raw else b"", np.uint8), np.cumsum(sizes[sound])
        same = sound.copy()
        for t, i, o in zip(kinds, ids, of, strict=True):
            wrong = np.flatnonzero(t.bytes_of(i[sound[o]]) != want)
            same[np.flatnonzero(sound)[np.searchsorted(ends, wrong, "right")]] = False
        return same

    def learn(self, texts: list[str]) -> None:
        """Aligns pieces. One whose bytes the tokens don't give back has no groups (None)."""
        n, raw = len(texts), [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, n) + 1
        (fa, ends_a), (fb, ends_b) = self.a.encode(texts, sizes), self.b.encode(texts)
        of_a, of_b = (np.repeat(np.arange(n), np.diff(e, prepend=0)) for e in (ends_a, ends_b))
        good = self._sound(raw, sizes, (fa, fb), (of_a, of_b))
        fa, of_a, fb, of_b = fa[good[of_a]], of_a[good[of_a]], fb[good[of_b]], of_b[good[of_b]]
        end_a, end_b = np.cumsum(self.tokens_a.size[fa]), np.cumsum(self.tokens_b.size[fb])
        start_a, start_b = end_a - self.tokens_a.size[fa], end_b - self.tokens_b.size[fb]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        first, behind = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a)
        links = behind - first
        pairs = np.repeat(fa << _SHIFT, links) | fb[_runs(first, links)]
        # the tokens in the order of the text: a group's tokens of A, then those of B
        last_a, last_b = (np.append(np.diff(g) != 0, True)[: len(g)] for g in (group_a, group_b))
        code = np.empty(len(fa) + len(fb), np.int64)
        code[np.arange(len(fa)) + np.searchsorted(group_b, group_a)] = 2 * fa + last_a
        code[np.arange(len(fb)) + np.searchsorted(group_a, group_b, "right")] = 2 * fb + last_b + len(self.tokens_a.text)
        written = list(map(self.text.__getitem__, code.tolist()))
        counts = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(of_a[last_a], minlength=n), np.bincount(of_a, links, n).astype(np.int64)], 1)
        ends = np.cumsum(counts[:, 0] + counts[:, 1])
        n0 = len(self.groups)
        self.place.update(zip(texts, range(n0, n0 + n), strict=True))
        self.groups += ["".join(written[i:j])[:-1] if g else None for i, j, g in zip([0, *ends[:-1].tolist()], ends.tolist(), good.tolist(), strict=True)]
        self.counts = np.concatenate((self.counts, counts))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts[:, 3])))
        self.pairs = np.concatenate((self.pairs, pairs))

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: n_a, n_b, n_groups, n_links; its groups as text; the different pairs of ids, and how many links each has."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.groups) > PIECES or len(self.pairs) > LINKS:
            self.forget()
        new = list(set().union(*cut) - self.place.keys())
        if new:
            self.learn(new)
        for ps in cut:
            at = np.fromiter(map(self.place.__getitem__, ps), np.int64, len(ps))
            groups = list(map(self.groups.__getitem__, at.tolist()))
            if not ps or None in groups:
                yield np.zeros(4, np.int64), "", at[:0], at[:0]
                continue
            pairs = self.pairs[_runs(self.ends[at], self.ends[at + 1] - self.ends[at])]
            yield self.counts[at].sum(0), ";".join(groups), *np.unique(pairs, return_counts=True)


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row (its number), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links.

    A is a byte-level BPE in the JSON file ``a``, B a sentence-piece model in the file ``b``; both encode a space and the text, without special tokens. ``groups`` is ``a1,a2|b1;a3|b2``;
    ``pairs`` are the different linked pairs, as id of A times 2^20 plus id of B, and ``links`` how many links each has. Null and empty texts, and those whose bytes one of the tokenizers doesn't give back,
    have no tokens: zeros, '' and empty lists. Repeated rows count as documents of their own, a null doc_id comes out null; other columns are left out.
    """
    with open(a or public_tokenizers.path(A), encoding="utf-8") as fa, open(b or public_tokenizers.path(B), "rb") as fb:
        files = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))  # a few MB: the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", a, b), lambda: Aligner(ByteLevel(files.value[0]), Pieces(files.value[1])))
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                counts, groups, pairs, links = zip(*aligner.align(part.column(1).to_pylist()), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (links, pa.int32()))]
                numbers = [pa.array(c) for c in np.stack(counts).T]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(groups), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<int>")
    return out.select(F.monotonically_increasing_id().alias("row"), "*")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): how many rows of ``found`` (written ones of ``aligned``) hold each pair, and whether that is the most of any pair with its id of A. Counted by pair and salt first."""
    pairs = found.select(F.explode("pairs").alias("pair"), (F.spark_partition_id() % SALTS).alias("salt"))
    counted = pairs.groupBy("pair", "salt").agg(F.count("*").alias("count")).groupBy("pair").agg(F.sum("count").alias("count"))
    counted = materialize(counted)
    token = F.shiftright("pair", _SHIFT)
    most = counted.groupBy(token.alias("a")).agg(F.max("count").alias("most"))  # a row for each id of A at most
    return counted.join(F.broadcast(most), token == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 ('' without tokens). See ``aligned`` for texts without tokens, nulls and repeated rows.

    A pair's count is the number of rows that hold it linked. ``count_sum`` adds it up over a row's links; ``n_best`` counts the links whose count no other pair with their id of A exceeds.
    """
    small = aligned(docs, a, b).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups")
    found = materialize(small)
    counts = materialize(pair_counts(found))
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = F.col("count") * HEAVY >= total  # at most HEAVY pairs can be that frequent
    hot = F.broadcast(counts.where(heavy))
    score = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    links = _exploded(found)
    scores = score(links.join(hot, "pair")).unionByName(score(links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~heavy), "pair")))
    scores = scores.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "links").join(scores, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents"))
