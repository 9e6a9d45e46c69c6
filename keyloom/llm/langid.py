"""Language ID by prediction by partial matching: the language whose byte context tree codes a text in the fewest bits.

Each language has a tree of contexts of up to three bytes with the counts of the next byte. A byte that its context hasn't seen costs an
escape (method C: as likely as the context's distinct bytes are many) and is coded in the next shorter context, at last as one of 256.
Statistics are frozen after training, so that the cost of every (context, byte) is worked out once, and a text's code length is a sum
of table entries. All languages are scored at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: About so many documents of each language are learned from at most, picked by a hash of doc_id; whole texts.
TRAIN_DOCS = 2000
UNKNOWN = "und"

_PAD = b"\n\n\n"
_PIECE = 1 << 20


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts' bytes, each after the padding, and where each begins and ends."""
    coded = [t.lower().encode() for t in texts]
    data = np.frombuffer(_PAD + _PAD.join(coded), np.uint8)
    ends = np.cumsum([len(c) + len(_PAD) for c in coded])
    return data, ends - [len(c) for c in coded], ends


def _runs(texts: list[str | None], wanted: list[int]) -> Iterator[list[int]]:
    run, size = [], 0
    for i in wanted:
        run.append(i)
        size += len(texts[i])
        if size >= _PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_grams(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """For each lang in ``docs`` (doc_id, text, lang): its four-byte sequences (as numbers) and their counts."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shares = docs.groupBy("lang").agg((F.lit(float(train_docs)) / F.count("*")).alias("share"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("train"), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    sample = docs.join(F.broadcast(shares), "lang").where(u < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for part in _runs(texts, [i for i, x in enumerate(langs) if x == lang and texts[i]]):
                    data, starts, ends = _laid_out([texts[i] for i in part])
                    d = data.astype(np.int64)
                    grams = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
                    real = np.zeros(len(data), bool)
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        real[s:e] = True
                    g, n = np.unique(grams[real[3:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    rows = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, gram, n = np.array(rows["lang"].to_pylist(), object), rows["gram"].to_numpy(), rows["n"].to_numpy()
    return [(x, gram[langs == x], n[langs == x]) for x in sorted(set(langs))]


class ContextTrees:
    """The languages' trees as a dense table: ``row`` gives a context's place, ``bits`` the cost of each next byte in each language.

    Contexts of three bytes beyond ``max_cells`` numbers, the rarest, are cut. Only for callers that ask for such a limit.
    """

    def __init__(self, grams: list[tuple[str, np.ndarray, np.ndarray]], max_cells: int):
        self.langs = [x for x, _, _ in grams]
        used = np.unique(np.concatenate([np.array([_PAD[0]]), *(g >> s & 255 for _, g, _ in grams for s in (0, 8, 16, 24))]))
        self.code = np.full(256, len(used), np.int64)  # bytes never seen share one symbol
        self.code[used] = np.arange(len(used))
        a, n_langs = len(used) + 1, max(len(grams), 1)
        self.a = a
        coded = []
        for _, g, n in grams:
            c = [self.code[g >> s & 255] for s in (24, 16, 8, 0)]
            coded.append((c, n.astype(np.float64)))
        # order 0 to 2 contexts are dense; those of order 3 are listed, the most frequent first
        total = np.zeros(a**3)
        for c, n in coded:
            np.add.at(total, (c[0] * a + c[1]) * a + c[2], n)
        listed = np.flatnonzero(total)
        room = max(0, max_cells // (a * n_langs) - a * a)
        kept = np.sort(listed[np.argsort(-total[listed], kind="stable")][:room])
        context = np.arange(a**3)
        self.row = (context % (a * a)).astype(np.int32)
        self.row[kept] = a * a + np.arange(len(kept))
        self.bits = np.zeros(((a * a + len(kept)) * a, n_langs), np.float32)
        for k, (c, n) in enumerate(coded):
            below = np.full((1, a), 8.0)
            for order in range(3):
                ctx = np.zeros(len(n), np.int64)
                for j in range(order, 0, -1):
                    ctx = ctx * a + c[3 - j]
                counts = np.bincount(ctx * a + c[3], n, a**order * a).reshape(-1, a)
                below = self._costs(counts, below[np.arange(a**order) % len(below)])
            ctx = self.row[(c[0] * a + c[1]) * a + c[2]]
            deep = ctx >= a * a
            counts = np.bincount((ctx[deep] - a * a) * a + c[3][deep], n[deep], len(kept) * a).reshape(-1, a)
            self.bits[:, k] = np.concatenate((below, self._costs(counts, below[kept % (a * a)]))).ravel()

    @staticmethod
    def _costs(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Bits of each symbol in contexts with these counts, given their bits in the next shorter context."""
        n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log2((n + d) / counts)
            escaped = np.log2((n + d) / d) + below
        return np.where(n == 0, below, np.where(counts > 0, seen, escaped))

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each (not empty) text in each language."""
        data, starts, ends = _laid_out(texts)
        c = self.code[data]
        row = self.row[(c[:-3] * self.a + c[1:-2]) * self.a + c[2:-1]].astype(np.int64)
        bits = self.bits[row * self.a + c[3:]]
        cuts = np.stack([starts - 3, ends - 3], 1).ravel()[:-1]
        return np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]


class Places:
    """The place of each of the distinct ``keys`` (from 0 on), by open addressing in a table four times their number at least."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.table[at[todo]] < 0]
            self.table[at[free]] = free
            todo = todo[self.table[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Places; -1 for other keys."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._slots(keys)
        out = self.table[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
            out[todo] = self.table[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


class SparseTrees:
    """The languages' trees with every context: costs of the sequences that some language has seen, and of escapes from contexts."""

    def __init__(self, grams: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs, n_langs = [x for x, _, _ in grams], max(len(grams), 1)
        used = np.unique(np.concatenate([np.array([_PAD[0]]), *(g >> s & 255 for _, g, _ in grams for s in (0, 8, 16, 24))]))
        self.code = np.full(256, len(used), np.int64)  # bytes never seen share one symbol
        self.code[used] = np.arange(len(used))
        self.a = a = len(used) + 1
        coded = [(self._key([self.code[g >> s & 255] for s in (24, 16, 8, 0)]), n.astype(np.float64)) for _, g, n in grams]
        four = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in coded)]))
        three = np.unique(np.concatenate((four // a, four % a**3)))
        self.four, self.three = Places(four), Places(three)
        self.bits1, self.escape2 = np.full((a * a, n_langs), 8, np.float32), np.zeros((a * a, n_langs), np.float32)
        self.bits2, self.escape3 = (np.zeros((len(three), n_langs), np.float32) for _ in range(2))
        self.bits3 = np.zeros((len(four), n_langs), np.float32)
        for i, (k, n) in enumerate(coded):
            below = np.full((1, a), 8.0)
            for order in range(2):
                below = ContextTrees._costs(np.bincount(k % a ** (order + 1), n, a ** (order + 1)).reshape(-1, a), below[np.zeros(a**order, np.int64)])
            seen, at = np.unique(k % a**3, return_inverse=True)
            times = np.bincount(at, n, len(seen))
            total, kinds = np.bincount(seen // a, times, a * a), np.bincount(seen // a, minlength=a * a)
            escape2 = np.log2((total + kinds) / np.maximum(kinds, 1), out=np.zeros(a * a), where=kinds > 0)
            bits2 = escape2[three // a] + below.ravel()[three % (a * a)]
            bits2[np.searchsorted(three, seen)] = np.log2((total + kinds)[seen // a] / times)
            ctx = np.searchsorted(three, k // a)
            total, kinds = np.bincount(ctx, n, len(three)), np.bincount(ctx, minlength=len(three))
            escape3 = np.log2((total + kinds) / np.maximum(kinds, 1), out=np.zeros(len(three)), where=kinds > 0)
            bits3 = escape3[np.searchsorted(three, four // a)] + bits2[np.searchsorted(three, four % a**3)]
            bits3[np.searchsorted(four, k)] = np.log2((total + kinds)[ctx] / n)
            for table, of in ((self.bits1, below.ravel()), (self.escape2, escape2), (self.bits2, bits2), (self.escape3, escape3), (self.bits3, bits3)):
                table[:, i] = of

    def _key(self, c: list[np.ndarray]) -> np.ndarray:
        return ((c[0] * self.a + c[1]) * self.a + c[2]) * self.a + c[3]

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each (not empty) text in each language."""
        data, starts, ends = _laid_out(texts)
        c, a = self.code[data], self.a
        k = self._key([c[:-3], c[1:-2], c[2:-1], c[3:]])
        place = self.four.of(k)
        bits = self.bits3[place] if len(self.bits3) else np.zeros((len(k), self.bits1.shape[1]), np.float32)
        new = np.flatnonzero(place < 0)
        if len(new):
            ctx, short = self.three.of(k[new] // a), k[new] % a**3
            place = self.three.of(short)
            low = self.escape2[short // a] + self.bits1[short % (a * a)]
            low[place >= 0] = self.bits2[place[place >= 0]]
            low[ctx >= 0] += self.escape3[ctx[ctx >= 0]]
            bits[new] = low
        cuts = np.stack([starts - 3, ends - 3], 1).ravel()[:-1]
        return np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]


def identify(docs: DataFrame, trees: ContextTrees | SparseTrees) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    score is the posterior of the predicted language, all being equally likely before. A null text, or one without a letter, is
    ``und`` with the score 0, as is every text if no language was learned. Of equally short codes the first language counts. Repeated rows give repeated
    rows, an empty table none.
    """
    sent = docs.sparkSession.sparkContext.broadcast({k: vars(v) if isinstance(v, Places) else v for k, v in vars(trees).items()})  # plain arrays: workers need no class to load them
    kinds = type(trees), Places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, letter = kinds[0].__new__(kinds[0]), regex.compile(r"\p{L}").search
        vars(trees).update(sent.value)
        for name in ("three", "four"):
            if name in sent.value:
                place = kinds[1].__new__(kinds[1])
                vars(place).update(sent.value[name])
                setattr(trees, name, place)
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for part in _runs(texts, [i for i, t in enumerate(texts) if t and letter(t)] if trees.langs else []):
                bits = trees.code_lengths([texts[i] for i in part])
                best = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                score[part] = 1 / odds
                for i, k in zip(part, best.tolist(), strict=True):
                    pred[i] = trees.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, max_cells: int | None = None) -> ContextTrees | SparseTrees:
    """Trees of every language in ``docs`` (doc_id, text, lang), with all contexts unless ``max_cells`` asks for a cut dense table."""
    grams = count_grams(docs, train_docs)
    return SparseTrees(grams) if max_cells is None else ContextTrees(grams, max_cells)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
