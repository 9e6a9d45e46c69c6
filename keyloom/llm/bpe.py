"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words.

Words are the matches of the tokenizer's pattern. ``encode_words`` is the operator's core: it turns a
word into an array of its bytes' ids and folds merges over it; literal arrays hold the rank map. ``encode_texts`` counts all distinct words and encodes the frequent ones once
(HOT words of at most HOT_BYTES bytes), into a few files of the shared folder that each executor fetches; the driver sees none of them. The words of a text that aren't among them are folded where they
occur. So no occurrence of a word is ever shuffled. Bytes are decoded from the ids that come out.
"""

from __future__ import annotations

import base64
import fcntl
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, map_texts, materialize, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: How many words are sent to executors at most, of how many bytes each, and in how many files; parts between spaces that a worker remembers.
HOT, HOT_BYTES, FILES, MEMO = 1 << 20, 32, 8, 1 << 19
#: Characters of ids that are decoded together.
TOGETHER = 1 << 16
#: Characters of a plan's text that the driver keeps, at most: plans here hold the rank map.
PLAN_TEXT = 100_000
#: Words of more bytes merge all places of the best pair in one step.
LONG = 48
#: Bits of an id in the fold's elements; the rank of a pair that has none, and the id of the sentinels.
_ID = 20
_NONE = _EDGE = (1 << _ID) - 1
#: Unicode's white space, as tiktoken's \s has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S spelt out, which engines read differently."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


#: Letters of the Latin blocks, as a character class has them; beyond ASCII, a text of these alone has no other letters or digits.
_LATIN = r"\xc0-\xd6\xd8-\xf6\xf8-\u024f"


def latin_pattern(pattern: str) -> str | None:
    """The pattern for texts of ASCII and Latin letters, without Unicode properties: a faster engine reads it. None if it can't be put so."""
    classes = {r"\p{L}": f"A-Za-z{_LATIN}", r"\p{N}": "0-9"}
    p = plain_pattern(pattern)
    for k, c in classes.items():
        p = re.sub(r"\[[^\]]*\]", lambda m, k=k, c=c: m[0].replace(k, c), p).replace(k, f"[{c}]")
    return None if r"\p" in p else p


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _own_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two pieces that merge into a token: what the merges of lower ranks make of its bytes. None if those leave more pieces."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, at = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if least >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _placed(pairs: list[tuple[int, int, int]], size: int) -> tuple[list[int], list[int]]:
    """Where the row of each x < ``size`` begins in a table of pairs (x, y, rank), and the table: pair (x, y) stands at start[x] + y, as rank above x.

    Rows overlap: each begins at the first place where all of its pairs fall on free places, the longest rows first. -1 marks free places.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for x, y, rank in pairs:
        rows.setdefault(x, []).append((y, rank))
    start, table, used = [0] * size, {}, 0  # used is a set of bits
    for x, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        blocked = 0
        for y, _ in row:
            blocked |= used >> y
        start[x] = (~blocked & (blocked + 1)).bit_length() - 1
        for y, rank in row:
            used |= 1 << (start[x] + y)
            table[start[x] + y] = rank << _ID | x
    return start, [table.get(i, -1) for i in range(used.bit_length())]


@lru_cache(4)
def _literals(path: str) -> tuple[str, ...]:
    """As JSON: the rank map (starts of rows, pairs), the ids of single bytes, 1 for each rank whose merges must go one by one; the tokens.

    Only the pair that really merges into a token is in the map: no other pair with that token's bytes is ever the best one. After a merge that
    makes the token t, its places can all merge at once unless t with a neighbour makes a token of a lower rank.
    """
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    tokens, single = [""] * size, [0] * size
    pairs = []
    for t, k in ranks.items():
        tokens[k] = t.hex().upper()
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i]), ranks.get(t[i:])
            if a is not None and b is not None:
                for x in (a, b):
                    if x > k:
                        single[x] = 1
        if len(t) > 1 and (pair := _own_merge(t, ranks)):
            pairs.append((ranks[pair[0]], ranks[pair[1]], k))
    parts = (*_placed(pairs, size), [ranks[bytes([i])] for i in range(256)], single, tokens)
    return tuple(json.dumps(x, separators=(",", ":")) for x in parts)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def encode_words(word: Column, path: str) -> Column:
    """The ids of a word, by ranked merges: the leftmost pair of the lowest rank merges, until no pair has a rank.

    The fold's state is one array of longs, a piece each, between two sentinels: the rank of the pair with the next piece above the piece's id, so that the
    least element is the best pair. A merge replaces three elements by two. Long words merge all places of the best pair in one step.
    """
    names = ("start", "pair", "byte", "single")
    literals = F.struct(*(F.from_json(F.lit(x), "array<bigint>").alias(n) for n, x in zip(names, _literals(path), strict=False)))
    id_mask, none, rest = F.lit(_EDGE).cast("long"), F.lit(_NONE << _ID), F.lit(1 << 30)

    def folded(m: Column) -> Column:
        def piece(x: Column, y: Column) -> Column:
            """The element of piece x before piece y."""
            found = F.get(m["pair"], (F.get(m["start"], x.cast("int")) + y).cast("int"))
            return F.when(found.bitwiseAND(id_mask) == x, found).otherwise(none.bitwiseOR(x))

        def state(ids: Column) -> Column:
            return F.zip_with(ids, F.slice(ids, F.lit(2), rest), piece)

        def short(ids: Column) -> Column:
            def merged(s: Column, low: Column, p: Column) -> Column:
                token = F.shiftright(low, _ID)
                new = F.array(piece(F.get(s, p - 2).bitwiseAND(id_mask), token), piece(token, F.get(s, p + 1).bitwiseAND(id_mask)))
                return F.concat(F.slice(s, F.lit(1), p - 2), new, F.slice(s, p + 2, rest))

            def step(s: Column) -> Column:
                return _let(F.array_position(s, F.array_min(s)).cast("int"), lambda p: F.when(F.get(s, p - 1) >= none, s).otherwise(merged(s, F.get(s, p - 1), p)))

            return F.aggregate(F.slice(ids, F.lit(4), rest), state(ids), lambda s, _: step(s))

        def all_merged(s: Column, low: Column) -> Column:
            token = F.shiftright(low, _ID)
            marks = F.array_join(F.transform(s, lambda v: F.when(v == low, "1").otherwise("0")), "")
            one = F.rpad(F.concat(F.regexp_extract(marks, "^0*", 0), F.lit("1")), F.size(s), F.lit("0"))
            chosen = F.when(F.get(m["single"], token.cast("int")) == 1, one).otherwise(F.replace(marks, F.lit("11"), F.lit("10")))

            def joined(bits: Column) -> Column:
                left = lambda i: F.when(F.get(bits, i) == "1", token).when(F.coalesce(F.get(bits, i - 1), F.lit("0")) == "1", F.lit(None))
                return F.array_compact(F.transform(s, lambda v, i: left(i).otherwise(v.bitwiseAND(id_mask))))

            return _let(_let(F.split(chosen, ""), joined), state)

        def long(ids: Column) -> Column:
            def step(s: Column) -> Column:
                return _let(F.array_min(s), lambda low: F.when(low >= none, s).otherwise(all_merged(s, low)))

            return F.aggregate(F.slice(ids, F.lit(4), rest), state(ids), lambda s, _: step(s))

        def run(ids: Column) -> Column:
            done = F.when(F.size(ids) <= LONG, short(ids)).otherwise(long(ids))
            return _let(done, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda v: v.bitwiseAND(id_mask).cast("int")))

        # ISO-8859-1 makes a character of each byte
        ids = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(m["byte"], F.ascii(c)))
        edge = F.array(F.lit(_EDGE).cast("long"))
        return _let(F.concat(edge, ids, edge), run)

    return _let(literals, folded)


def decode_ids(ids: Column, path: str) -> Column:
    """The bytes of ids: their tokens' bytes, concatenated."""
    tokens = F.from_json(F.lit(_literals(path)[-1]), "array<string>")
    return _let(tokens, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def splits_at_spaces(pattern: str) -> bool:
    """Whether a text's matches are those of its parts when it is cut before each space; known of this pattern, whose matches hold a space only in front or among white space."""
    return pattern == public_tokenizers.PATTERN


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n): every word of all texts, and how often it occurs. Parts between spaces are counted first, where that makes no difference: fewer are then searched."""
    parts = docs.where("text is not null")
    if splits_at_spaces(pattern):
        cut = parts.select(F.posexplode(F.split("text", " ", -1)).alias("pos", "part"))
        parts = cut.groupBy((F.col("pos") > 0).alias("spaced"), "part").agg(F.count("*").alias("n"))
        parts = parts.select(F.when(F.col("spaced"), F.concat(F.lit(" "), F.col("part"))).otherwise(F.col("part")).alias("text"), "n")
    else:
        parts = parts.select("text", F.lit(1).cast("long").alias("n"))
    words = F.regexp_extract_all(F.col("text"), F.lit(plain_pattern(pattern)), F.lit(0))
    return parts.select(F.explode(words).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def _least_class(classes: list, most: int) -> int | None:
    """The lowest class that, with those above, holds no more than ``most`` words; None if even the highest holds more."""
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r["class"]):
        if (total := total + r["k"]) > most:
            break
        least = r["class"]
    return least


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """Those of (word, n) in the classes of highest n that together hold at most ``most`` words; none of over HOT_BYTES bytes."""
    classed = words.where(F.octet_length("word") <= HOT_BYTES).withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
    least = _least_class(classed.groupBy("class").agg(F.count("*").alias("k")).collect(), most)
    return classed.where(F.lit(False) if least is None else F.col("class") >= least).select("word")


def _as_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def _sent_words(words: DataFrame, path: str) -> list[str]:
    """Folds words into files that executors fetch from the shared folder; their names."""
    spark = words.sparkSession
    if int(re.sub(r"\D", "", spark.conf.get("spark.sql.maxPlanStringLength"))) > PLAN_TEXT:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    words = materialize(words.select("word"))  # a plan that holds the rank map has no exchange: Spark keeps the text of each plan that it adapts
    coded = words.coalesce(FILES).select(F.col("word").cast("binary").alias("word"), F.xxhash64("word").alias("digest"), _as_text(encode_words(F.col("word"), path)).alias("ids"))
    files = materialize(coded).inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in files]


def _mapped(files: list[str]) -> str:
    """The folder with the words of fetched files as flat arrays, sorted by digest. The first worker of an executor that needs it writes it, next to the files, and marks it as whole; not by a rename, which not every file system does for folders."""
    folder = os.path.join(SparkFiles.getRootDirectory(), f"words-{hashlib.sha1(' '.join(files).encode()).hexdigest()}")
    with open(f"{folder}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{folder}/whole"):
            kinds = pa.schema([("word", pa.binary()), ("digest", pa.int64()), ("ids", pa.string())])
            t = pa.concat_tables([pq.read_table(SparkFiles.get(f), schema=kinds, use_threads=False) for f in files] or [kinds.empty_table()])
            t = t.take(np.argsort(t["digest"].to_numpy())).combine_chunks()
            os.makedirs(folder, exist_ok=True)
            np.save(f"{folder}/digest.npy", t["digest"].to_numpy())
            for name in ("word", "ids"):
                column = pa.concat_arrays(t[name].chunks) if t[name].num_chunks else pa.array([], t[name].type)
                np.save(f"{folder}/{name}.npy", np.frombuffer(column.buffers()[2] or b"", np.uint8))
                np.save(f"{folder}/{name}_at.npy", np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset : column.offset + len(column) + 1])
            del t, column
            pa.default_memory_pool().release_unused()
            open(f"{folder}/whole", "w").close()
    return folder


class KnownWords:
    """Words and their ids, as text, in memory-mapped arrays; found by their digests. A worker that has them open holds none of them."""

    def __init__(self, folder: str):
        mapped = lambda name: np.load(f"{folder}/{name}.npy", mmap_mode="r") if os.path.getsize(f"{folder}/{name}.npy") > 128 else np.load(f"{folder}/{name}.npy")
        self.digests, self.word_at, self.ids_at = mapped("digest"), mapped("word_at"), mapped("ids_at")
        self.word, self.ids = (memoryview(mapped(n)) for n in ("word", "ids"))

    def codes(self, words: list[str]) -> list[str | None]:
        """The ids of each word; None for words that aren't known."""
        codes: list[str | None] = [None] * len(words)
        if not words or not len(self.digests):
            return codes
        coded = [w.encode() for w in words]
        digests = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded), np.uint64, len(coded)).view(np.int64)
        at = np.minimum(np.searchsorted(self.digests, digests), len(self.digests) - 1)
        hits = np.flatnonzero(self.digests[at] == digests)
        at = at[hits]
        word, ids = self.word, self.ids
        for i, w0, w1, i0, i1 in zip(*(x.tolist() for x in (hits, self.word_at[at], self.word_at[at + 1], self.ids_at[at], self.ids_at[at + 1])), strict=True):
            if word[w0:w1] == coded[i]:
                codes[i] = str(ids[i0:i1], "ascii")
        return codes


class Decoder:
    """The bytes of ids that are joined by commas: the tokens' bytes, gathered from one array of all of them."""

    def __init__(self, tokens: list[bytes]):
        self.bytes, self.size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size

    def decode(self, runs: list[str]) -> Iterator[tuple[int, bytes]]:
        """How many ids each run has, and their bytes; short runs are gathered together."""
        at = 0
        while at < len(runs):
            some, room = [runs[at]], TOGETHER - len(runs[at])
            while at + len(some) < len(runs) and (room := room - len(runs[at + len(some)])) >= 0:
                some.append(runs[at + len(some)])
            at += len(some)
            of = np.fromstring(",".join(some), np.int32, sep=",")
            size = self.size[of]
            end = np.cumsum(size)
            whole = self.bytes[np.arange(end[-1]) + np.repeat(self.start[of] - end + size, size)].tobytes()
            n = [r.count(",") + 1 for r in some]
            begin = 0
            for k, last in zip(n, end[np.cumsum(n) - 1].tolist(), strict=True):
                yield k, whole[begin:last]
                begin = last


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids (decimal, joined by commas), decoded (bytes of the ids).

    Each match of ``pattern`` is encoded by itself by the ranks in the file ``path``, without special tokens. A null text counts as empty, and has
    no ids. Repeated rows give repeated rows, an empty table none; other columns are left out.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path(RANKS)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    plain, latin = plain_pattern(pattern), latin_pattern(pattern)

    words = materialize(distinct_words(docs, pattern))
    files = _sent_words(frequent_words(words, hot), path)
    tokens = spark.sparkContext.broadcast([bytes.fromhex(t) for t in json.loads(_literals(path)[-1])])

    spaced = splits_at_spaces(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("bpe words", *files), lambda: KnownWords(_mapped(files)))
        decoder = kept(("bpe tokens", path), lambda: Decoder(tokens.value))
        memo: dict[str, str] = kept(("bpe parts", *files), dict)
        find = regex.compile(plain).findall
        find_latin, beyond = (re.compile(latin).findall, re.compile(rf"[^\x00-\x7f{_LATIN}]").search) if latin else (find, bool)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                # a text is its first part, and others that follow a space
                parts = [t.split(" ")[1:] if spaced else [] for t in texts]
                firsts = [t.partition(" ")[0] if spaced else t for t in texts]
                codes = [list(map(memo.get, p)) for p in parts]
                blank = [[i for i, c in enumerate(cs) if c is None] for cs in codes]
                new = list(dict.fromkeys(ps[i] for ps, at in zip(parts, blank, strict=True) for i in at))
                words = [find(t) if beyond(t) else find_latin(t) for t in [*firsts, *(f" {p}" for p in new)]]
                found = iter(known.codes([w for ws in words for w in ws]))
                coded = [list(islice(found, len(ws))) for ws in words]
                place = {p: i for i, p in enumerate(new, len(texts))}
                whole = {p: ",".join(coded[i]) for p, i in place.items() if None not in coded[i]}
                for p, c in whole.items():
                    if len(memo) < MEMO:
                        memo[p] = c
                ends, n, ids, decoded, cold = [0], [], [], [], []

                def put(run: list[str], k: int) -> list[str]:
                    """Adds the words of part k to a run of known ids; a word that isn't known ends it."""
                    for w, c in zip(words[k], coded[k], strict=True):
                        if c is None:
                            close(run)
                            for column, value in ((n, None), (ids, None), (decoded, None), (cold, w)):
                                column.append(value)
                            run = []
                        else:
                            run.append(c)
                    return run

                def close(run: list[str]) -> None:
                    if run:
                        done = ",".join(run)
                        for column, value in ((ids, done), (cold, None), (n, None), (decoded, None)):
                            column.append(value)

                for k, (ps, cs) in enumerate(zip(parts, codes, strict=True)):
                    run, start = put([], k), 0
                    for i in blank[k]:
                        cs[i] = whole.get(ps[i])
                        if cs[i] is None:
                            run, start = put(run + cs[start:i], place[ps[i]]), i + 1
                    close(run + cs[start:])
                    ends.append(len(ids))
                known_runs = [i for i, done in enumerate(ids) if done is not None]
                for i, (k, whole_run) in zip(known_runs, decoder.decode([ids[i] for i in known_runs]), strict=True):
                    n[i], decoded[i] = k, whole_run
                runs = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary()), pa.array(cold, pa.string())], ["n", "ids", "bytes", "word"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], ["doc_id", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = map_texts(docs, run, f"doc_id {kind}, runs array<struct<n long, ids string, bytes binary, word string>>", ("bpe words", "bpe tokens", "bpe parts"))

    def fold(r: Column) -> Column:
        inline = _let(encode_words(r["word"], path), lambda ids: F.struct(F.size(ids).cast("long").alias("n"), _as_text(ids).alias("ids"), decode_ids(ids, path).alias("bytes")))
        return F.when(r["word"].isNull(), F.struct(r["n"].alias("n"), r["ids"].alias("ids"), r["bytes"].alias("bytes"))).otherwise(inline)

    done = runs.select("doc_id", F.transform("runs", fold).alias("runs"))
    return done.select(
        "doc_id",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["n"]).alias("n_tokens"),
        F.array_join(F.transform("runs", lambda r: r["ids"]), ",").alias("ids"),
        F.array_join(F.transform("runs", lambda r: r["bytes"].cast("string")), "").cast("binary").alias("decoded"),
    )


def token_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    coded = encode_texts(docs, path, pattern, hot)
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
