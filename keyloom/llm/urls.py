"""URL filters: a memory-mapped sorted array of 64-bit digests, probed by vectorised binary search."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class DigestArray:
    """Strings with a flag each, in four files beside each other: sorted digests, flags, offsets, and the strings' bytes.

    The arrays are memory-mapped, so workers on a machine share their pages and hold no string in their own memory.
    """

    KINDS = ("keys", "flags", "starts", "text")

    def __init__(self, prefix: str):
        kinds = (np.dtype("<u8"), np.dtype("u1"), np.dtype("<u8"), np.dtype("u1"))
        self.keys, self.flags, self.starts, self.text = (np.memmap(f, t, "r") if os.path.getsize(f := f"{prefix}.{k}") else np.empty(0, t) for k, t in zip(self.KINDS, kinds, strict=True))

    @classmethod
    def write(cls, prefix: str, entries: dict[bytes, int]) -> list[str]:
        """The files' paths."""
        order = sorted(entries, key=lambda e: (xxhash.xxh64_intdigest(e), e))
        np.array([xxhash.xxh64_intdigest(e) for e in order], "<u8").tofile(f"{prefix}.keys")
        np.array([entries[e] for e in order], "u1").tofile(f"{prefix}.flags")
        np.concatenate(([0], np.cumsum([len(e) for e in order]))).astype("<u8").tofile(f"{prefix}.starts")
        with open(f"{prefix}.text", "wb") as f:
            f.writelines(order)
        return [f"{prefix}.{k}" for k in cls.KINDS]

    def entry(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.starts[i + 1]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The place of each probe, or -1. Equal digests are told apart by the stored strings."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == digests[hit]
        for i in np.flatnonzero(hit).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.entry(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def split_url(urls: pa.Array) -> tuple[list[str], list[str]]:
    """Host (A-Z lower-cased) and path of urls; both empty where the url is null or has no ://."""
    parts = pc.extract_regex(urls, r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)")
    host, path = (pc.fill_null(pc.struct_field(parts, k), "").to_pylist() for k in ("host", "path"))
    return [h.translate(_LOWER) for h in host], path


_LOWER = {i: i + 32 for i in range(65, 91)}


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of its column ``url``.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest fitting rule wins, of
    equally long ones that with the longer host. Without one the rule is null and the verdict is ``default``: an address
    that the array doesn't hold. A null url, or one without ://, has an empty host and path, and no rule. Of rules stated twice the
    last counts. Only the columns url and the key columns pass through Python.
    """
    spark = pages.sparkSession
    of = {r: v for v, r in rules}
    name = f"urls-{uuid.uuid4().hex}"
    packed = {"\0".join(_split_rule(r)).encode(): int(v == "block") for r, v in of.items()}
    for path in DigestArray.write(f"{tempfile.mkdtemp(prefix='rules-')}/{name}", packed):
        spark.sparkContext.addFile(path)
    split = [_split_rule(r) for r in of]
    labels = max((h.count(".") + 1 for h, _ in split), default=0)
    lengths = sorted({len(p) for _, p in split})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestArray(SparkFiles.get(f"{name}.keys")[: -len(".keys")])
        for b in batches:
            hosts, paths = split_url(b.column(b.num_columns - 1))
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                if not h:
                    continue
                parts = h.rsplit(".", labels)
                tails = [".".join(parts[-k:]) for k in range(1, min(labels, len(parts)) + 1)]
                for t in tails:
                    for n in lengths:
                        if n <= len(p):
                            probes.append(f"{t}\0{p[:n]}".encode())
                            owner.append(i)
            found = known.find(probes)
            best: dict[int, tuple[int, int, str, int]] = {}
            for k in np.flatnonzero(found >= 0).tolist():
                h, p = probes[k].decode().split("\0", 1)
                best[owner[k]] = max(best.get(owner[k], (-1, 0, "", 0)), (len(h) + len(p), len(h), h + p, int(known.flags[found[k]])))
            rule = [best[i][2] if i in best else None for i in range(b.num_rows)]
            verdict = [("allow", "block")[best[i][3]] if i in best else default for i in range(b.num_rows)]
            cols = [*b.columns[:-1], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "host", "path", "rule", "verdict"])

    keys = [c for c in pages.columns if c not in (url, "host", "path", "rule", "verdict")]
    kept = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keys)), F.col(f"`{url}`").cast("string").alias("address"))  # no name of theirs can clash with ours
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "host string, path string, rule string, verdict string"])
    return kept.mapInArrow(run, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keys)), "host", "path", "rule", "verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), low AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT l.page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY l.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM low l JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)
)
SELECT low.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM low LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (page_id)
"""
