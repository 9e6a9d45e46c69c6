"""Composite keys: minimal unique column sets, refuted by agree sets of a sample first, then tested on all rows.

The columns in which two rows agree are their agree set; a column set within it can't be unique. The sample holds, for each column, all rows of a few of its values (those with the lowest hashes), so
rows that agree on much come together; it can only refute. What it doesn't refute is tested on all rows, many sets in a pass. A pass shuffles 64 bits of hash for each set and row: first those in a small slice of the hashes,
where rows that agree come together, too, then for the sets that haven't been refuted the rest. A hash that repeats refutes a set only if 64 more bits of hash do.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the sample holds for each column, about; column sets that one pass over the rows tests.
AGREE_ROWS, SETS = 4096, 64
#: Hashes that a task compares, about; the part of all hashes that is looked at first, one of so many.
TASK_HASHES, SLICES = 1_000_000, 64


class CompositeKey(NamedTuple):
    """A unique column set: ``rows`` without a null in it, the share of different ones among these, and the share of rows with a null."""

    columns: tuple[str, ...]
    rows: int
    unique_ratio: float
    null_ratio: float


class Search(NamedTuple):
    """What was found, and how: column sets that the sample refuted, those tested on all rows, and the passes for it."""

    found: list[CompositeKey]
    refuted: int
    tested: int
    passes: int


class AgreeSets:
    """Hashed rows of a sample, and the agree sets found in it so far."""

    def __init__(self, hashes: np.ndarray, known: np.ndarray):
        self.hashes, self.known = hashes, known
        self.sets = np.zeros((0, hashes.shape[1]), bool)
        self.odd = np.random.default_rng(0).integers(1, 2**63, hashes.shape[1], np.uint64) | np.uint64(1)

    def refute(self, columns: list[int]) -> bool:
        """Whether two rows of the sample agree on ``columns``, all of them known. The whole agree set of such a pair is kept: it refutes other sets, too."""
        if self.sets[:, columns].all(1).any():
            return True
        rows = np.flatnonzero(self.known[:, columns].all(1))
        mixed = (self.hashes[rows][:, columns] * self.odd[columns]).sum(1, dtype=np.uint64)
        order = np.argsort(mixed, kind="stable")
        same = np.flatnonzero(np.diff(mixed[order]) == 0)
        a, b = rows[order[same]], rows[order[same + 1]]
        agree = (self.hashes[a] == self.hashes[b]) & self.known[a] & self.known[b]
        agree = agree[agree[:, columns].all(1)]
        if not len(agree):
            return False
        self.sets = np.concatenate((self.sets, agree[[int(agree.sum(1).argmax())]]))
        return True


def agree_sets(df: DataFrame, columns: list[str], rows: int, wanted: int = AGREE_ROWS) -> AgreeSets:
    """Of a sample of about ``wanted`` rows for each column, and no more than twice as many in all."""
    h = [F.xxhash64(F.col(f"`{c}`")) for c in columns]
    limit = int(min(1.0, wanted / max(1, rows)) * 2**31)
    low = reduce(lambda a, b: a | b, (F.shiftrightunsigned(x, 33) < limit for x in h))
    some = df.where(low).select(*(F.when(F.col(f"`{c}`").isNotNull(), x).alias(f"h{i}") for i, (c, x) in enumerate(zip(columns, h, strict=True)))).limit(2 * wanted * len(columns)).toArrow()
    known = np.stack([c.is_valid().to_numpy() for c in some.columns], 1)
    return AgreeSets(np.stack([c.fill_null(0).to_numpy() for c in some.columns], 1).view(np.uint64), known)


def _hash(columns: tuple[str, ...]) -> Column:
    """64 bits of hash of a column set, null where one of its columns is."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.when(~reduce(lambda a, b: a | b, (c.isNull() for c in cols)), F.xxhash64(*cols))


def _repeated_hashes(df: DataFrame, sets: list[tuple[str, ...]], rows: int, part: Column) -> dict[int, tuple[int, int, int]]:
    """Of each of ``sets`` with hashes in ``part`` that repeat: how many of them, the smallest and the largest. A task gets about TASK_HASHES of them, however many rows there are."""
    some = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), _hash(c).alias("h")) for i, c in enumerate(sets))))).where(F.col("h").isNotNull() & part)
    some = some.repartition(max(8, -(-rows * len(sets) // TASK_HASHES)), "i", "h")  # nearly all are different: counts before the shuffle would be of single rows
    again = some.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1").groupBy("i").agg(F.count("*").alias("k"), F.min("h").alias("low"), F.max("h").alias("high"))
    return {r["i"]: (r["k"], r["low"], r["high"]) for r in again.collect()}  # a row per column set


def _verified(df: DataFrame, sets: list[tuple[str, ...]], repeated: dict[int, tuple[int, int, int]]) -> set[int]:
    """Those of the sets with repeated hashes whose values repeat, by 64 more bits: of two of these hashes, for all sets in one pass, or else of all rows."""

    def again(which: dict[int, list[int]]) -> set[int]:
        part = lambda i, some: F.struct(F.lit(i).alias("i"), F.when(_hash(sets[i]).isin(some) if some else F.lit(True), _hash(sets[i])).alias("h1"), F.xxhash64(F.lit(i + 1), *(F.col(f"`{c}`") for c in sets[i])).alias("h2"))
        rows = df.select(F.inline(F.array(*(part(i, some) for i, some in which.items())))).where("h1 is not null")
        return {r["i"] for r in rows.groupBy("i", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct().collect()}  # a row per column set

    found = again({i: [low, high] for i, (_, low, high) in repeated.items()}) if repeated else set()
    for i, (k, *_) in repeated.items():
        if i not in found and k > 2:
            found |= again({i: []})
    return found


def repeating(df: DataFrame, sets: list[tuple[str, ...]], rows: int, slices: int = SLICES) -> list[bool]:
    """Of each column set whether a value repeats; rows with a null in it are left out. ``rows``: how many there are."""
    found = [False] * len(sets)
    # the slice goes by bits of a hash of the hash, so that it holds its share of any values
    slot = F.shiftrightunsigned(F.xxhash64("h"), 32) % slices
    parts = [(slot == 0, rows // slices + 1), (slot > 0, rows)] if rows * len(sets) > TASK_HASHES and slices > 1 else [(F.lit(True), rows)]
    for part, size in parts:
        left = [i for i, f in enumerate(found) if not f]
        if left:
            some = [sets[i] for i in left]
            for j in _verified(df, some, _repeated_hashes(df, some, size, part)):
                found[left[j]] = True
    return found


def _whole_rows(df: DataFrame, sets: list[tuple[str, ...]]) -> list[int]:
    """Of each column set the rows without a null in it."""
    if not sets:
        return []
    return list(df.agg(*(F.count(_hash(c)).alias(f"n{i}") for i, c in enumerate(sets))).first())


def unique_combinations(df: DataFrame, combos: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Those column sets without nulls whose values never repeat; all are tested in one pass, two if there are many rows."""
    if not combos or not (rows := df.count()):
        return []
    whole = [c for c, n in zip(combos, _whole_rows(df, combos), strict=True) if n == rows]
    return [c for c, again in zip(whole, repeating(df, whole, rows), strict=True) if not again]


def search(df: DataFrame, columns: list[str], max_k: int = 3, allow_nulls: bool = False, distinct: dict[str, int] | None = None, sample: int = AGREE_ROWS) -> Search:
    """Minimal unique sets of two to ``max_k`` of ``columns``, level by level.

    A column set with a null in some row is no key, or, with ``allow_nulls``, is judged on the other rows. ``distinct``, how many values columns have (without nulls), rules out sets that are too small to be unique.
    Columns that are unique by themselves should be left out. A table without rows has no keys; with repeated rows it has none, either.
    """
    columns = list(dict.fromkeys(columns))
    sizes = df.agg(F.count("*").alias("n"), *(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns))).first()
    rows = sizes["n"]
    if not allow_nulls:
        columns = [c for i, c in enumerate(columns) if sizes[f"n{i}"] == rows]
    found: list[CompositeKey] = []
    refuted = tested = passes = 0
    if not rows or len(columns) < 2:
        return Search(found, refuted, tested, passes)
    agree, place = agree_sets(df, columns, rows, sample), {c: i for i, c in enumerate(columns)}

    def possible(cs: Iterable[str]) -> bool:
        values = 1
        for c in cs:
            values *= (distinct or {}).get(c, rows)
        return allow_nulls or values >= rows

    for k in range(2, max_k + 1):
        level = [c for c in combinations(columns, k) if not any(set(f.columns) <= set(c) for f in found)]
        left = [c for c in level if possible(c) and not agree.refute([place[x] for x in c])]
        refuted, tested = refuted + len(level) - len(left), tested + len(left)
        for at in range(0, len(left), SETS):
            part = left[at : at + SETS]
            passes += 1
            unique = [c for c, again in zip(part, repeating(df, part, rows), strict=True) if not again]
            # without nulls in any of the columns all rows are whole
            for c, whole in zip(unique, _whole_rows(df, unique) if allow_nulls else [rows] * len(unique), strict=True):
                if whole:
                    found.append(CompositeKey(c, whole, 1.0, (rows - whole) / rows))
    return Search(found, refuted, tested, passes)
