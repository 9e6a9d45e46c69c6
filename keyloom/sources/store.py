"""Content signatures of tables, and frequencies that are kept by them.

A signature is a multiset hash: the number of rows, and the xor and the sum of their hashes. It doesn't depend on order or partitions, and the signature of two parts together is the sum of theirs.
The store keeps a table's frequencies with its signature and the list of its files. Files that haven't changed aren't read again: with the same files the kept frequencies are all there is to read,
and with some more only these are counted and added. Tables that aren't files are judged by their signature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cells import frequencies

#: Between the fields of a row, and in place of a null.
_FIELD, _NULL = "\x1f", "\x1e"


class Signature(NamedTuple):
    n_rows: int
    hash_xor: int
    hash_sum: int

    def __add__(self, other: Signature) -> Signature:
        return Signature(self.n_rows + other.n_rows, self.hash_xor ^ other.hash_xor, self.hash_sum + other.hash_sum)


def row_hash(columns: list[str], portable: bool = False) -> Column:
    """A hash of a row of ``columns``: of 63 bits, or, if it is to be the same in other engines, the first 15 hex digits of the MD5 of the row's text."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NULL)) for c in columns]
    if portable:
        return F.conv(F.substring(F.md5(F.concat_ws(_FIELD, *text)), 1, 15), 16, 10).cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(len(columns)), *text), 1)


def signatures(tables: dict[str, DataFrame], portable: bool = False) -> DataFrame:
    """(table_name, n_rows, hash_xor, hash_sum): one pass over each table, partial per task; a table without rows has zeros. ``hash_sum`` is exact, as a decimal."""

    def of(name: str, df: DataFrame) -> DataFrame:
        h = df.select(row_hash(df.columns, portable).alias("h"))
        x, s = F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0))
        return h.agg(F.count("*").alias("n_rows"), x.cast("long").alias("hash_xor"), s.cast("decimal(38,0)").alias("hash_sum")).select(F.lit(name).alias("table_name"), "*")

    return reduce(DataFrame.unionByName, [of(n, d) for n, d in tables.items()])


def _files(df: DataFrame) -> dict[str, str]:
    """The files of a table, with their length and time; nothing in them is read."""
    paths = df.inputFiles()
    if not paths:
        return {}
    found = df.sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return {r["path"]: f"{r['length']}:{r['modificationTime'].timestamp()}" for r in found.collect()}  # the driver lists them to read the table, too


_MANIFEST = "key string, version long, files map<string,string>, n_rows long, hash_xor long, hash_sum decimal(38,0), data string"


class FrequencyStore:
    """Frequencies in ``folder``, which driver and executors share. Each change writes new files and then one row of the manifest, so that what was there stays readable until then."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        #: What became of each table at the last call: kept, appended or counted.
        self.outcome: dict[str, str] = {}

    def _manifest(self) -> dict[str, dict]:
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").collect()  # a row per table and version
        except AnalysisException:
            return {}
        return {r["key"]: r.asDict(recursive=True) for r in sorted(rows, key=lambda r: r["version"])}

    def _write(self, freq: DataFrame) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        freq.write.parquet(path)
        return path

    def signature(self, name: str) -> Signature | None:
        """The kept signature of a table, whatever its schema and cleaning."""
        last = [m for k, m in self._manifest().items() if k.split("\x1f")[0] == name]
        return Signature(last[-1]["n_rows"], last[-1]["hash_xor"], int(last[-1]["hash_sum"])) if last else None

    def frequencies(self, tables: dict[str, DataFrame], clean: Callable[[Column], Column], style: str) -> DataFrame:
        """As ``plans.cells.frequencies``; ``style`` names the cleaning, as a part of the key."""
        known, rows, parts, self.outcome = self._manifest(), [], [], {}
        for name, df in tables.items():
            key = "\x1f".join((name, style, df.schema.json()))
            old, files = known.get(key), _files(df)
            data, sign = None, None
            if old and files and old["files"] == files:
                self.outcome[name], data = "kept", old["data"]
            elif old and files and old["files"].items() <= files.items():
                data, sign = self._appended(name, df, old, sorted(files.keys() - old["files"].keys()), clean)
            if data is None:
                sign = self._sign(name, df)
                if old and not files and sign == Signature(old["n_rows"], old["hash_xor"], int(old["hash_sum"])):
                    self.outcome[name], data, sign = "kept", old["data"], None
                else:
                    self.outcome[name], data = "counted", self._write(frequencies({name: df}, clean))
            if sign is not None:
                rows.append((key, (old["version"] if old else 0) + 1, files, sign.n_rows, sign.hash_xor, Decimal(sign.hash_sum), data))
            parts.append(self.spark.read.parquet(data))
        if rows:
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return reduce(DataFrame.unionByName, parts)

    def _sign(self, name: str, df: DataFrame) -> Signature:
        r = signatures({name: df}).first()
        return Signature(r["n_rows"], r["hash_xor"], int(r["hash_sum"]))

    def _appended(self, name: str, df: DataFrame, old: dict, new: list[str], clean: Callable[[Column], Column]) -> tuple[str | None, Signature | None]:
        """Counts the new files alone and adds them to what is kept; nothing if the table can't be cut by its files."""
        try:
            more = df.where(F.col("_metadata.file_path").isin(new))
            sign = Signature(old["n_rows"], old["hash_xor"], int(old["hash_sum"])) + self._sign(name, more)
        except AnalysisException:
            return None, None
        both = self.spark.read.parquet(old["data"]).unionByName(frequencies({name: more}, clean))
        added = both.groupBy("table_name", "column_name", "ordinal", "family", "v").agg(F.max("len").alias("len"), F.sum("cnt").alias("cnt"))
        self.outcome[name] = "appended"
        return self._write(added), sign
