"""The catalog: named tables over Parquet or CSV files, with pruned reads and SQL."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CSV_NULLS


class CatalogError(ValueError):
    """An input that can't be read; ``code`` names the case."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def table_name(path: str) -> str:
    """A file's name without its last extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].strip() or "table"


def null_tokens_to_null(df: DataFrame, tokens: Iterable[str] = CSV_NULLS) -> DataFrame:
    """String columns with these tokens made null."""
    tokens = list(tokens)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


class Catalog:
    """Tables by name. Nothing is read before it is used; reads take the columns that are asked for only."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables = spark, {}
        for name, df in (tables or {}).items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(f"`{name}`")

    def add_parquet(self, name: str, path: str) -> None:
        self.add(name, self.spark.read.parquet(path))

    def add_csv(self, name: str, path: str, header: bool = True, all_text: bool = False, nulls: Iterable[str] = (), multi_line: bool = False) -> None:
        """No row is dropped: a row that is too short ends in nulls. With ``multi_line`` quoted fields may hold newlines; a file is then one task's."""
        reader = self.spark.read.option("header", header).option("inferSchema", not all_text).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
        df = reader.csv(path)
        self.add(name, null_tokens_to_null(df, nulls) if nulls else df)

    def add_path(self, name: str, path: str, all_text: bool = False) -> None:
        kind = os.path.splitext(path)[1].lower()
        if kind == ".parquet":
            self.add_parquet(name, path)
        elif kind == ".csv":
            self.add_csv(name, path, all_text=all_text)
        else:
            raise ValueError(f"neither .parquet nor .csv: {path}")

    @classmethod
    def of_paths(cls, spark: SparkSession, sources: dict[str, str], all_text: bool = False) -> Catalog:
        out = cls(spark)
        for name, path in sources.items():
            out.add_path(name, path, all_text)
        return out

    @classmethod
    def of_uploads(cls, spark: SparkSession, paths: list[str], most: int = 30) -> Catalog:
        """CSV files, all columns as text, with the usual null tokens made null."""
        if not paths:
            raise CatalogError("NO_FILES", "no files were given")
        if len(paths) > most:
            raise CatalogError("TOO_MANY_FILES", f"{len(paths)} files were given; {most} is the most")
        out = cls(spark)
        for p in paths:
            try:
                out.add_csv(table_name(p), p, all_text=True, nulls=CSV_NULLS, multi_line=True)
            except Exception as e:
                raise CatalogError("CSV_READ_FAILED", f"{p}: {e}") from e
            if not out.tables[table_name(p)].columns:
                raise CatalogError("EMPTY_FILE", p)
        return out

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str) -> list[tuple[str, str]]:
        return self.tables[name].dtypes

    def list_columns(self, name: str) -> list[str]:
        return self.tables[name].columns

    def count_rows(self, name: str) -> int:
        return self.tables[name].count()

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def scalar(self, text: str, default=None):
        row = self.spark.sql(text).first()
        return default if row is None or row[0] is None else row[0]

    def read_columns(self, name: str, columns: list[str]) -> DataFrame:
        return self.tables[name].select(*(F.col(f"`{c}`") for c in columns))

    def preview(self, name: str, n: int = 7) -> str:
        """The first rows as text."""
        rows = [self.list_columns(name), *self.tables[name].limit(n).collect()]
        return "\n".join(",".join("" if x is None else str(x) for x in r) for r in rows)

    def close(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        self.tables = {}


def write_csv(df: DataFrame, path: str) -> None:
    """Nested cells become JSON text."""
    nested = ("array", "map", "struct")
    df.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(nested) else F.col(f"`{c}`") for c, t in df.dtypes)).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records; NaN and infinities become null."""
    json_safe(df).write.json(path)


def json_safe(df: DataFrame) -> DataFrame:
    bad = lambda c: F.isnan(c) | F.abs(c).isin(float("inf"))
    return df.select(*(F.when(~bad(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))
