"""A model of column types: fitted on all values of a table, applied to tables of the same columns."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame

from ..functions.normalize import memory_clean
from ..plans.cells import frequencies
from .profile import convert, decide_types, type_ratios


class TypeModel:
    """fit infers a type for each column; a column without values is a string with the probability 0. transform casts, and may keep booleans and dates as numbers."""

    def __init__(self):
        self.types: dict[str, dict] = {}
        self.timings: dict[str, float] = {}

    def fit(self, df: DataFrame) -> TypeModel:
        began = time.time()
        rows = decide_types(type_ratios(frequencies({"t": df}, memory_clean))).collect()  # one a column
        known = {r["column_name"]: {"type": r["atomic_type"], "confidence": r["atomic_prob"], "convertible": max(r["bool_ratio"], r["date_ratio"], r["numeric_ratio"])} for r in rows}
        self.types = {c: known.get(c, {"type": "string", "confidence": 0.0, "convertible": 0.0}) for c in df.columns}
        self.timings["fit"] = round(time.time() - began, 4)
        return self

    def transform(self, df: DataFrame, numeric_bool: bool = False, numeric_date: bool = False) -> DataFrame:
        out = convert(df, {c: t["type"] for c, t in self.types.items()})
        for c, t in self.types.items():
            if c in df.columns and (numeric_bool and t["type"] == "bool" or numeric_date and t["type"] == "date"):
                out = out.withColumn(c, out[f"`{c}`"].cast("int" if t["type"] == "bool" else "long"))
        return out

    def fit_transform(self, df: DataFrame, **how) -> DataFrame:
        return self.fit(df).transform(df, **how)

    def schema(self) -> dict[str, str]:
        return {c: t["type"] for c, t in self.types.items()}

    def schema_to_json(self) -> str:
        return json.dumps(self.types, sort_keys=True)

    def save_schema(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.schema_to_json())
