"""One call from files to results, with checked parameters and errors as data."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import SparkSession

from .config import EngineConfig, SelectConfig, SoftConfig, StrictConfig
from .engine import STAGES, Engine, EngineError, parse_stages
from .sources.catalog import Catalog, CatalogError

#: Parameters of either mode: name, setting, lowest and highest value.
STRICT = {"min_distinct_child": ("min_distinct_child", 1, 10**6), "min_distinct_coverage": ("min_distinct_coverage", 0, 1), "min_non_null_rows": ("min_non_null", 0, 10**9), "min_row_coverage": ("min_row_coverage", 0, 1)}
SOFT = {"soft_min_distinct_coverage": ("min_distinct_coverage", 0, 1), "soft_min_row_coverage": ("min_row_coverage", 0, 1), "soft_max_parents_per_fk": ("max_parents", 1, 1000), "soft_routing_sim": ("routing_sim", 0, 1), "soft_min_non_null": ("min_non_null", 0, 10**9)}
COMMON = {"min_edge_score": ("min_score", 0, 1), "max_edges_per_fk": ("max_edges_per_fk", 1, 100)}


def health() -> dict:
    return {"status": "ok"}


def configure(mode: str, params: dict) -> EngineConfig:
    """A configuration of parameters; those of the other mode and values out of bounds are refused."""
    other = SOFT if mode == "strict" else STRICT
    if wrong := sorted(p for p in params if p in other):
        raise EngineError("INVALID_PARAM_COMBO", f"not for mode {mode}: {', '.join(wrong)}")
    mine = (STRICT if mode == "strict" else SOFT) | COMMON
    for p, v in params.items():
        if p not in mine:
            raise EngineError("UNKNOWN_PARAM", p)
        if not mine[p][1] <= v <= mine[p][2]:
            raise EngineError("PARAM_OUT_OF_RANGE", f"{p} must be {mine[p][1]} to {mine[p][2]}")
    of = lambda table: {table[p][0]: v for p, v in params.items() if p in table}
    strict, soft = replace(StrictConfig(), **of(STRICT)), replace(SoftConfig(), **of(SOFT))
    return EngineConfig(strict=strict, soft=soft, select=replace(SelectConfig(), **of(COMMON)))


def discover(spark: SparkSession, paths: list[str], include: str | None = None, mode: str = "strict", max_rows: int = 500, dot: bool = False, debug_bundle: bool = False, **params) -> dict:
    """The stages named in ``include`` for CSV files, all of them with ``debug_bundle`` and no ``include``. Errors come back as {"error": {code, message}}."""
    try:
        include = ",".join(STAGES) if debug_bundle and not include else include
        if not 1 <= max_rows <= 50_000:
            raise EngineError("PARAM_OUT_OF_RANGE", "max_rows must be 1 to 50000")
        parse_stages(include)
        if mode not in ("strict", "soft"):
            raise EngineError("INVALID_PARAM_COMBO", f"unknown mode {mode}")
        config = configure(mode, params)
        engine = Engine(Catalog.of_uploads(spark, paths), config, mode, nulls="memory", infer_types=True)
        out = engine.run(include, max_rows, dot)
        engine.close()
        return out | {"config": asdict(config)}
    except (EngineError, CatalogError) as e:
        return {"error": {"code": e.code, "message": str(e)}}
