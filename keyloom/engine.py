"""The engine: a lazy chain of stages over a catalog, and payloads of the stages that are asked for."""

from __future__ import annotations

import time
from datetime import UTC, date, datetime
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import viz
from .config import EngineConfig
from .functions.names import id_like
from .functions.normalize import memory_clean, sql_clean
from .operators import composite, inclusion, keys, profile, quality, recommend, selection, statistics
from .plans.cells import frequencies
from .sources.catalog import Catalog, json_safe
from .sources.store import FrequencyStore

STAGES = ("profiles", "profiles_enhanced", "ucc_unary", "ind", "scored", "relationships", "rel_missing", "duplicates", "duplicates_summary", "default_fk", "default_fk_summary", "surrogate_keys", "surrogate_keys_summary", "ucc_composite", "recommendations")
_FOUR = ("fk_table", "fk_column", "pk_table", "pk_column")
#: The order of a stage's rows: columns, those after a minus from high to low.
ORDER = {
    "profiles": ("table_name", "column_name"),
    "profiles_enhanced": ("table_name", "column_name"),
    "ucc_unary": ("table_name", "column_name"),
    "ind": ("-distinct_coverage", "-row_coverage", "-fk_non_null_rows", "-fk_distinct", *_FOUR),
    "scored": ("fk_table", "fk_column", "-score", "-distinct_coverage", "-row_coverage", "-name_sim", "pk_table", "pk_column"),
    "relationships": ("-score", "-distinct_coverage", "-row_coverage", *_FOUR),
    "rel_missing": _FOUR,
    "default_fk": (*_FOUR, "-cnt", "v"),
    "default_fk_summary": _FOUR,
    "ucc_composite": ("table_name", "k", "columns"),
    "surrogate_keys": ("-key_role", "-key_kind", "-confidence", "table_name", "column_name"),
    "duplicates_summary": ("check",),
}
#: Frames within a stage are ordered by those of these columns that they have.
_FIRST = ("table_name", "fk_table", "table_a", "fk_column", "column_a", "pk_table", "table_b", "pk_column", "column_b", "column_name", "place", "signature", "id_column", "left_column", "right_column", "left_value", "right_value", "priority", "columns")
#: Families of inferred types.
_FAMILY = {"int": "int", "float": "float", "bool": "bool", "date": "datetime"}
IMPLIED = {"recommendations": ("rel_missing", "duplicates", "default_fk", "surrogate_keys", "ucc_composite")}


class EngineError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse_stages(text: str | None) -> list[str]:
    """A comma list of stages, without repeats, and with the stages that others imply; relationships if there is none."""
    names = list(dict.fromkeys(s.strip() for s in (text or "relationships").split(",") if s.strip())) or ["relationships"]
    if unknown := [s for s in names if s not in STAGES]:
        raise EngineError("UNKNOWN_STAGE", f"unknown stages: {', '.join(unknown)}")
    return list(dict.fromkeys([*names, *(i for s in names for i in IMPLIED.get(s, ()))]))


class Engine:
    """Stages are worked out when first used and kept. Frequencies are persisted: profiles and inclusions both read them.

    Frames with a row per column or per relationship are collected and made anew, so that plans that build on them stay small. With ``infer_types`` text columns
    take the family of the type that their values show. With a ``store`` frequencies are kept by the tables' contents: tables that haven't changed aren't read again.
    """

    def __init__(self, catalog: Catalog, config: EngineConfig | None = None, mode: str = "strict", nulls: str = "sql", infer_types: bool = False, store: FrequencyStore | None = None):
        if mode not in ("strict", "soft"):
            raise EngineError("INVALID_PARAM_COMBO", f"unknown mode {mode}")
        self.catalog, self.config, self.mode, self.infer_types = catalog, config or EngineConfig(), mode, infer_types
        self.clean, self.nulls, self.store = {"sql": sql_clean, "memory": memory_clean}[nulls], nulls, store
        self.seconds: dict[str, float] = {}

    def _small(self, df: DataFrame) -> DataFrame:
        """A frame with a row per column or relationship, without its lineage."""
        return self.catalog.spark.createDataFrame(df.toArrow(), df.schema)

    @cached_property
    def _counted(self) -> DataFrame:
        if self.store:
            return self.store.frequencies(self.catalog.tables, self.clean, self.nulls).persist(StorageLevel.MEMORY_AND_DISK)
        return frequencies(self.catalog.tables, self.clean).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def _types(self) -> DataFrame:
        """Inferred types, a row per column."""
        return self._small(profile.decide_types(profile.type_ratios(self._counted)).select("table_name", "column_name", "atomic_type", "atomic_prob"))

    @cached_property
    def freq(self) -> DataFrame:
        if not self.infer_types:
            return self._counted
        known = F.create_map(*(F.lit(x) for kv in _FAMILY.items() for x in kv))
        types = self._types.select("table_name", "column_name", F.try_element_at(known, F.col("atomic_type")).alias("shown"))
        typed = self._counted.join(F.broadcast(types), ["table_name", "column_name"], "left")  # a row per column
        return typed.withColumn("family", F.when(F.col("family") == "string", F.coalesce("shown", "family")).otherwise(F.col("family"))).select(*self._counted.columns)

    @cached_property
    def profiles(self) -> DataFrame:
        p = self._small(profile.with_empty_tables(self._small(profile.profile(self.freq)), self.catalog.tables))
        return self._small(profile.with_health(keys.apply_pruning(p, keys.prune(p, self.config.prune))))

    @cached_property
    def profiles_enhanced(self) -> DataFrame:
        """Profiles with inferred types, statistics of numbers and dates, continuity, completeness, consistency and quality."""
        told = self._small(statistics.enhanced_statistics(self.freq, self.profiles, str(date.today())))
        return self._small(profile.enhanced(told, profile.consistency(self.freq)).join(self._types, ["table_name", "column_name"], "left"))

    @cached_property
    def ucc_unary(self) -> DataFrame:
        return keys.unary_ucc(self.profiles)

    @cached_property
    def _soft(self) -> tuple[DataFrame, DataFrame]:
        return inclusion.soft_inclusions(self.freq, self.profiles, self.ucc_unary, self.config.soft)

    @cached_property
    def ind(self) -> DataFrame:
        if self.mode == "soft":
            return self._small(self._soft[0])
        return self._small(inclusion.strict_inclusions(self.freq, self.profiles, self.ucc_unary, self.config.strict))

    @property
    def rejects(self) -> DataFrame:
        """Pairs that soft mode tested and turned down, with reasons."""
        return self._soft[1]

    @cached_property
    def scored(self) -> DataFrame:
        return selection.score(self.ind.drop("name_sim"), self.config.score)

    @cached_property
    def edges(self) -> DataFrame:
        return self._small(selection.select_edges(self.scored, self.profiles, self.config.select))

    @cached_property
    def _edge_list(self) -> list[dict]:
        return [r.asDict() for r in self.edges.collect()]  # as many as foreign keys, three each at most

    @cached_property
    def rel_missing(self) -> DataFrame | None:
        return self._small(quality.missing_for_edges(self.catalog.tables, self._edge_list, self.config.missing, self.clean)) if self._edge_list else None

    @cached_property
    def duplicates(self) -> dict[str, DataFrame]:
        links: dict[str, list[str]] = {}
        for e in self._edge_list:
            links.setdefault(e["fk_table"], []).append(e["fk_column"])
        return quality.duplicate_checks(self.catalog.tables, self.freq, self.profiles, links)

    @cached_property
    def default_fk(self) -> DataFrame | None:
        """The most frequent values of each foreign key; the table's other id columns are its partners, and the parent's columns named in the settings may call a row a dummy."""
        ids: dict[str, list[str]] = {}
        for r in self.profiles.where(id_like(F.col("column_name"))).select("table_name", "column_name").orderBy("column_name").collect():  # a row per column
            ids.setdefault(r[0], []).append(r[1])
        out = None
        for e in self._edge_list:
            child, parent = self.catalog.tables[e["fk_table"]], self.catalog.tables[e["pk_table"]]
            partners, labels = tuple(c for c in ids.get(e["fk_table"], []) if c != e["fk_column"]), tuple(c for c in self.config.defaults.parent_labels if c in parent.columns)
            r = quality.default_keys(child, e["fk_column"], parent, e["pk_column"], partners, labels, self.config.defaults, self.clean)
            if "dummy_parent" not in r.columns:
                r = r.withColumn("dummy_parent", F.lit(None).cast("boolean"))
            r = r.select(*(F.lit(e[c]).alias(c) for c in _FOUR), "*")
            out = r if out is None else out.unionByName(r)
        return None if out is None else self._small(out)  # a few values a relationship

    @cached_property
    def default_fk_summary(self) -> DataFrame | None:
        """Per relationship how many values are flagged, and the most frequent value with its signs."""
        if self.default_fk is None:
            return None
        top = F.max_by(F.struct("v", "ratio", "reasons"), F.struct("ratio", "cnt"))
        return self.default_fk.groupBy(*_FOUR).agg(F.count_if("flagged").alias("flagged_values"), top.alias("top")).select(*_FOUR, "flagged_values", "top.*")

    @cached_property
    def _uuids(self) -> DataFrame:
        return self._small(keys.uuid_like(self.freq))

    @cached_property
    def surrogate_keys(self) -> DataFrame:
        return self._small(keys.surrogate_keys(self.profiles, self._uuids, self.ucc_unary, self.edges))

    @cached_property
    def duplicates_summary(self) -> DataFrame:
        """How many rows each duplicate check has, without the rows."""
        parts = [d.groupBy().agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("check"), "n_rows") for n, d in self.duplicates.items()]
        return self._small(reduce(DataFrame.unionByName, parts))

    @cached_property
    def surrogate_keys_summary(self) -> DataFrame:
        return self.surrogate_keys.agg(F.count("*").alias("candidates"), F.count_if(F.col("key_kind") == "surrogate").alias("flagged_surrogate"))

    @cached_property
    def ucc_composite(self) -> DataFrame:
        """Composite keys of all tables: table_name, columns, k, ucc_type, n_rows_used, unique_ratio, null_ratio."""
        sizes: dict[str, dict[str, int]] = {}
        for r in self.profiles.select("table_name", "column_name", "n_unique").collect():  # a row per column
            sizes.setdefault(r[0], {})[r[1]] = r[2]
        out = []
        for t in self.catalog.list_tables():
            fks = tuple(e["fk_column"] for e in self._edge_list if e["fk_table"] == t)
            found = composite.search(self.catalog.tables[t], keys.composite_candidates(self.profiles, t, fks, self.config.composite_columns), distinct=sizes.get(t)).found
            out += [(t, list(f.columns), len(f.columns), "composite", f.rows, f.unique_ratio, f.null_ratio) for f in found]
        return self.catalog.spark.createDataFrame(out, "table_name string, columns array<string>, k int, ucc_type string, n_rows_used long, unique_ratio double, null_ratio double")

    @cached_property
    def recommendations(self) -> dict[str, DataFrame]:
        pks = self._small(recommend.primary_keys(self.ucc_unary, self.profiles, self.edges))
        missing = self.rel_missing if self.rel_missing is not None else self.edges.withColumn("orphan_fk_ratio", F.lit(None).cast("double"))
        fks = self._small(recommend.foreign_keys(self.edges, missing))
        comps = self._small(recommend.composite_keys(self.ucc_composite))
        return {"primary_key": pks, "foreign_keys": fks, "composite_keys": comps, "datatypes": recommend.datatypes(self.profiles, self._uuids), "indexes": recommend.indexes(pks, fks, comps, self.profiles)}

    def recommendation_tree(self) -> dict:
        """The recommendations of all tables as one document."""
        rows = {r[0]: r[1] for r in self.profiles.groupBy("table_name").agg(F.max("n_rows")).collect()}  # a row per table
        found = recommend.records(self.recommendations, self.catalog.list_tables())
        return recommend.schema_document(found, {t: rows.get(t, 0) for t in self.catalog.list_tables()}, datetime.now(UTC).isoformat(timespec="seconds"))

    def stage(self, name: str):
        return getattr(self, {"relationships": "edges"}.get(name, name))

    def run(self, stages: str | None = None, max_rows: int = 500, dot: bool = False) -> dict:
        """Payloads of stages: rows as records. A stage that fails doesn't stop the others."""
        out: dict = {"stages": {}, "mode": self.mode}
        for name in parse_stages(stages):
            began = time.time()
            try:
                got = self.stage(name)
                out["stages"][name] = {"status": "ok", "data": self._payload(got, max_rows, ORDER.get(name, ()))} if got is not None else {"status": "NOT_COMPUTED"}
            except Exception as e:  # noqa: BLE001
                out["stages"][name] = {"status": "STAGE_FAILED", "message": str(e)[:500]}
            self.seconds[name] = round(time.time() - began, 4)
        if "relationships" in out["stages"]:
            out["summary"] = selection.relationship_summary(self.edges).first().asDict()
            if dot:
                out["dot"] = viz.to_dot(self.edges)
        out["runtime_sec"] = self.seconds
        return out

    def _payload(self, got, n: int, order: tuple[str, ...] = ()):
        if isinstance(got, DataFrame):
            by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order if c.lstrip("-") in got.columns]
            return [r.asDict(recursive=True) for r in json_safe(got.orderBy(*by) if by else got).limit(n).collect()]
        if isinstance(got, dict):
            return {k: self._payload(v, n, ORDER.get(k, tuple(c for c in _FIRST if c in v.columns))) for k, v in got.items()}
        return got[:n]

    def close(self) -> None:
        if "_counted" in self.__dict__:
            self._counted.unpersist()
