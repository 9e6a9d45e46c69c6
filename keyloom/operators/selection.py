"""Scores of inclusion dependencies, and the edges selected by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScoreConfig, SelectConfig
from ..functions.names import ends_in_id, has_part, name_similarity


def range_penalty(small: int = 2000) -> Column:
    """How much wider the parent's range is than the child's: 0 to 0.95, less for children with many distinct values."""
    fk, pk = (F.greatest(F.lit(1.0), (F.col(f"{s}_max") - F.col(f"{s}_min") + 1).cast("double")) for s in ("fk", "pk"))
    wide = F.log10(F.greatest(F.lit(1.0), pk / fk))
    p = F.least(F.lit(0.95), wide / (1 + wide)) * F.least(F.lit(1.0), F.lit(float(small)) / F.greatest(F.lit(1.0), F.col("fk_distinct").cast("double")))
    known = F.col("fk_min").isNotNull() & F.col("fk_max").isNotNull() & F.col("pk_min").isNotNull() & F.col("pk_max").isNotNull()
    return F.when(known, p).otherwise(0.0)


def small_domain_penalty() -> Column:
    return F.when((F.col("fk_distinct") <= 30) & (F.col("distinct_coverage") >= 0.95) & (F.col("name_sim") < 0.30), 1.0).otherwise(0.0)


def measure_penalty(cfg: ScoreConfig = ScoreConfig()) -> Column:
    """1 for a measure-like column whose small values all happen to be among a key's."""
    bad = has_part(F.col("fk_column"), cfg.measure_parts) & ~ends_in_id(F.col("fk_column")) & ends_in_id(F.col("pk_column"))
    small = (F.col("fk_max") <= 500) & (F.col("fk_distinct") <= 500)
    return F.when(bad & F.coalesce(small, F.lit(False)) & (F.col("distinct_coverage") >= 0.99) & (F.col("row_coverage") >= 0.99), 1.0).otherwise(0.0)


def score(inclusions: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Adds name_sim, the penalties, and score (0 to 1)."""
    if min(cfg.distinct, cfg.row, cfg.name, cfg.range, cfg.small_domain, cfg.measure) < 0:
        raise ValueError("weights must not be negative")
    out = inclusions.withColumn("name_sim", name_similarity(F.col("fk_column"), F.col("pk_column")))
    out = out.withColumns({"range_penalty": range_penalty(), "small_domain_penalty": small_domain_penalty(), "measure_penalty": measure_penalty(cfg)})
    total = cfg.distinct * F.col("distinct_coverage") + cfg.row * F.col("row_coverage") + cfg.name * F.col("name_sim") - cfg.range * F.col("range_penalty") - cfg.small_domain * F.col("small_domain_penalty") - cfg.measure * F.col("measure_penalty")
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def select_edges(scored: DataFrame, profiles: DataFrame, cfg: SelectConfig = SelectConfig()) -> DataFrame:
    """The best parents of each foreign key, with cardinality and optionality. Ties go to the first parent by name."""
    w = Window.partitionBy("fk_table", "fk_column").orderBy(F.desc("score"), F.desc("distinct_coverage"), F.desc("row_coverage"), F.desc("name_sim"), "pk_table", "pk_column")
    best = scored.where(F.col("score") >= cfg.min_score).withColumn("k", F.row_number().over(w)).where(F.col("k") <= cfg.max_edges_per_fk).drop("k")
    p = profiles.select(F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"), "null_ratio", "unique_ratio_non_null")
    out = best.join(p, ["fk_table", "fk_column"], "left")
    one = F.coalesce("unique_ratio_non_null", F.lit(0.0)) >= cfg.one_to_one_ratio
    name = F.concat("fk_table", F.lit("."), "fk_column", F.lit(" -> "), "pk_table", F.lit("."), "pk_column")
    out = out.withColumns({"relationship": name, "cardinality": F.when(one, "one_to_one").otherwise("many_to_one"), "optional": F.coalesce("null_ratio", F.lit(0.0)) >= cfg.optional_null_ratio})
    return out.drop("null_ratio", "unique_ratio_non_null")


def relationship_summary(edges: DataFrame) -> DataFrame:
    c, o = F.col("cardinality"), F.col("optional")
    return edges.agg(F.count("*").alias("total"), F.count_if(c == "many_to_one").alias("many_to_one"), F.count_if(c == "one_to_one").alias("one_to_one"), F.count_if(o).alias("optional"), F.count_if(~o).alias("required"))


def _first(df: DataFrame, top: int | None, *order) -> DataFrame:
    return df.orderBy(*order).limit(top) if top is not None else df


def pick_surrogates(found: DataFrame, only: bool = False, role: str | None = None, min_confidence: float = 0.0, top: int | None = None) -> DataFrame:
    """Of surrogate annotations those judged surrogate (if ``only``), of a role and confidence; the ``top`` most confident ones."""
    found = found.where(F.col("key_kind") == "surrogate") if only else found
    found = found.where(F.col("key_role") == role) if role else found
    return _first(found.where(F.col("confidence") >= min_confidence), top, F.desc("confidence"), "table_name", "column_name")


def pick_composites(found: DataFrame, table: str | None = None, k: int | None = None, min_coverage: float = 0.0, top: int | None = None) -> DataFrame:
    """Of composite keys those of a table, a width and a share of rows without nulls; the ``top`` narrowest ones."""
    found = found.where(F.col("table_name") == table) if table else found
    found = found.where(F.size("columns") == k) if k else found
    return _first(found.where(1 - F.col("null_ratio") >= min_coverage), top, F.size("columns"), "table_name", "columns")


def pick_edges(edges: DataFrame, relationships: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
    """Of selected edges those named (as ``a.x -> b.y``), and those between some tables only."""
    edges = edges.where(F.col("relationship").isin(relationships)) if relationships is not None else edges
    return edges.where(F.col("fk_table").isin(tables) & F.col("pk_table").isin(tables)) if tables is not None else edges
