"""Unary and composite unique columns, pruning, and surrogate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BAD_REFERENCE_PARTS, MEASURE_PARTS, PruneConfig
from ..functions.names import business_hint, descriptive, ends_in_id, has_part, has_token, name_tokens, natural_hint, surrogate_hint
from .composite import search, unique_combinations  # noqa: F401


def unary_ucc(profiles: DataFrame, unique_ratio_min: float = 1.0, null_ratio_max: float = 0.0) -> DataFrame:
    """Unique columns; with relaxed thresholds also those that come near."""
    ok = F.col("is_unary_ucc")
    if unique_ratio_min < 1.0 or null_ratio_max > 0.0:
        ok = ok | ((F.col("unique_ratio_non_null") >= unique_ratio_min) & (F.col("null_ratio") <= null_ratio_max) & (F.col("n_non_null") > 0))
    return profiles.where(ok).select("table_name", "column_name", "dtype_family", "n_rows", "n_unique", "unique_ratio", "null_ratio", F.lit("unary").alias("ucc_type"))


def prune(profiles: DataFrame, cfg: PruneConfig = PruneConfig()) -> DataFrame:
    """Adds to each column whether it is rejected as a key, hints from its name and contents, and the reasons."""
    t = F.col("name_tokens")
    avg, most = F.coalesce("avg_len", F.lit(0.0)), F.coalesce("max_len", F.lit(0.0))
    p = profiles.withColumn("name_tokens", name_tokens(F.col("column_name")))
    key, measure, date, negative, payload = (has_token(t, w) for w in (cfg.key_tokens, cfg.measure_tokens, cfg.date_tokens, cfg.negative_tokens, cfg.payload_tokens))
    string = F.col("dtype_family") == "string"
    long_text = string & ((avg >= cfg.long_avg) | (most >= cfg.long_max) | ((avg >= 60.0) & (most >= 1000)))
    encoded = payload & ((avg >= 80) | (most >= 200)) & (F.col("unique_ratio_non_null") >= 0.90) & ~key
    small = (F.col("n_unique") > 0) & (F.col("n_unique") <= cfg.small_domain)
    rejects = [
        (F.col("n_non_null") == 0, "all_null"),
        (F.col("null_ratio") >= cfg.null_ratio, "too_many_nulls"),
        (F.col("top1_ratio") >= cfg.top1_ratio, "single_value_dominated"),
        (F.col("dtype_family") == "bool", "boolean_like"),
        (long_text, "free_text_like"),
        (measure & ~key, "measure_like_name"),
        (date & ~key, "date_like_name"),
        (encoded, "encoded_payload_like"),
        (negative & ~key & string & (avg >= 30.0), "negative_name_hint"),
    ]
    reject = reduce(lambda a, b: a | b, (c for c, _ in rejects))
    bad = F.array_compact(F.array(*(F.when(c, n) for c, n in rejects)))
    good = F.array_compact(F.array(F.when(key, "key_name_hint"), F.when(small, "small_domain")))
    reasons = F.when(reject, bad).when(F.size(good) > 0, good).otherwise(F.array(F.lit("keep")))
    return p.select("table_name", "column_name", reject.alias("reject"), key.alias("key_name_hint"), small.alias("small_domain"), encoded.alias("looks_encoded_payload"), long_text.alias("looks_free_text"), measure.alias("looks_measure_like"), t, reasons.alias("reasons"))


def apply_pruning(profiles: DataFrame, pruned: DataFrame) -> DataFrame:
    """Profiles with the flags of ``prune``; columns it doesn't know aren't rejected."""
    flags = ["reject", "key_name_hint", "small_domain", "looks_encoded_payload", "looks_free_text", "looks_measure_like"]
    out = profiles.join(pruned.select("table_name", "column_name", *flags, "reasons"), ["table_name", "column_name"], "left")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def composite_candidates(profiles: DataFrame, table: str, fk_columns: tuple[str, ...] = (), most: int | None = None, min_distinct: int = 10) -> list[str]:
    """Columns that may be part of a composite key of a table: foreign keys first, then in the table's order; all of them, or the first ``most``."""
    p = profiles.where((F.col("table_name") == table) & (F.col("n_null") == 0) & (F.col("n_unique") >= min_distinct) & ~F.col("is_unary_ucc"))
    p = p.where("dtype_family <> 'float' and (dtype_family <> 'string' or avg_len <= 40)").where(~has_part(F.col("column_name"), MEASURE_PARTS))
    p = p.orderBy(F.col("column_name").isin(list(fk_columns) or [""]).desc(), "ordinal").select("column_name")
    return [r[0] for r in (p.limit(most) if most else p).collect()]


def composite_ucc(df: DataFrame, columns: list[str], max_k: int = 3) -> list[tuple[str, ...]]:
    """Minimal unique column sets of two to ``max_k`` columns."""
    return [f.columns for f in search(df, columns, max_k).found]


def uuid_like(freq: DataFrame, share: float = 0.95) -> DataFrame:
    """(table_name, column_name, uuid_like): whether nearly all cells are UUIDs."""
    hit = F.col("v").rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")
    g = freq.where("v is not null").groupBy("table_name", "column_name").agg((F.sum(F.when(hit, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("s"))
    return g.select("table_name", "column_name", (F.col("s") >= share).alias("uuid_like"))


def reliable(edges: DataFrame, min_score: float = 0.95, min_sim: float = 0.30) -> DataFrame:
    """Edges that count as references to a key."""
    both = ends_in_id(F.col("fk_column")) & ends_in_id(F.col("pk_column"))
    measure = has_part(F.col("fk_column"), BAD_REFERENCE_PARTS) & ~ends_in_id(F.col("fk_column"))
    return edges.where((F.col("score") >= min_score) & ((F.col("name_sim") >= min_sim) | both) & ~measure)


def surrogate_keys(profiles: DataFrame, uuids: DataFrame, ucc: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Near-unique columns with a confidence that they are surrogate keys, their kind and role. ``edges`` are selected relationships."""
    strict = (F.col("unique_ratio") >= 0.999) & (F.col("null_ratio") <= 0.01)
    near = (F.col("unique_ratio") >= 0.98) & (F.col("null_ratio") <= 0.05)
    two = ["table_name", "column_name"]
    p = profiles.withColumn("strict", strict).where(strict | near).join(uuids, two, "left")
    if edges is not None:
        refs = reliable(edges).groupBy(F.col("pk_table").alias("table_name"), F.col("pk_column").alias("column_name")).agg(F.count("*").alias("refs"))
        p = p.join(refs, two, "left")
    else:
        p = p.withColumn("refs", F.lit(None).cast("long"))
    others = ucc.where(~F.lower("column_name").rlike("^id$|_id$")).groupBy("table_name").agg(F.collect_set(F.lower("column_name")).alias("others"))
    p = p.join(others, "table_name", "left")
    name, string = F.col("column_name"), F.col("dtype_family") == "string"
    span = F.when((F.col("dtype_family") == "int") & F.col("int_min").isNotNull(), F.col("n_unique") / (F.col("int_max") - F.col("int_min") + 1).cast("double"))
    other = F.coalesce(F.size(F.array_except("others", F.array(F.lower("column_name")))) > 0, F.lit(False))
    p = p.withColumns({"refs": F.coalesce("refs", F.lit(0)), "continuity": span, "hint": surrogate_hint(name), "natural": natural_hint(name), "descriptive": descriptive(name), "uuid_like": F.coalesce("uuid_like", F.lit(False)) & string, "other": other})
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    wordy = F.col("descriptive") & (F.col("refs") == 0) & (F.col("hint") == 0) & ~F.col("uuid_like")
    conf = 0.50 + flag(F.col("uuid_like"), 0.25) + flag(F.coalesce(F.col("continuity") >= 0.8, F.lit(False)), 0.15) + flag(F.col("refs") >= 2, 0.15) + flag(F.col("other"), 0.10) + F.least(F.lit(0.10), 0.10 * F.col("hint")) - 0.20 * F.col("natural") - flag(wordy, 0.20)
    p = p.withColumn("conf", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 9))
    surrogate = (F.col("conf") >= 0.75) & F.col("strict") & ~F.col("descriptive")
    kind = F.when(surrogate, "surrogate").when(~F.col("strict") & business_hint(name), "business_key").otherwise("key_candidate")
    role = F.when(F.col("refs") > 0, "pk_candidate").otherwise("key_candidate")
    return p.select("table_name", "column_name", role.alias("key_role"), kind.alias("key_kind"), F.round("conf", 3).alias("confidence"), "uuid_like", "refs", F.col("other").alias("alt_natural_key"), F.round("continuity", 3).alias("continuity"))
