"""Recommendations from profiles and edges: keys, foreign keys, datatypes and indexes; and the document that holds them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOUR = ["fk_table", "fk_column", "pk_table", "pk_column"]


def _codes(*rules) -> Column:
    return F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))


def primary_keys(ucc: DataFrame, profiles: DataFrame, edges: DataFrame, alternatives: int = 3) -> DataFrame:
    """Per table the best unary key (place 1) and its alternatives, with scores and reasons. Ties go to the first column by name."""
    p = ucc.select("table_name", "column_name").join(profiles, ["table_name", "column_name"])
    refs = edges.groupBy(F.col("pk_table").alias("table_name"), F.col("pk_column").alias("column_name")).agg(F.count("*").alias("refs"))
    p = p.join(refs, ["table_name", "column_name"], "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    whole = F.col("dtype_family") == "int"
    score = 0.65 * F.col("unique_ratio_non_null") + 0.25 * (1 - F.col("null_ratio")) + F.when(whole, 0.10).otherwise(0.0)
    p = p.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 6))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("confidence"), "column_name"))).where(F.col("place") <= 1 + alternatives)
    reasons = _codes((F.col("unique_ratio_non_null") >= 0.999, "pk_unique_high"), (F.col("null_ratio") <= 0.01, "pk_null_low"), (whole, "pk_dtype_numeric"), ((F.col("refs") > 0) & (F.col("place") == 1), "pk_referenced_by_fks"))
    return p.select("table_name", "column_name", "place", "confidence", "refs", reasons.alias("reason_codes"))


def orphan_ratios(edges: DataFrame) -> DataFrame:
    """Per edge of a strict inclusion orphan_fk_ratio: the share of rows without a parent. The inclusion has counted all of the child's rows and those that meet a parent, so no table is read again."""
    rows = F.col("fk_non_null_rows")
    return edges.select(*_FOUR, F.coalesce(F.try_divide(rows - F.col("matched_rows"), rows), F.lit(0.0)).alias("orphan_fk_ratio"))


def foreign_keys(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """Per edge a foreign key, blocked if 5 % or more of its rows have no parent."""
    e = edges.join(missing.select(*_FOUR, "orphan_fk_ratio"), _FOUR, "left")
    bad = F.coalesce(F.col("orphan_fk_ratio") >= 0.05, F.lit(False))
    reasons = _codes((F.col("score") >= 0.90, "fk_score_high"), (F.col("distinct_coverage") >= 0.90, "fk_inclusion_high"), (F.col("orphan_fk_ratio") < 0.05, "fk_missing_parent_low"))
    return e.select(*_FOUR, F.when(bad, "blocked").otherwise("recommended").alias("status"), F.round("score", 6).alias("confidence"), reasons.alias("reason_codes"), _codes((bad, "fk_missing_parent_high")).alias("blockers"))


def composite_keys(found: DataFrame, alternatives: int = 3) -> DataFrame:
    """The best composite keys of each table, 1 + ``alternatives`` at most: ``found`` has table_name, columns, unique_ratio and null_ratio, as counted on all rows. Ties go to fewer, then to the first columns by name."""
    score = F.round(F.least(F.lit(1.0), 0.7 * F.col("unique_ratio") + 0.3 * (1 - F.col("null_ratio"))), 6)
    scored = found.withColumn("confidence", score)
    best = Window.partitionBy("table_name").orderBy(F.desc("confidence"), F.size("columns"), "columns")
    kept = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 1 + alternatives)
    return kept.select("table_name", "columns", "confidence", "unique_ratio", "null_ratio", _codes((F.col("unique_ratio") >= 0.999, "composite_unique_high")).alias("reason_codes"))


def datatypes(profiles: DataFrame, uuids: DataFrame | None = None) -> DataFrame:
    """A database type for each column, with confidence, reason, and what a smaller type would risk: blocked_alternative (null or db_type, confidence, blocker, low, high). ``uuids`` (table_name, column_name, uuid_like) tells which text columns hold UUIDs."""
    if uuids is None:
        profiles = profiles.withColumn("uuid_like", F.lit(False))
    else:
        profiles = profiles.join(uuids.select("table_name", "column_name", "uuid_like"), ["table_name", "column_name"], "left")
    f, lo, hi, most = F.col("dtype_family"), F.col("int_min"), F.col("int_max"), F.coalesce("max_len", F.lit(0.0)).cast("int")
    ranged = (f == "int") & lo.isNotNull() & hi.isNotNull()
    rules = [
        ((f == "string") & F.coalesce("uuid_like", F.lit(False)), F.lit("UUID"), 0.95, "dtype_uuid_regex"),
        (f == "bool", F.lit("BOOLEAN"), 0.90, "dtype_bool_pattern"),
        (f == "datetime", F.lit("TIMESTAMP"), 0.85, "dtype_date_parse_high"),
        (ranged & (lo >= -32768) & (hi <= 32767), F.lit("SMALLINT"), 0.85, "dtype_int_range_small"),
        (ranged & (lo >= -2147483648) & (hi <= 2147483647), F.lit("INT"), 0.90, "dtype_int_range_small"),
        (ranged, F.lit("BIGINT"), 0.92, "dtype_int_range_big"),
        ((f == "int") & F.lower("column_name").contains("id"), F.lit("BIGINT"), 0.75, "dtype_int_id_heuristic"),
        (f == "int", F.lit("INT"), 0.70, "dtype_int_no_range_default"),
        (f == "float", F.lit("DECIMAL(10,2)"), 0.70, "dtype_decimal_like"),
        (most >= 1000, F.lit("TEXT"), 0.85, "dtype_text_long"),
        ((most > 0) & (most <= 5) & (F.col("unique_ratio") < 0.2), F.concat(F.lit("CHAR("), most.cast("string"), F.lit(")")), 0.65, "dtype_varchar_length_fit"),
        (most > 0, F.concat(F.lit("VARCHAR("), F.least(most, F.lit(255)).cast("string"), F.lit(")")), 0.75, "dtype_varchar_length_fit"),
    ]
    kind, conf, why = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2]), F.when(rules[0][0], rules[0][3])
    for c, t, n, r in rules[1:]:
        kind, conf, why = kind.when(c, t), conf.when(c, n), why.when(c, r)
    risk = F.struct(F.lit("INT").alias("db_type"), F.lit(0.40).alias("confidence"), F.lit("int_overflow_risk").alias("blocker"), lo.alias("low"), hi.alias("high"))
    beyond = ranged & ((lo < -2147483648) | (hi > 2147483647))
    return profiles.select("table_name", "column_name", kind.otherwise("TEXT").alias("db_type"), conf.otherwise(0.50).alias("confidence"), why.alias("reason_code"), F.when(beyond, risk).alias("blocked_alternative"))


def indexes(pks: DataFrame, fks: DataFrame, composites: DataFrame | None, profiles: DataFrame) -> DataFrame:
    """Indexes to make and to avoid."""
    row = lambda df, t, c, p, r, conf, kind="recommended": df.select(F.col(t).alias("table_name"), c.alias("columns"), F.lit(p).alias("priority"), F.lit(r).alias("reason_code"), conf.alias("confidence"), F.lit(kind).alias("status"))
    out = row(pks.where("place = 1"), "table_name", F.col("column_name"), "HIGH", "idx_primary_key", F.lit(0.95))
    out = out.unionByName(row(fks.where("status = 'recommended'"), "fk_table", F.col("fk_column"), "HIGH", "idx_foreign_key", F.col("confidence")))
    if composites is not None:
        out = out.unionByName(row(composites, "table_name", F.array_join("columns", ","), "MEDIUM", "idx_composite_key", F.col("confidence")))
    long = F.coalesce("max_len", F.lit(0.0)) >= 1000
    out = out.unionByName(row(profiles.where(long), "table_name", F.col("column_name"), "AVOID", "idx_text_avoid", F.lit(0.85), "info"))
    return out.unionByName(row(profiles.where(~long & (F.col("n_rows") >= 1000) & (F.col("unique_ratio") <= 0.01)), "table_name", F.col("column_name"), "AVOID", "idx_low_cardinality_avoid", F.lit(0.70), "info"))


def document(parts: dict[str, DataFrame]) -> DataFrame:
    """(table_name, section, items): the recommendations of each table as JSON, a row per section. They are as many as the columns."""
    out = None
    for name, df in parts.items():
        t = next(c for c in ("table_name", "fk_table") if c in df.columns)
        g = df.groupBy(F.col(t).alias("table_name")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("items")).select("table_name", F.lit(name).alias("section"), "items")
        out = g if out is None else out.unionByName(g)
    return out


def to_json(parts: dict[str, DataFrame], tables: list[str]) -> str:
    """The document as one text. Constraints stay empty: no check derives any."""
    tree: dict = {t: {"constraints": []} for t in tables}
    for r in document(parts).collect():  # a row per table and section
        tree.setdefault(r["table_name"], {"constraints": []})[r["section"]] = json.loads(r["items"])
    return json.dumps({"tables": tree}, sort_keys=True)


#: What is done to values before keys are compared, and to numbers before they are typed.
KEY_NORMALISATION, NUMERIC_COERCION = ("trim_whitespace", "casefold_strings"), ("numeric_coercion",)
POLICY = {"null_tokens_mapped": ["", "null", "none", "n/a", "na"], "trim_whitespace": True, "casefold_strings": True, "remove_punctuation": False}
_RECORD = ("table_name", "decision", "item", "status", "confidence", "reason_codes", "blockers", "applied", "alternatives")


def records(parts: dict[str, DataFrame], tables: list[str]) -> DataFrame:
    """One row per recommendation: table_name, decision, item, status, confidence, reason_codes, blockers, applied (what is disclosed of normalisation), alternatives (name, confidence, blocker).

    ``parts`` has the frames of primary_key, foreign_keys, composite_keys, datatypes and indexes, or some of them. A table without a primary key gets one of status info.
    """
    none, option = F.array().cast("array<string>"), "array<struct<name:string,confidence:double,blocker:string>>"
    out: list[DataFrame] = []

    def add(df: DataFrame, decision: str, **of) -> None:
        of = {"table_name": F.col("table_name"), "decision": F.lit(decision), "status": F.lit("recommended"), "confidence": F.col("confidence"), "reason_codes": none, "blockers": none, "applied": none, "alternatives": F.array().cast(option), **of}
        out.append(df.select(*(of[c].alias(c) for c in _RECORD)))

    words = lambda ws: F.array(*map(F.lit, ws))
    if pks := parts.get("primary_key"):
        others = pks.where("place > 1").groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("place", F.col("column_name").alias("name"), "confidence"))).alias("o"))
        best = pks.where("place = 1").join(others, "table_name", "left")
        runners = F.transform(F.coalesce("o", F.array().cast("array<struct<place:int,name:string,confidence:double>>")), lambda o: F.struct(o["name"].alias("name"), o["confidence"].alias("confidence"), F.lit(None).cast("string").alias("blocker")))
        add(best, "PRIMARY_KEY", item=F.col("column_name"), reason_codes=F.col("reason_codes"), applied=words(KEY_NORMALISATION), alternatives=runners.cast(option))
        bare = pks.sparkSession.createDataFrame([(t,) for t in tables], "table_name string").join(pks.select("table_name").distinct(), "table_name", "left_anti")
        add(bare, "PRIMARY_KEY", item=F.lit(""), status=F.lit("info"), confidence=F.lit(0.0), applied=words(KEY_NORMALISATION))
    if fks := parts.get("foreign_keys"):
        add(fks, "FOREIGN_KEY", table_name=F.col("fk_table"), item=F.concat("fk_column", F.lit(" -> "), "pk_table", F.lit("."), "pk_column"), status=F.col("status"), reason_codes=F.col("reason_codes"), blockers=F.col("blockers"))
    if comps := parts.get("composite_keys"):
        add(comps, "COMPOSITE_KEY", item=F.array_join("columns", ","), reason_codes=F.col("reason_codes"))
    if types := parts.get("datatypes"):
        blocked = F.col("blocked_alternative")
        risky = F.when(blocked.isNotNull(), F.array(F.struct(blocked["db_type"].alias("name"), blocked["confidence"].alias("confidence"), blocked["blocker"].alias("blocker")))).otherwise(F.array().cast(option))
        add(types, "DATATYPE", item=F.concat("column_name", F.lit(": "), "db_type"), reason_codes=F.array_compact(F.array("reason_code")), applied=F.when(blocked.isNotNull(), words(NUMERIC_COERCION)).otherwise(none), alternatives=risky)
    if idx := parts.get("indexes"):
        add(idx, "INDEX", item=F.concat("priority", F.lit(": "), "columns"), status=F.col("status"), reason_codes=F.array("reason_code"))
    return reduce(DataFrame.unionByName, out)


def schema_document(found: DataFrame, row_counts: dict[str, int], generated_at: str) -> dict:
    """The tree of all tables' ``records``: structure, constraints, datatypes and performance, with what is disclosed. It has a node for each key, reference, column and index."""
    tree = {t: {"table_name": t, "row_count": n, "structure": {"primary_key": None, "composite_keys": [], "foreign_keys": [], "surrogate_key": None}, "constraints": {"recommended": [], "blocked": []}, "datatypes": {"columns": []}, "performance": {"indexes": []}, "notes": []} for t, n in row_counts.items()}
    for r in found.orderBy("table_name", "decision", F.desc("confidence"), "item").collect():
        t, record = tree[r["table_name"]], {k: v for k, v in r.asDict(recursive=True).items() if k != "table_name"}
        record["normalisation_disclosure"] = {"applied": record.pop("applied"), "notes": ""}
        if r["decision"] == "PRIMARY_KEY":
            t["structure"]["primary_key"] = record
        else:
            {"FOREIGN_KEY": t["structure"]["foreign_keys"], "COMPOSITE_KEY": t["structure"]["composite_keys"], "DATATYPE": t["datatypes"]["columns"], "INDEX": t["performance"]["indexes"]}[r["decision"]].append(record)
    return {"meta": {"generated_at": generated_at}, "normalisation_policy": POLICY, "tables": [tree[t] for t in sorted(tree)], "global_warnings": []}
