"""Checks around relationships: orphans, parents without children, duplicates, overlaps, identity conflicts and default keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DefaultConfig, MissingConfig
from ..functions.names import id_like, natural_like
from ..functions.normalize import sql_clean, strip
from ..plans.cells import small
from ..plans.topk import examples, first_of_groups

Clean = Callable[[Column], Column]


def _counted(df: DataFrame, column: str, clean: Clean) -> DataFrame:
    return df.select(clean(F.col(f"`{column}`")).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("cnt"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, clean: Clean = sql_clean) -> DataFrame:
    """(v, cnt): values of a foreign key without a parent, and how many rows hold them."""
    return _counted(child, fk, clean).join(_counted(parent, pk, clean).select("v"), "v", "left_anti")


def childless(child: DataFrame, fk: str, parent: DataFrame, pk: str, clean: Clean = sql_clean) -> DataFrame:
    """(v): parents' keys that no child refers to."""
    return _counted(parent, pk, clean).select("v").join(_counted(child, fk, clean).select("v"), "v", "left_anti")


def relational_missing(child: DataFrame, fk: str, parent: DataFrame, pk: str, clean: Clean = sql_clean) -> DataFrame:
    """One row: rows and ratio of orphans, parents and ratio without children, and up to ten smallest examples of either. One full join of the distinct keys gives all."""
    c, p = _counted(child, fk, clean).withColumn("c", F.lit(1)), _counted(parent, pk, clean).select("v", F.lit(1).alias("p"))
    both = c.join(p, "v", "full").select("v", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.col("c").isNull().alias("no_child"), F.col("p").isNull().alias("no_parent"))
    kind = F.when(F.col("no_parent"), "orphan").when(F.col("no_child"), "childless").otherwise("both")
    both = both.withColumn("kind", kind)
    sums = both.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("fk_rows"),
        F.coalesce(F.sum(F.when(F.col("no_parent"), F.col("cnt"))), F.lit(0)).alias("orphan_fk_rows"),
        F.count_if(~F.col("no_parent")).alias("parents"),
        F.count_if(F.col("no_child")).alias("parents_missing_children"),
    )
    top = both.where("kind <> 'both'").withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("v"))).where("k <= 10")
    examples = top.groupBy().agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("v")))).alias(n) for k, n in (("orphan", "orphan_examples"), ("childless", "childless_examples"))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.crossJoin(examples).withColumns({"orphan_fk_ratio": ratio("orphan_fk_rows", "fk_rows"), "parents_missing_children_ratio": ratio("parents_missing_children", "parents")})


def classify_missing(result: DataFrame, edge: dict, cfg: MissingConfig = MissingConfig()) -> DataFrame:
    """Adds status, severity and likely causes. ``edge`` may hold optional, score, name_sim and range_penalty."""
    o, m = F.col("orphan_fk_ratio"), F.col("parents_missing_children_ratio")
    k = cfg.required_multiplier if edge.get("optional") is False else 1.0
    fail = (o >= cfg.orphan_fail * k) | (m >= cfg.childless_fail * k)
    warn = (o >= cfg.orphan_warn * k) | (m >= cfg.childless_warn * k)
    low = F.transform("orphan_examples", lambda v: F.lower(F.trim(v)))
    ints = F.transform("orphan_examples", lambda v: v.try_cast("double").try_cast("long"))
    sentinel = F.arrays_overlap(low, F.array(*map(F.lit, cfg.sentinel_texts))) | F.arrays_overlap(ints, F.array(*(F.lit(i).cast("long") for i in cfg.sentinel_ints)))
    less = lambda name, limit, worse: F.lit(edge.get(name) is not None and worse(float(edge[name]), limit))
    causes = [
        ((o > 0) & F.coalesce(sentinel, F.lit(False)), "sentinel_or_default_fk_values"),
        ((m > 0) & F.lit(bool(edge.get("optional"))), "relationship_optional_or_sparse_fk"),
        ((m > 0) & F.lit(not edge.get("optional")), "child_table_incomplete_or_filtered"),
        (o > 0, "type_or_format_mismatch_or_missing_parent_rows"),
        (less("score", 0.95, float.__lt__) & ((o > 0) | (m > 0)), "edge_may_be_wrong_or_accidental_match"),
        (less("name_sim", 0.2, float.__lt__) & (o > 0), "low_name_similarity_possible_false_positive"),
        (less("range_penalty", 0.5, float.__gt__) & (o > 0), "range_mismatch_possible_accidental_inclusion"),
    ]
    return result.withColumns({"status": F.when(fail, "fail").when(warn, "warning").otherwise("ok"), "severity": F.when(fail, "high").when(warn, "medium").otherwise("low"), "likely_causes": F.array_compact(F.array(*(F.when(c, n) for c, n in causes)))})


def missing_for_edges(tables: dict[str, DataFrame], edges: list[dict], cfg: MissingConfig = MissingConfig(), clean: Clean = sql_clean) -> DataFrame:
    """relational_missing and its class for each selected edge."""

    def of(e: dict) -> DataFrame:
        r = classify_missing(relational_missing(tables[e["fk_table"]], e["fk_column"], tables[e["pk_table"]], e["pk_column"], clean), e, cfg)
        return r.select(*(F.lit(e[c]).alias(c) for c in ("fk_table", "fk_column", "pk_table", "pk_column")), "*")

    return reduce(DataFrame.unionByName, map(of, edges))


def key_duplicates(freq: DataFrame, profiles: DataFrame, natural: bool = False, max_examples: int = 10) -> DataFrame:
    """Repeated values in key columns (id-like, nearly unique) or in natural keys (named so): rows after the first, their ratio, and the most repeated values."""
    name = F.col("column_name")
    wanted = natural_like(name) & (F.col("unique_ratio_non_null") >= 0.70) if natural else id_like(name) & (F.col("unique_ratio_non_null") >= 0.98)
    cols = profiles.where((F.col("n_non_null") >= 20) & wanted)
    again = freq.where("v is not null and cnt > 1").join(F.broadcast(cols.select("table_name", "column_name", "n_non_null")), ["table_name", "column_name"])
    two = ["table_name", "column_name"]
    g = again.groupBy(*two, "n_non_null").agg(F.sum(F.col("cnt") - 1).alias("duplicate_rows"), F.count("*").alias("duplicate_values"))
    # a filter on the rank lets each task keep its first ones only
    top = again.withColumn("k", F.row_number().over(Window.partitionBy(*two).orderBy(F.desc("cnt"), "v"))).where(F.col("k") <= max_examples)
    g = g.join(top.groupBy(*two).agg(F.sort_array(F.collect_list(F.struct("k", "v", "cnt"))).alias("examples")), two)
    return g.select(*two, "duplicate_rows", "duplicate_values", F.round(F.col("duplicate_rows") / F.col("n_non_null"), 6).alias("duplicate_ratio"), "examples")


def typed_values(freq: DataFrame) -> DataFrame:
    """``freq`` without nulls, values as sets compare them: numbers of a float column without fractions as whole numbers, so that 7.0 meets 7 and "7"; other text stripped."""
    two = ["table_name", "column_name"]
    known = freq.where("v is not null")
    x = F.col("v").try_cast("double")
    whole = known.where("family = 'float'").groupBy(*two).agg(F.min(F.coalesce((x == F.rint(x)) & (F.abs(x) < 2.0**53), F.lit(False))).alias("whole"))
    out = known.join(F.broadcast(whole), two, "left")  # a row per float column
    return out.withColumn("v", F.when(F.col("whole"), x.cast("long").cast("string")).otherwise(strip(F.col("v")))).drop("whole")


def _compared(freq: DataFrame, columns: DataFrame) -> DataFrame:
    # a row per column: as a broadcast it leaves the values where they are, where a shuffle by column would bring all values of one together
    return typed_values(freq.join(F.broadcast(columns.select("table_name", "column_name").distinct()), ["table_name", "column_name"], "left_semi")).select("table_name", "column_name", "v").distinct()


#: Columns whose bits one long holds.
_BITS = 63


def overlaps(freq: DataFrame, columns: DataFrame, same_name: bool = False, within: bool = False, least: float = 0.10) -> DataFrame:
    """Pairs of columns that share values: of different tables (of equal names, if asked), or ``within`` a table.

    ``columns`` (table_name, column_name) are compared by their typed values; a pair counts if it shares at least the given part of its smaller set.
    One shuffle by value tells in bits which columns hold it. Values in the same columns are then counted together, and pairs come from what is left.
    """
    spark, two = freq.sparkSession, ["table_name", "column_name"]
    listed = sorted({(r[0], r[1]) for r in columns.select(*two).distinct().collect()})  # a row per column
    names = spark.createDataFrame([(*c, i) for i, c in enumerate(listed)], "table_name string, column_name string, cid int")
    words = range(max(1, -(-len(listed) // _BITS)))
    f = typed_values(freq.join(F.broadcast(names), two)).select("cid", "v")
    bit = F.expr(f"shiftleft(1L, cid % {_BITS})")
    met = f.groupBy("v").agg(*(F.bit_or(F.when(F.floor(F.col("cid") / _BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words))
    met = met.groupBy(*(f"w{w}" for w in words)).agg(F.count("*").alias("n"))

    def held(w: int) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda i: F.getbit(F.col(f"w{w}"), i) == 1)
        return F.transform(bits, lambda i: i + w * _BITS)

    holds = F.flatten(F.array(*map(held, words)))
    met = met.select("n", holds.alias("cids"))
    each = met.select("n", "cids", F.explode("cids").alias("a"))
    # every column that holds a value is a pair with itself; so sizes come from the same counts
    counts = each.select("a", F.explode("cids").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    counts = small(counts)  # as many rows as pairs of columns
    sizes = counts.where("a = b")
    side = lambda s: names.toDF(f"table_{s}", f"column_{s}", s).join(sizes.select(F.col("a").alias(s), F.col("shared").alias(f"n_{s}")), s)
    rule = (F.col("table_a") == F.col("table_b")) & (F.col("column_a") < F.col("column_b")) if within else F.col("table_a") < F.col("table_b")
    if same_name:
        rule = rule & (F.lower(F.trim("column_a")) == F.lower(F.trim("column_b")))
    four = ["table_a", "column_a", "table_b", "column_b"]
    out = counts.where("a <> b").join(side("a"), "a").join(side("b"), "b").where(rule)
    ratio = F.col("shared") / F.least("n_a", "n_b")
    return out.withColumn("overlap_ratio", F.round(ratio, 6)).where(ratio >= least).select(*four, "shared", "n_a", "n_b", "overlap_ratio")


def with_examples(found: DataFrame, freq: DataFrame, k: int = 10) -> DataFrame:
    """``found`` overlaps (a row per pair of columns) with the ``k`` smallest values that a pair shares. Values meet for these pairs only."""
    four = ["table_a", "column_a", "table_b", "column_b"]
    pairs = small(found.select(*four))
    f = _compared(freq, pairs.select("table_a", "column_a").toDF("table_name", "column_name").unionByName(pairs.select("table_b", "column_b").toDF("table_name", "column_name")))
    side = lambda s: f.toDF(f"table_{s}", f"column_{s}", "v")
    met = side("a").join(F.broadcast(pairs), ["table_a", "column_a"]).join(side("b"), ["table_b", "column_b", "v"], "left_semi")  # a row per pair
    return found.join(examples(met, four, "v", k), four, "left")


def signature(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns))


def signature_conflicts(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Signatures (joined columns) that stand with more than one id."""
    s = df.select(signature(columns).alias("signature"), F.col(f"`{id_column}`").cast("string").alias("id")).groupBy("signature", "id").agg(F.count("*").alias("n"))
    g = s.groupBy("signature").agg(F.count("id").alias("distinct_ids"), F.sum("n").alias("n_rows"), F.min("id").alias("first_id"))
    return g.where("distinct_ids > 1").withColumns({"id_column": F.lit(id_column), "signature_columns": F.lit(",".join(columns))})


def with_example_rows(conflicts: DataFrame, df: DataFrame, id_column: str, columns: list[str], k: int = 10) -> DataFrame:
    """``conflicts`` of ``df`` with the first ``k`` different rows (id and signature columns, as JSON) of each signature, by id."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in [id_column, *(c for c in columns if c != id_column)])), {"ignoreNullFields": "false"})
    rows = df.where(F.col(f"`{id_column}`").isNotNull()).select(signature(columns).alias("signature"), F.col(f"`{id_column}`").alias("id"), row.alias("row")).join(conflicts.select("signature"), "signature", "left_semi").distinct()
    kept = first_of_groups(rows, ["signature"], ["id", "row"], k).groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("place", "row")))["row"].alias("example_rows"))
    return conflicts.join(kept, "signature", "left")


def collapse_signatures(conflicts: DataFrame, k: int = 10) -> DataFrame:
    """One row per signature: the id columns that conflict on it, and the most distinct ids; if there are example rows, the first ``k`` different ones of all."""
    merged = [F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("example_rows")))), 1, k).alias("example_rows")] if "example_rows" in conflicts.columns else []
    return conflicts.groupBy("signature").agg(F.array_join(F.sort_array(F.collect_set("id_column")), ",").alias("id_columns"), F.max("distinct_ids").alias("max_distinct_ids"), F.max("n_rows").alias("n_rows"), *merged)


def summarise_signatures(collapsed: DataFrame) -> DataFrame:
    ids = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("id_columns", ","))))), ",")
    return collapsed.groupBy().agg(F.count("*").alias("signatures"), F.max("max_distinct_ids").alias("max_distinct_ids"), ids.alias("id_columns"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one on all (or the given) columns, nulls being equal, and the ratio. Unknown columns are passed over."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    g = df.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("n_"))
    out = g.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("n_") > 1).alias("duplicate_groups"))
    return out.withColumn("duplicate_ratio", F.round(F.coalesce(F.try_divide("duplicate_rows", "n_rows"), F.lit(0.0)), 6))


def duplicate_preview(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows that share the columns' values with another row."""
    again = df.groupBy(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns))).agg(F.count("*").alias("group_size")).where("group_size > 1")
    rule = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)))
    return df.join(again, rule).select(*(F.col(f"`{c}`") for c in df.columns), "group_size")


def repeated_links(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.groupBy(F.col(f"`{left}`").alias("left_value"), F.col(f"`{right}`").alias("right_value")).agg(F.count("*").alias("n")).where("n > 1")


def cardinality_violations(df: DataFrame, left: str, right: str, expected: str = "one_to_one") -> DataFrame:
    """Values that stand with more partners than ``expected`` (one_to_one, one_to_many, many_to_one) lets them."""
    pairs = df.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null").distinct()
    side = lambda a, b, name: pairs.groupBy(F.col(a).cast("string").alias("value")).agg(F.count(b).alias("partners")).where("partners > 1").select(F.lit(name).alias("side"), "value", "partners")
    parts = []
    if expected in ("one_to_one", "many_to_one"):
        parts.append(side("l", "r", "left"))
    if expected in ("one_to_one", "one_to_many"):
        parts.append(side("r", "l", "right"))
    return reduce(DataFrame.unionByName, parts)


def signature_choice(profiles: DataFrame) -> dict[str, tuple[list[str], list[str]]]:
    """For each table the id columns, and the columns of a signature: the first natural key, or else two or more columns that are neither ids nor nearly unique nor of few values."""
    name, unique = F.col("column_name"), F.col("unique_ratio_non_null")
    ids, natural = id_like(name) & (unique >= 0.98), natural_like(name) & (unique >= 0.70)
    other = ~id_like(name) & (unique <= 0.95) & (F.col("n_unique") > 5)
    kind = F.when(ids, "id").when(natural, "natural").when(other, "other")
    out: dict[str, tuple[list[str], list[str]]] = {}
    rows = profiles.where(F.col("n_non_null") >= 20).select("table_name", "column_name", kind.alias("kind")).where("kind is not null").orderBy("table_name", "column_name").collect()  # a row per column
    for t in dict.fromkeys(r["table_name"] for r in rows):
        of = {k: [r["column_name"] for r in rows if r["table_name"] == t and r["kind"] == k] for k in ("id", "natural", "other")}
        columns = of["natural"][:1] or of["other"]
        if len(columns) >= (1 if of["natural"] else 2):
            out[t] = (of["id"], columns)
    return out


def duplicate_checks(tables: dict[str, DataFrame], freq: DataFrame, profiles: DataFrame, links: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The checks on columns and rows of all tables, by name. ``links`` are tables' foreign keys: rows that repeat a pair of them are listed."""
    ids = profiles.where(id_like(F.col("column_name")))
    keys = profiles.where(id_like(F.col("column_name")) | natural_like(F.col("column_name")))
    named = lambda parts: reduce(DataFrame.unionByName, parts)
    out = {
        "key_values": key_duplicates(freq, profiles),
        "natural_key_values": key_duplicates(freq, profiles, natural=True),
        "overlap_same_name": with_examples(overlaps(freq, profiles, same_name=True), freq),
        "overlap_keys": with_examples(overlaps(freq, keys), freq),
        "within_table": with_examples(overlaps(freq, ids, within=True), freq),
        "exact_rows": named(duplicate_rows(d).withColumn("table_name", F.lit(n)) for n, d in tables.items()),
    }
    chosen = signature_choice(profiles)
    conflicts = [with_example_rows(signature_conflicts(tables[t], i, columns), tables[t], i, columns).withColumn("table_name", F.lit(t)) for t, (of, columns) in chosen.items() for i in of]
    if conflicts:
        out["signatures"] = named(conflicts)
        parts = {t: out["signatures"].where(F.col("table_name") == t) for t in dict.fromkeys(t for t, (of, _) in chosen.items() if of)}
        out["signatures_collapsed"] = named(collapse_signatures(d).withColumn("table_name", F.lit(t)) for t, d in parts.items()).orderBy("table_name", F.desc("max_distinct_ids"), "signature")
        out["signatures_summary"] = named(summarise_signatures(collapse_signatures(d)).withColumn("table_name", F.lit(t)) for t, d in parts.items()).where("signatures > 0").orderBy(F.desc("signatures"), "table_name")
    if chosen:
        out["subset_rows"] = named(duplicate_rows(tables[t], columns).withColumns({"table_name": F.lit(t), "columns": F.lit(",".join(columns))}) for t, (_, columns) in chosen.items())
    pairs = [(t, a, b) for t, fks in (links or {}).items() for a, b in combinations(sorted(set(fks)), 2)]
    if pairs:
        text = lambda c: F.col(c).cast("string").alias(c)
        out["repeated_links"] = named(repeated_links(tables[t], a, b).select(F.lit(t).alias("table_name"), F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), text("left_value"), text("right_value"), "n") for t, a, b in pairs)
    return out


def is_sentinel(v: Column, cfg: DefaultConfig = DefaultConfig()) -> Column:
    number = v.try_cast("double").try_cast("long")
    return F.lower(F.trim(v)).isin(list(cfg.sentinel_texts)) | F.coalesce(number.isin(list(cfg.sentinel_ints)), F.lit(False))


def default_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str, partners: tuple[str, ...] = (), labels: tuple[str, ...] = (), cfg: DefaultConfig = DefaultConfig(), clean: Clean = sql_clean) -> DataFrame:
    """The most frequent values of a foreign key, with the signs that one of them stands for "none".

    ``partners`` are columns that vary under a placeholder; ``labels`` are the parent's columns that may call a row a dummy.
    """
    freq = _counted(child, fk, clean)
    total = freq.agg(F.sum("cnt").alias("total"), F.count("*").alias("fk_distinct"))
    top = freq.orderBy(F.desc("cnt"), "v").limit(cfg.top_k).crossJoin(total).withColumn("ratio", F.col("cnt") / F.col("total"))
    top = top.join(_counted(parent, pk, clean).select("v", F.lit(True).alias("known")), "v", "left").withColumn("in_parent", F.coalesce("known", F.lit(False))).drop("known")
    top = top.withColumn("sentinel", is_sentinel(F.col("v"), cfg))
    if partners:
        long = child.select(clean(F.col(f"`{fk}`")).alias("v"), F.inline(F.array(*(F.struct(F.lit(p).alias("partner"), F.col(f"`{p}`").cast("string").alias("x")) for p in partners)))).where("v is not null and x is not null")
        overall = long.select("partner", "x").distinct().groupBy("partner").agg(F.count("*").alias("overall"))
        under = long.join(top.select("v"), "v", "left_semi").select("v", "partner", "x").distinct().groupBy("v", "partner").agg(F.count("*").alias("under"))
        best = under.join(overall, "partner").where((F.col("overall") >= cfg.partner_overall) & (F.col("under") >= cfg.partner_distinct) & (F.col("under") / F.col("overall") >= cfg.partner_ratio))
        top = top.join(best.groupBy("v").agg(F.max("under").alias("partner_distinct")), "v", "left")
    else:
        top = top.withColumn("partner_distinct", F.lit(None).cast("long"))
    often, varied = F.col("ratio") >= cfg.ratio, F.col("partner_distinct").isNotNull()
    rules = [
        (often & ~F.col("in_parent"), "high_frequency_orphan_value"),
        (often & F.col("sentinel"), "high_frequency_sentinel_value"),
        ((F.col("ratio") >= cfg.heavy_ratio) & (F.col("fk_distinct") > cfg.small_fk_distinct), "extreme_bucket_share"),
        (often & varied, "pairs_with_many_distinct_partner_ids"),
    ]
    guarded = (F.col("fk_distinct") <= cfg.small_fk_distinct) & ~F.col("sentinel") & ~(often & varied)
    reasons = F.when(guarded, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(c, n) for c, n in rules))))
    out = top.withColumn("reasons", reasons).withColumn("flagged", (F.size("reasons") > 0) & (F.col("total") >= cfg.min_non_null))
    if labels:
        text = F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in labels)))
        dummy = parent.select(clean(F.col(f"`{pk}`")).alias("v"), text.rlike("unknown|default|misc|n/a|\\bna\\b").alias("dummy")).groupBy("v").agg(F.max("dummy").alias("dummy_parent"))
        out = out.join(dummy, "v", "left").withColumn("dummy_parent", F.coalesce("dummy_parent", F.lit(False)) & F.col("flagged"))
    return out.select("v", "cnt", F.round("ratio", 6).alias("ratio"), "in_parent", "sentinel", "fk_distinct", "partner_distinct", "reasons", "flagged", *(["dummy_parent"] if labels else []))
