"""Inclusion dependencies between columns: strict on values, soft on representations of values."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SoftConfig, StrictConfig
from ..functions.names import name_similarity
from ..functions.normalize import int_like, raw_rep
from ..plans.cells import small
from .sketches import gated_pairs

_COLUMN = ["table_name", "column_name"]


def strict_children(profiles: DataFrame, ucc: DataFrame, cfg: StrictConfig = StrictConfig()) -> DataFrame:
    """Columns that may be foreign keys."""
    string = F.col("dtype_family") == "string"
    p = profiles.join(ucc.select(*_COLUMN), _COLUMN, "left_anti").where(F.col("dtype_family").isin(list(cfg.families)))
    p = p.where((F.col("null_ratio") < cfg.max_null_ratio) & (F.col("unique_ratio_non_null") >= cfg.min_unique_ratio) & (F.col("n_non_null") >= cfg.min_non_null))
    p = p.where(~((F.col("n_unique") <= 50) & (F.col("top1_ratio") > 0.90)))
    p = p.where(F.col("n_unique") >= F.when(string, cfg.min_distinct_string).otherwise(cfg.min_distinct_child))
    p = p.where(~string | ((F.col("max_len") - F.col("min_len") <= 30) & (F.col("avg_len") <= 40)))
    return p.where(~F.col("reject")) if cfg.apply_prune and "reject" in p.columns else p


def strict_parents(profiles: DataFrame, ucc: DataFrame, cfg: StrictConfig = StrictConfig()) -> DataFrame:
    p = profiles.join(ucc.select(*_COLUMN), _COLUMN, "left_semi").where(F.col("dtype_family").isin(list(cfg.families)))
    return p.where(~F.col("reject")) if cfg.apply_prune and "reject" in p.columns else p


def _side(p: DataFrame, side: str) -> DataFrame:
    kept = {"table_name": "table", "column_name": "column", "n_non_null": "non_null_rows", "n_unique": "distinct", "int_min": "min", "int_max": "max"}
    return p.select(*(F.col(a).alias(f"{side}_{b}") for a, b in kept.items()))


def strict_pairs(freq: DataFrame, profiles: DataFrame, ucc: DataFrame, cfg: StrictConfig = StrictConfig()) -> DataFrame:
    """Every pair of a child and a parent column, with the gate that drops it before values are compared, or null."""
    child, parent = strict_children(profiles, ucc, cfg), strict_parents(profiles, ucc, cfg)
    return gated_pairs(freq.where("v is not null"), child, parent, cfg.min_distinct_coverage, cfg.sketch_size, cfg.sketch_risk)


#: Children whose counts one row of a value holds, and parents whose bits one long holds.
_CHILDREN, _BITS = 8, 63


def shared_values(freq: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each of ``pairs`` (fk_table, fk_column, pk_table, pk_column): intersection_distinct and matched_rows; pairs without a common value are left out.

    One shuffle by value serves all pairs. Children are dealt into batches, and only columns of some pair are shuffled, a parent once for each batch with a child of its. Where a value meets, it becomes
    a row of fixed width: a bit for each parent that holds it and a count for each child. So values are neither listed nor sorted, and those in the same parents are counted together.
    """
    spark = freq.sparkSession
    wanted = [tuple(r) for r in pairs.select("fk_table", "fk_column", "pk_table", "pk_column").distinct().collect()]  # pairs of columns, from profiles
    children = {c: divmod(i, _CHILDREN) for i, c in enumerate(dict.fromkeys(w[:2] for w in wanted))}
    bits: dict[int, dict[tuple[str, str], int]] = {}
    for w in wanted:
        of = bits.setdefault(children[w[:2]][0], {})
        of.setdefault(w[2:], len(of))
    rows = [(*c, batch, i, None) for c, (batch, i) in children.items()] + [(*c, batch, None, i) for batch, of in bits.items() for c, i in of.items()]
    columns = spark.createDataFrame(rows, "table_name string, column_name string, batch int, child int, parent int")
    values = freq.where("v is not null").select(*_COLUMN, "family", "v", "cnt").join(F.broadcast(columns), _COLUMN)  # a row per column and batch
    counts, words = [f"c{i}" for i in range(min(_CHILDREN, len(children)) or 1)], [f"w{i}" for i in range(-(-max(map(len, bits.values()), default=1) // _BITS))]
    bit = F.expr(f"shiftleft(1L, parent % {_BITS})")
    held = [F.bit_or(F.when(F.floor(F.col("parent") / _BITS) == i, bit)).alias(w) for i, w in enumerate(words)]
    met = values.groupBy("batch", "family", "v").agg(*held, *(F.sum(F.when(F.col("child") == i, F.col("cnt"))).alias(c) for i, c in enumerate(counts)))
    met = met.where(F.coalesce(*words).isNotNull() & F.coalesce(*counts).isNotNull())
    each = F.array(*(F.struct(F.lit(i).alias("child"), F.count(c).alias("n"), F.sum(c).alias("m")) for i, c in enumerate(counts)))
    met = met.groupBy("batch", *words).agg(each.alias("each")).select("batch", *words, F.inline("each")).where("n > 0")

    def parents(i: int) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda b: F.getbit(F.coalesce(words[i], F.lit(0).cast("long")), b) == 1)
        return F.transform(bits, lambda b: b + i * _BITS)

    met = met.select("batch", "child", F.explode(F.flatten(F.array(*map(parents, range(len(words)))))).alias("parent"), "n", "m")
    met = met.groupBy("batch", "child", "parent").agg(F.sum("n").alias("intersection_distinct"), F.sum("m").alias("matched_rows"))
    named = spark.createDataFrame([(*children[w[:2]], bits[children[w[:2]][0]][w[2:]], *w) for w in wanted], "batch int, child int, parent int, fk_table string, fk_column string, pk_table string, pk_column string")
    return met.join(named, ["batch", "child", "parent"]).drop("batch", "child", "parent")


def strict_inclusions(freq: DataFrame, profiles: DataFrame, ucc: DataFrame, cfg: StrictConfig = StrictConfig()) -> DataFrame:
    """Pairs (child, parent) of different tables with most of the child's distinct values among the parent's.

    ``strict_pairs`` drops what counts, ranges, lengths and sketches rule out; the values of the other pairs are compared in full.
    """
    profiles, ucc = small(profiles), small(ucc)
    child, parent = strict_children(profiles, ucc, cfg), strict_parents(profiles, ucc, cfg)
    met = shared_values(freq, strict_pairs(freq, profiles, ucc, cfg).where("gate is null"))
    out = met.join(_side(child, "fk"), ["fk_table", "fk_column"]).join(_side(parent, "pk").drop("pk_non_null_rows"), ["pk_table", "pk_column"])
    dc, rc = F.col("intersection_distinct") / F.col("fk_distinct"), F.col("matched_rows") / F.col("fk_non_null_rows")
    out = out.withColumns({"distinct_coverage": F.round(dc, 6), "row_coverage": F.round(rc, 6)}).where((dc >= cfg.min_distinct_coverage) & (rc >= cfg.min_row_coverage))
    names = "fk_table fk_column pk_table pk_column fk_non_null_rows fk_distinct pk_distinct intersection_distinct matched_rows distinct_coverage row_coverage fk_min fk_max pk_min pk_max".split()
    return out.select(*names)


def pair_metrics(child: DataFrame, fk: str, parent: DataFrame, pk: str, clean) -> DataFrame:
    """Counts and coverages of one pair of columns, as one row."""
    c = child.select(clean(F.col(fk)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("cnt"))
    p = parent.select(clean(F.col(pk)).alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(True))
    g = c.join(p, "v", "left").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("fk_non_null_rows"), F.count("*").alias("fk_distinct"), F.count("hit").alias("intersection_distinct"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("cnt"))), F.lit(0)).alias("matched_rows"))
    g = g.crossJoin(p.agg(F.count("*").alias("pk_distinct")))  # a row each
    return g.select("*", F.try_divide("intersection_distinct", "fk_distinct").alias("distinct_coverage"), F.try_divide("matched_rows", "fk_non_null_rows").alias("row_coverage"))


def soft_children(profiles: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    named = F.lower("column_name").rlike(cfg.key_pattern)
    dominated = (F.col("n_unique") <= cfg.top1_distinct) & (F.col("top1_ratio") > cfg.max_top1)
    return profiles.where(named & (F.col("null_ratio") <= cfg.max_null_ratio) & (F.col("n_unique") >= cfg.min_distinct) & ~dominated)


def soft_parents(profiles: DataFrame, ucc: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    """Unique columns that are sound, and key-named columns."""
    unique = profiles.join(ucc.select(*_COLUMN), _COLUMN, "left_semi").where((F.col("n_rows") >= cfg.min_non_null) & (F.col("n_non_null") / F.col("n_rows") >= cfg.parent_non_null) & (F.col("unique_ratio") >= cfg.parent_unique))
    return unique.unionByName(soft_children(profiles, cfg)).dropDuplicates(_COLUMN)


def route_pairs(children: DataFrame, parents: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    """(fk_table, fk_column, pk_table, pk_column, name_sim): for each child the parents with the most similar names, or, without any, those of the most similar tables. Profiles are small: one row per column."""
    fk = children.select(F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"))
    pk = parents.select(F.col("table_name").alias("pk_table"), F.col("column_name").alias("pk_column"))
    pairs = fk.join(pk, F.col("fk_table") != F.col("pk_table")).withColumn("name_sim", name_similarity(F.col("fk_column"), F.col("pk_column")))
    near = F.lower("pk_table").startswith(F.lower(F.substring("fk_table", 1, 3)))
    named = F.col("name_sim") >= cfg.routing_sim
    child = Window.partitionBy("fk_table", "fk_column")
    pairs = pairs.withColumn("named", named).withColumn("any", F.max("named").over(child)).where("named = any")
    order = child.orderBy(F.when(F.col("any"), F.col("name_sim")).otherwise(near.cast("double")).desc(), "pk_table", "pk_column")
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cfg.max_parents)
    return pairs.select("fk_table", "fk_column", "pk_table", "pk_column", F.when(F.col("any"), F.col("name_sim")).otherwise(0.0).alias("name_sim"))


REPS = ("raw_str", "num_int_str", "digits_lstrip_zeros", "zfill", "num_int_str_zfill")


def _numeric_columns(values: DataFrame) -> DataFrame:
    """Per column of stripped values: whether it takes integer representations, its longest run of digits, and how many cells it has with a value."""
    x, v = F.col("v").try_cast("double"), F.col("v")
    values = values.withColumn("x", x)
    near = F.abs(F.col("x") - F.rint("x")) <= F.lit(1e-9) + F.lit(1e-5) * F.abs(F.rint("x"))
    n, parsed, whole = F.sum("cnt"), F.sum(F.when(F.col("x").isNotNull(), F.col("cnt")).otherwise(0)), F.sum(F.when(near, F.col("cnt")).otherwise(0))
    width = F.coalesce(F.max(F.when(v.rlike("^[0-9]+$"), F.length(v))), F.lit(0))
    g = values.groupBy(*_COLUMN).agg(n.alias("n"), parsed.alias("p"), whole.alias("w"), width.alias("digits"), F.sum(F.when(v.isNotNull(), F.col("cnt")).otherwise(0)).alias("eff"))
    return g.select(*_COLUMN, ((F.col("p") > 0) & (F.col("p") >= 0.5 * F.col("n")) & (F.col("w") >= 0.98 * F.col("p"))).alias("numeric"), "digits", "eff")


class _Codes:
    """Numbers for (column, representation, width): plain representations of every column, padded ones for each width that one of its pairs asks for."""

    def __init__(self, pairs: list[dict]):
        self.all: list[tuple[str, str, str, int]] = []
        self.of: dict[tuple[str, str], dict[tuple[str, int], int]] = {}
        self.numeric: dict[tuple[str, str], bool] = {}
        widths: dict[tuple[str, str], set[int]] = {}
        for p in pairs:
            for s in ("fk", "pk"):
                c = (p[f"{s}_table"], p[f"{s}_column"])
                self.numeric[c] = p[f"{s}_numeric"]
                widths.setdefault(c, set()).update({p["pair_width"]} - {0})
        for c, ws in widths.items():
            for rep, width in [(r, 0) for r in REPS[:3]] + [(r, w) for w in sorted(ws) for r in REPS[3:]]:
                self.of.setdefault(c, {})[rep, width] = len(self.all)
                self.all.append((*c, rep, width))

    def columns(self, spark: SparkSession) -> DataFrame:
        rows = [(*c, self.numeric[c], [k[r, 0] for r in REPS[:3]], [(w, k[REPS[3], w], k[REPS[4], w]) for w in sorted({w for _, w in k} - {0})]) for c, k in self.of.items()]
        return spark.createDataFrame(rows, "table_name string, column_name string, numeric boolean, plain array<int>, padded array<struct<width:int,text:int,number:int>>")

    def routes(self, pairs: list[dict]) -> dict[int, list[int]]:
        """For each number of a child those of its routed parents' representations."""
        to: dict[int, list[int]] = {}
        for p in pairs:
            fk, pk = (self.of[p[f"{s}_table"], p[f"{s}_column"]] for s in ("fk", "pk"))
            parents = [i for (_, w), i in pk.items() if w in (0, p["pair_width"])]
            for (_, w), i in fk.items():
                if w in (0, p["pair_width"]):
                    to.setdefault(i, []).extend(parents)
        return to


def representations(values: DataFrame, columns: DataFrame, max_abs: int) -> DataFrame:
    """(rid, x, cnt): the stripped values of columns in each of their representations, by its number; ``columns`` as _Codes gives them, a row per column."""
    v = F.col("v")
    base = values.join(F.broadcast(columns), _COLUMN).withColumns({"digits": v.rlike("^[0-9]+$"), "number": F.when(F.col("numeric"), v.try_cast("double"))})
    whole = int_like(F.col("number"), 1e-9) & (F.abs(F.rint("number")) <= max_abs)
    base = base.withColumn("number", F.when(whole, F.rint("number").cast("long").cast("string")))
    pad = lambda x, digits, w: F.when(digits, F.lpad(x, F.greatest(F.length(x), w), F.lit("0"))).otherwise(x)
    plain = F.array(*(F.struct(F.col("plain")[i].alias("rid"), x.alias("x")) for i, x in enumerate((v, F.col("number"), F.when(F.col("digits"), F.regexp_replace(v, "^0+(?=.)", ""))))))
    texts = F.transform("padded", lambda p: F.struct(p["text"].alias("rid"), pad(v, F.col("digits"), p["width"]).alias("x")))
    numbers = F.transform("padded", lambda p: F.struct(p["number"].alias("rid"), pad(F.col("number"), ~F.col("number").startswith("-"), p["width"]).alias("x")))
    return base.select("cnt", F.inline(F.concat(plain, texts, numbers))).where("x is not null").groupBy("rid", "x").agg(F.sum("cnt").alias("cnt"))


def soft_matches(freq: DataFrame, pairs: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    """Coverages of every routed pair in every pair of representations with a value in common, and the bounds of both; placeholders that dominate a child are left out.

    One shuffle by value serves all pairs: where a value meets, it counts for routed pairs only. Ties for a child's most frequent value go to the smallest value. The bounds are those of the texts that
    read as numbers, null without any. ``freq`` holds raw (unstripped) values. What comes out has a few rows for each pair, and is worked out at once.
    """
    spark = freq.sparkSession
    used = pairs.select(F.col("fk_table").alias("table_name"), F.col("fk_column").alias("column_name")).unionByName(pairs.select("pk_table", "pk_column").toDF(*_COLUMN)).distinct()
    values = freq.join(F.broadcast(used), _COLUMN, "left_semi").select(*_COLUMN, raw_rep(F.col("v")).alias("v"), "cnt")
    stats = small(_numeric_columns(values))
    of = lambda s: stats.toDF(f"{s}_table", f"{s}_column", f"{s}_numeric", f"{s}_digits", f"{s}_eff")
    w = F.greatest("fk_digits", "pk_digits")
    pairs = pairs.join(of("fk"), ["fk_table", "fk_column"]).join(of("pk"), ["pk_table", "pk_column"]).where((F.col("fk_eff") >= cfg.min_non_null) & (F.col("pk_eff") >= cfg.min_non_null))
    pairs = pairs.withColumn("pair_width", F.when((w > 1) & (w <= cfg.max_width), w).otherwise(0))
    listed = [r.asDict() for r in pairs.select("fk_table", "fk_column", "pk_table", "pk_column", "name_sim", "fk_numeric", "pk_numeric", "pair_width").collect()]  # max_parents for each child at most
    codes = _Codes(listed)
    to = codes.routes(listed)
    wanted = {i for ps in to.values() for i in ps}
    routes = spark.createDataFrame([(i, p, i in wanted) for i in range(len(codes.all)) for p in [to.get(i, [])]], "rid int, to array<int>, parent boolean")
    reps = representations(values.where("v is not null"), codes.columns(spark), cfg.max_abs_int).persist(StorageLevel.MEMORY_AND_DISK)
    number = F.col("x").try_cast("double")
    top = small(reps.groupBy("rid").agg(F.sum("cnt").alias("rows"), F.count("*").alias("distinct"), F.min(F.struct((-F.col("cnt")).alias("k"), F.col("x"))).alias("top"), F.min(number).alias("min"), F.max(number).alias("max")))
    routes = F.broadcast(routes)
    met = reps.join(routes.select("rid", (F.size("to") > 0).alias("child"), "parent"), "rid").groupBy("x").agg(F.collect_list(F.when(F.col("child"), F.struct("rid", "cnt"))).alias("children"), F.collect_list(F.when(F.col("parent"), F.col("rid"))).alias("parents"))
    met = met.where((F.size("children") > 0) & (F.size("parents") > 0)).select("x", "parents", F.inline("children")).join(routes.select("rid", "to"), "rid")
    met = met.select("rid", F.explode(F.array_intersect("to", "parents")).alias("pid"), "x", "cnt")
    # if the child's most frequent value is among the common ones, it is the most frequent of these
    met = small(met.groupBy("rid", "pid").agg(F.count("*").alias("intersection_distinct"), F.sum("cnt").alias("matched_rows"), F.min(F.struct((-F.col("cnt")).alias("k"), F.col("x"))).alias("common")))
    reps.unpersist()
    place = {r: i for i, r in enumerate(REPS, 1)}
    names = spark.createDataFrame([(i, t, c, f"{r}_{w}" if w else r, place[r]) for i, (t, c, r, w) in enumerate(codes.all)], "rid int, table string, column string, rep string, place int")
    side = lambda s, key: names.join(top, "rid").select(F.col("rid").alias(key), *(F.col(c).alias(f"{s}_{c}") for c in ("table", "column", "rep", "place", "min", "max", "rows", "distinct", "top")))
    met = met.join(side("fk", "rid"), "rid").join(side("pk", "pid").drop("pk_rows", "pk_top"), "pid")
    met = met.join(spark.createDataFrame([tuple(p[c] for c in ("fk_table", "fk_column", "pk_table", "pk_column", "name_sim")) for p in listed], "fk_table string, fk_column string, pk_table string, pk_column string, name_sim double"), ["fk_table", "fk_column", "pk_table", "pk_column"])
    met = met.withColumns({"top_cnt": -F.col("fk_top.k"), "top_in": (F.col("common.x") == F.col("fk_top.x")).cast("int")})
    ratio = F.col("top_cnt") / F.col("fk_rows")
    drop = ((ratio >= cfg.placeholder_top1) & F.lower("fk_top.x").isin(list(cfg.placeholders))) | ((ratio >= cfg.max_top1) & (F.col("top_in") == 0))
    cut = lambda c, by: F.col(c) - F.when(F.col("drop"), by).otherwise(0)
    met = met.withColumn("drop", drop).withColumns({"fk_non_null_rows": cut("fk_rows", F.col("top_cnt")), "fk_distinct": cut("fk_distinct", F.lit(1)), "matched_rows": cut("matched_rows", F.col("top_cnt") * F.col("top_in")), "intersection_distinct": cut("intersection_distinct", F.col("top_in"))})
    met = met.withColumns({"distinct_coverage": F.coalesce(F.try_divide("intersection_distinct", "fk_distinct"), F.lit(0.0)), "row_coverage": F.coalesce(F.try_divide("matched_rows", "fk_non_null_rows"), F.lit(0.0)), "top1_ratio": ratio})
    counts = ("fk_non_null_rows", "fk_distinct", "pk_distinct", "intersection_distinct", "matched_rows", "distinct_coverage", "row_coverage", "top1_ratio")
    return met.select("fk_table", "fk_column", "pk_table", "pk_column", "name_sim", "fk_rep", "pk_rep", "fk_place", "pk_place", *counts, "fk_min", "fk_max", "pk_min", "pk_max")


def best_representation(matches: DataFrame) -> DataFrame:
    """Per pair, the representations with the best distinct coverage, then row coverage, then in their order."""
    w = Window.partitionBy("fk_table", "fk_column", "pk_table", "pk_column").orderBy(F.desc("distinct_coverage"), F.desc("row_coverage"), "fk_place", "pk_place")
    return matches.where("intersection_distinct > 0").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "fk_place", "pk_place")


def soft_verdict(best: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    """Adds reason: null for accepted pairs, else small_domain_guard or coverage_fail."""
    dc, rc = F.col("distinct_coverage"), F.col("row_coverage")
    accept = ((dc >= cfg.min_distinct_coverage) & (rc >= cfg.min_row_coverage)) | ((dc >= cfg.alt_distinct_coverage) & (rc >= cfg.alt_row_coverage)) | ((dc >= cfg.min_distinct_coverage) & (F.col("matched_rows") >= cfg.min_matched_rows))
    guard = (F.col("fk_distinct") <= cfg.small_domain) & (F.col("top1_ratio") >= cfg.small_domain_top1) & (F.col("name_sim") < cfg.small_domain_sim)
    return best.withColumn("reason", F.when(guard, "small_domain_guard").when(~accept, "coverage_fail"))


def untested_pairs(freq: DataFrame, pairs: DataFrame, judged: DataFrame, cfg: SoftConfig = SoftConfig()) -> DataFrame:
    """The pairs that aren't ``judged``, with the reason: a table or column that ``freq`` doesn't know (one without rows is not known), too few values that aren't empty, or no representation in common."""
    sides = {s: [f"{s}_table", f"{s}_column"] for s in ("fk", "pk")}
    left = pairs.join(judged, [*sides["fk"], *sides["pk"]], "left_anti")
    used = reduce(DataFrame.unionByName, (pairs.select(*c).toDF(*_COLUMN) for c in sides.values())).distinct()
    filled = F.sum(F.when(raw_rep(F.col("v")).isNotNull(), F.col("cnt")).otherwise(0))
    sizes = freq.join(F.broadcast(used), _COLUMN, "left_semi").groupBy(*_COLUMN).agg(filled.alias("eff"))
    tables = freq.join(F.broadcast(used.select("table_name").distinct()), "table_name", "left_semi").select("table_name").distinct()
    for s, c in sides.items():
        left = left.join(tables.select(F.col("table_name").alias(c[0]), F.lit(True).alias(f"{s}_known")), c[0], "left").join(sizes.toDF(*c, f"{s}_eff"), c, "left")
    either = lambda x: F.col(f"fk_{x}").isNull() | F.col(f"pk_{x}").isNull()
    reason = F.when(either("known"), "table_missing").when(either("eff"), "column_missing").when(F.least("fk_eff", "pk_eff") < cfg.min_non_null, "min_non_null_effective").otherwise("no_representation_match")
    return left.select(*sides["fk"], *sides["pk"], "name_sim", reason.alias("reason"))


def soft_inclusions(freq: DataFrame, profiles: DataFrame, ucc: DataFrame, cfg: SoftConfig = SoftConfig()) -> tuple[DataFrame, DataFrame]:
    """Accepted pairs, and rejected ones with the reason."""
    pairs = route_pairs(soft_children(profiles, cfg), soft_parents(profiles, ucc, cfg), cfg)
    judged = soft_verdict(best_representation(soft_matches(freq, pairs, cfg)), cfg)
    four = ["fk_table", "fk_column", "pk_table", "pk_column"]
    accepted = judged.where("reason is null").drop("reason", "top1_ratio").withColumn("mode", F.lit("soft"))
    rejected = judged.where("reason is not null").select(*four, "name_sim", "reason")
    return accepted, rejected.unionByName(untested_pairs(freq, pairs, judged, cfg))
