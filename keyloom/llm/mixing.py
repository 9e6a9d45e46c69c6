"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates r of documents minimise the relative entropy to one copy each, subject to one token constraint per source: the sum of
size * r is the source's target. The dual gives exponentially tilted rates r = min(MOST, exp(lam * size / mean size)), with one lam per
source. Newton steps on all sources at once find the lams; each step is one aggregation of (source, size) counts, to which documents are
reduced first. A step that leaves its bracket is replaced by a bisection. Rates are rounded to whole copies per (source, size), then
the rest of each source is made up with a few cells, from large sizes to small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

#: The sources' weights in the order of their names, repeating; and how often a document is taken at most.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps end at this relative error of each source's tokens.
PRECISION, MAX_STEPS = 1e-7, 80


def _key(source: Column) -> Column:
    """A source as a join key; null is a source, too."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds place: 0, 1, ... in the order of source, null last, without sorting in a single task."""
    cut = sources.repartitionByRange(8, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    cut = materialize(cut.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    before, starts = 0, []
    for r in cut.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append(F.when(F.col("part") == r["part"], F.lit(before)))
        before += r["n"]
    return cut.select("*", (F.coalesce(*starts, F.lit(0)) + F.col("nth")).alias("place")).drop("part", "nth")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, key, total): shares of all tokens by weight; none above ``most`` times its total, the excess reshared by weight."""
    w = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    named = materialize(_numbered(sources).select("source", "key", "total", w.alias("weight")))
    cap = F.col("total") * F.lit(float(most))
    all_tokens = named.agg(F.sum("total")).first()[0] or 0
    level = -1.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        capped, free = named.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (all_tokens - (capped or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    return named.select("*", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    return F.when(lam * x >= F.log(F.lit(float(most))), F.lit(float(most))).otherwise(F.exp(lam * x))


def balance(cells: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(key, lam, mean, full) per source: sum of n * size * rate over its cells (key, size, n) is its target.

    full: the target is all that the source can give, so that each rate is ``most``.
    """
    mean = F.try_divide(F.sum(F.col("n") * F.col("size")), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)))
    means = cells.groupBy("key").agg(mean.alias("mean"))
    state = sources.join(means, "key").select(
        "key",
        "target",
        F.when(F.col("total") > 0, F.col("mean")).otherwise(1.0).alias("mean"),
        (F.col("target") >= F.col("total") * F.lit(most * (1 - 1e-12))).alias("full"),
        F.lit(0.0).alias("lam"),
        F.when(F.col("total") > 0, -F.col("mean") * F.log(F.greatest(F.lit(1.0), F.col("total") / F.col("target"))) - 1).otherwise(0.0).alias("lo"),
        (F.coalesce("mean", F.lit(1.0)) * F.log(F.lit(float(most))) + 1).alias("hi"),
        (F.col("total") == 0).alias("done"),
    )
    state = materialize(state.withColumn("done", F.col("done") | F.col("full")))
    x = F.col("size") / F.col("mean")
    for _ in range(MAX_STEPS):
        rate = _rate(F.col("lam"), x, most)
        tokens = F.col("n") * F.col("size") * rate
        sums = cells.join(state.where("not done"), "key").groupBy("key").agg(F.sum(tokens).alias("f"), F.sum(F.when(rate < most, tokens * x).otherwise(0.0)).alias("g"))
        s = state.join(sums, "key", "left").withColumn("e", F.col("f") - F.col("target"))
        s = s.withColumn("lo", F.when(F.col("e") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("e") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("g") > 0, F.col("lam") - F.col("e") / F.col("g"))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("done") | (F.abs("e") <= F.col("target") * PRECISION) | (F.col("hi") - F.col("lo") <= 1e-13 * F.abs("lam"))
        state = materialize(s.select("key", "target", "mean", "full", F.when(done, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", done.alias("done")))
        if state.where("not done").isEmpty():
            return state.select("key", "target", "lam", "mean", "full")
    raise RuntimeError(f"rates are not balanced after {MAX_STEPS} steps")


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def cell_copies(cells: DataFrame, state: DataFrame, most: int = MOST) -> DataFrame:
    """(key, size, n, copies): copies of all documents of a cell, such that each source's tokens come to its target.

    A cell first gets its rate times n, rounded at random by a hash. What a source is then short of or has too much goes to one cell of each
    power of two of sizes, the roomiest, from the largest on: as many copies as fit into the rest.
    """
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), most))
    first = F.least(F.floor(F.col("n") * rate + _uniform(F.col("key"), F.col("size"))).cast("long"), F.col("n") * most)
    c = materialize(cells.join(state, "key").select("key", "size", "n", "target", first.alias("copies")))
    rest = c.groupBy("key").agg(F.round(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("rest"))
    room = F.when(F.col("rest") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
    able = c.join(rest, "key").where("size > 0 and rest <> 0").select("key", "size", "rest", room.alias("room")).where("room > 0")
    best = able.groupBy("key", "rest", F.floor(F.log2("size")).alias("class")).agg(F.max(F.struct("room", "size")).alias("b"))
    # at most 64 classes a source
    listed = best.groupBy("key", "rest").agg(F.sort_array(F.collect_list(F.struct(F.col("b.size").alias("size"), F.col("b.room").alias("room"))), asc=False).alias("cells"))
    zero = F.struct(F.abs("rest").alias("rest"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))

    def take(s: Column, x: Column) -> Column:
        k = F.least(x["room"], F.floor(s["rest"] / x["size"]).cast("long"))
        return F.struct((s["rest"] - k * x["size"]).alias("rest"), F.concat(s["out"], F.array(F.struct(x["size"].alias("size"), k.alias("more")))).alias("out"))

    more = listed.select("key", F.signum("rest").cast("long").alias("sign"), F.explode(F.aggregate("cells", zero, take, lambda s: s["out"])).alias("x"))
    more = more.select("key", F.col("x.size").alias("size"), (F.col("sign") * F.col("x.more")).alias("more"))
    return c.join(more, ["key", "size"], "left").select("key", "size", "n", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    size counts the words of the text (none if null), taken is copies * size, and copies is 0 to ``most``. Sources stand in the order of their code points, null last, with
    ``weights`` repeating. A source without words has the target 0, and one copy of each document. Repeated rows are documents
    of their own. An empty table gives no rows. Choices depend on hashes of doc_id only, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("key", _key(F.col("source"))))
    cells = materialize(sized.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    totals = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("total"))
    sources = materialize(source_targets(totals, weights, most))
    cells = cells.select("key", "size", "n")
    copies = materialize(cell_copies(cells, balance(cells, sources, most), most))
    # n documents share the copies: all get the quotient, and the first of them by hash one more. A cell is ranked in about sqrt(n) parts.
    each = copies.select("key", "size", "n", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra"))
    placed = sized.join(each, ["key", "size"])
    part = F.pmod(F.xxhash64(F.lit(1), F.col("doc_id")), F.ceil(F.sqrt("n"))).alias("part")
    plain = placed.where("extra = 0").select("doc_id", "key", "size", F.col("each").alias("copies"))
    shared = placed.where("extra > 0").select("doc_id", "key", "size", "each", "extra", part)
    in_part = Window.partitionBy("key", "size", "part")
    starts = shared.groupBy("key", "size", "part").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("key", "size").orderBy("part")) - F.col("m"))
    ranked = shared.withColumn("rank", F.row_number().over(in_part.orderBy(F.xxhash64(F.lit(2), F.col("doc_id")), "doc_id")))
    ranked = ranked.join(starts.select("key", "size", "part", "before"), ["key", "size", "part"])
    split = ranked.select("doc_id", "key", "size", (F.col("each") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).alias("copies"))
    out = plain.unionByName(split).join(sources.select("key", "source", F.col("total").alias("source_size"), "target"), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that it doesn't take are gone."""
    names = docs.columns

    def key(size: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"), _key(F.col("source").cast("string")))

    taken = mix(docs, weights, most).groupBy(key(F.col("size")).alias("row_key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    # columns are renamed meanwhile, so that none clashes
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), key(size).alias("row_key")).join(taken, "row_key")
    once = keyed.where("rows = 1")
    again = keyed.where("rows > 1").withColumn("place", F.row_number().over(Window.partitionBy("row_key").orderBy(f"c{names.index('text')}")))
    again = again.withColumn("copies", F.expr("copies div rows") + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")).drop("place")
    full = once.unionByName(again).where("copies > 0")
    return full.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"`{c}`") for c in names))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
