"""Line dedup by winnowing over line hashes, with DataFrame operations only.

A run of lines is a passage if it has WORDS words or LINES lines. Each line begins a window, the fewest lines from it on that make a passage. A window selects one place, that of its smallest
line hash: windows that lie over one another share it, so that few places of a document are selected, and every repeated passage has one at the same line of both copies. Selected places alone, a row
each, are joined by their hashes. Documents without a place that meets another leave. From the places that meet matches are extended both ways, to the windows around them: those that begin
at a line before and hold the place, and those that end behind it. Such a window repeats if its lines, hash by hash, have occurred before in the order of (doc_id, text hash, line); comparing
all places of a hash at once by a hash of the window's lines takes the place of comparing them pair by pair, which would list the square of their number. The lines of repeated windows are deleted.
That takes all of every repeated run and nothing else: a line of a run that is a passage either begins a window within the run, or lies in the window that ends with the run.
Each deleted line has an equal one before it, so that a first one always stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

WORDS, LINES = 50, 8


def _words(line: Column) -> Column:
    """Parts between spaces; an empty line has none."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc, arr) of each different (doc_id, text): doc is a struct of doc_id and th (text hash), arr the hashes h and words w of its lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    arr = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).alias("w")))
    flat = docs.select("doc_id", F.xxhash64(text).alias("th"), arr.alias("arr")).dropDuplicates(["doc_id", "th"])
    return flat.select(F.struct("doc_id", "th").alias("doc"), "arr")


def _enough(near: Column, words: int) -> Column:
    """How many of some lines it takes for ``words`` words; all of them if they hold fewer."""
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    more = lambda a, x: F.when(a["s"] >= words, a).otherwise(F.struct((a["s"] + F.coalesce(x["w"], F.lit(0))).alias("s"), (a["n"] + 1).alias("n")))
    return F.aggregate(near, start, more)["n"]


def windows(flat: DataFrame, words: int = WORDS, lines: int = LINES, ending: bool = False) -> DataFrame:
    """The windows of ``flat`` (doc, arr), one for each line that begins one, or, with ``ending``, that ends one: doc, start, n (lines), low and lh (the selected place and its hash), key (hash of all lines)."""
    # the lines from each line on, or those before it up to it; slices would read the whole array each time
    near = F.transform("arr", lambda _, i: F.array(*(F.get("arr", i + (-k if ending else k)) for k in range(lines))))
    each = flat.select("doc", F.posexplode(near).alias("pos", "near"))
    each = each.withColumn("n", _enough(F.col("near"), words)).where(F.get("near", F.col("n") - 1).isNotNull())
    each = each.withColumn("near", F.slice("near", F.lit(1), F.col("n")))
    if ending:
        each = each.withColumn("near", F.reverse("near")).withColumn("pos", F.col("pos") - F.col("n") + 1)
    # a window that ends with a line holds the one that begins with its first line, and takes over its place
    own = each.select("doc", F.col("pos").alias("start"), "n", F.transform("near", lambda x: x["h"]).alias("h"), _enough(F.col("near"), words).alias("m"))
    low = F.array_min(F.slice("h", F.lit(1), F.col("m")))
    own = own.withColumn("lh", low)
    return own.select("doc", "start", "n", (F.col("start") + F.array_position("h", F.col("lh")).cast("int") - 1).alias("low"), "lh", F.xxhash64("h").alias("key"))


def selected_places(flat: DataFrame, words: int = WORDS, lines: int = LINES) -> DataFrame:
    """(doc, low, lh): each place that some window selects, once."""
    return windows(flat, words, lines).select("doc", "low", "lh").distinct()


def meeting_places(places: DataFrame) -> DataFrame:
    """(doc, low): the places whose hash is selected at another place, too."""
    at = F.struct("doc", "low")
    met = places.groupBy("lh").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("lh")
    return places.join(met, "lh", "left_semi").select("doc", "low")


def extended(flat: DataFrame, met: DataFrame, words: int = WORDS, lines: int = LINES) -> DataFrame:
    """(doc, start, n, ends, key): the windows around places that meet."""
    near = flat.join(met.select("doc").distinct(), "doc", "left_semi")
    both = [windows(near, words, lines, e).withColumn("ends", F.lit(e)).join(met, ["doc", "low"], "left_semi") for e in (False, True)]
    return both[0].unionByName(both[1]).select("doc", "start", "n", "ends", "key")


def repeated_lines(around: DataFrame) -> DataFrame:
    """(doc, pos): the lines to delete. ``around`` are the windows around places that meet."""
    place = F.struct("doc", "start")
    first = around.groupBy("key", "ends").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("key", "ends", "first")
    again = around.join(first, ["key", "ends"]).where(place != F.col("first"))
    return again.select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dedup_lines(docs: DataFrame, words: int = WORDS, lines: int = LINES) -> DataFrame:
    """``docs`` with n_lines, n_removed and clean_text, the text without its repeated runs of lines; columns of these names are replaced.

    Lines end at newlines. A null text counts as empty: one empty line, nothing removed. Rows that repeat doc_id and text are one document and are cleaned alike.
    Null doc_ids come first in the order. A run that repeats within a document is deleted where it comes again. An empty table gives no rows.
    """
    flat = materialize(split_lines(docs.select("doc_id", "text")))
    met = materialize(meeting_places(materialize(selected_places(flat, words, lines))))
    gone = repeated_lines(materialize(extended(flat, met, words, lines))).groupBy("doc").agg(F.collect_set("pos").alias("gone"))

    def key(i: Column, h: Column) -> Column:
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), h.cast("string")).alias("doc")

    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "clean_text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), text.alias("whole"), key(F.col("doc_id"), F.xxhash64(text)))  # no name of theirs can clash with ours
    out = named.join(gone.select(key(F.col("doc.doc_id"), F.col("doc.th")), "gone"), "doc", "left")
    n_lines = F.length("whole") - F.length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1
    out = out.withColumn("n", n_lines)
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(_let(F.split("whole", "\n", -1), lambda parts: F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("n").cast("long").alias("n_lines"), removed.alias("n_removed"), clean.alias("clean_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))
