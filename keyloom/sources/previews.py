"""Previews of many CSV files: the first rows of each, whatever their encodings.

The files are read as lines by Spark's text source, which keeps their bytes; only the beginning of each file is looked at, its first LINES lines, and these are picked where they are read. What isn't valid
UTF-8 is taken for Latin-1, file by file. Records may span lines; those with more fields than the header are left out, and missing fields are empty.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.topk import first_of_groups

ROWS, LINES = 7, 1000
#: The byte order mark.
_MARK = chr(0xFEFF)


def _records(head: str, n_rows: int) -> tuple[list[str], list[list[str]]]:
    """The header and the first records of a CSV text."""
    reader = csv.reader(io.StringIO(head))
    header = next((r for r in reader if r), [])
    rows: list[list[str]] = []
    for r in reader:
        if len(rows) == n_rows:
            break
        if r and len(r) <= len(header):
            rows.append(r + [""] * (len(header) - len(r)))
    return header, rows


def csv_previews(spark: SparkSession, folder: str, n_rows: int = ROWS, recursive: bool = True, lines: int = LINES) -> DataFrame:
    """(path, name, encoding, n_rows, preview) of each CSV file in a folder: the preview is the name, underlined, and the header with the first rows as CSV, or a note that there are none.

    Files without a byte have no preview row, as they have no line. A record that doesn't end within ``lines`` lines ends there.
    """
    read = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.csv").text(folder)
    at = F.col("_metadata.file_block_start")
    # a block is read from its start to its end, so the numbers of rows follow the lines of a file's first block
    first = read.where(at == 0).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    kept = first_of_groups(first, ["path"], ["at"], lines)
    head = kept.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "line")))["line"].alias("lines"))
    valid = F.forall("lines", lambda b: F.is_valid_utf8(b.cast("string")))
    text = F.when(valid, F.array_join(F.transform("lines", lambda b: b.cast("string")), "\n")).otherwise(F.array_join(F.transform("lines", lambda b: F.decode(b, "ISO-8859-1")), "\n"))
    head = head.select("path", F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"), text.alias("head"))

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, encoding, text in zip(b["path"], b["encoding"], b["head"], strict=True):
                name = path.rsplit("/", 1)[1]
                header, rows = _records(text.removeprefix(_MARK), n_rows)
                body = io.StringIO()
                if rows:
                    csv.writer(body, lineterminator="\n").writerows([header, *rows])
                out.append((path, name, encoding, len(rows), f"{name}\n{'=' * len(name)}\n{body.getvalue() or '[INFO] File read successfully but returned 0 rows.'}\n\n"))
            yield pd.DataFrame(out, columns=["path", "name", "encoding", "n_rows", "preview"])

    return head.mapInPandas(shown, "path string, name string, encoding string, n_rows long, preview string")


def write_previews(previews: DataFrame, folder: str) -> None:
    """The previews as text files in a folder, in the order of their paths: a file for each partition."""
    previews.repartitionByRange("path").sortWithinPartitions("path").select(F.regexp_replace("preview", r"\n\z", "").alias("preview")).write.mode("overwrite").text(folder)
