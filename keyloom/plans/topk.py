"""The first few rows of groups, by partial results: each task keeps its own first ones of a group, and what is left of the tasks is merged, cut and gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_groups(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """``df`` with ``place``, only the first ``k`` rows of each group. The filter on the rank is worked out before the shuffle as well: a task sends k rows of a group at most."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def examples(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by, examples): the ``k`` smallest different values of each group, in order; nulls are no values."""
    one = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    return first_of_groups(one, by, [value], k).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("examples"))
