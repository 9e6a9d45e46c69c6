from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keyloom.functions import dates
from keyloom.operators import profile
from keyloom.plans.cells import frequencies


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-02-29", datetime(2024, 2, 29)),
        ("2023-02-29", None),
        ("2024/2/9", datetime(2024, 2, 9)),
        ("31.12.2020", datetime(2020, 12, 31)),
        ("12/31/2020", datetime(2020, 12, 31)),
        ("02/03/2020", datetime(2020, 2, 3)),
        ("13/13/2020", None),
        ("20200131", datetime(2020, 1, 31)),
        ("20201331", None),
        ("1999", datetime(1999, 1, 1)),
        ("0999", None),
        ("12345", None),
        ("5 Jan 2020", datetime(2020, 1, 5)),
        ("5-sept-2020", datetime(2020, 9, 5)),
        ("5 Jin 2020", None),
        ("March 7, 2021 3:04 PM", datetime(2021, 3, 7, 15, 4)),
        ("Mar 7 2021 12:00 AM", datetime(2021, 3, 7)),
        ("2020-01-02T03:04:05.123Z", datetime(2020, 1, 2, 3, 4, 5)),
        ("2020-01-02 25:00:00", None),
        ("2020-01-02 03:04:05+02:00", datetime(2020, 1, 2, 3, 4, 5)),
        ("1-2", None),
        ("", None),
        ("x" * 5000, None),
        (None, None),
    ],
)
def test_single_texts(spark, text, want):
    got = spark.createDataFrame([(text,)], "v string").select(dates.parse_date(F.col("v")).cast("timestamp_ntz")).first()[0]
    assert got == want


def _induced(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r["mask"]: (r["order"], r["cells"], r["dates"]) for r in profile.induced_dates(frequencies({"t": df}), **kw).collect()}


def test_orders_follow_the_ranges_of_a_mask(spark):
    assert _induced(spark, ["01/02/2020", "25/02/2020", "25/02/2020"]) == {"99/99/9999": ("dmy", 3, 3)}
    assert _induced(spark, ["01/02/2020", "02/25/2020"]) == {"99/99/9999": ("mdy", 2, 2)}
    assert _induced(spark, ["13/02/2020", "02/25/2020", "13/13/2020"]) == {"99/99/9999": ("mixed", 3, 2)}
    assert _induced(spark, ["01/02/2020"]) == {"99/99/9999": ("mdy", 1, 1)}
    assert _induced(spark, ["01/02/2020"], day_first=True) == {"99/99/9999": ("dmy", 1, 1)}
    assert _induced(spark, ["1/2/2020", "01.02.2020", "text", "7", None]) == {"9/9/9999": ("mdy", 1, 1), "99.99.9999": ("mdy", 1, 1)}


def test_types_and_conversion_use_the_induced_order(spark):
    df = spark.createDataFrame([(f"{1 + i % 12:02}.{1 + i % 28:02}.2020", str(i)) for i in range(100)], "day string, n string")
    freq = frequencies({"t": df})
    types = {r["column_name"]: r["atomic_type"] for r in profile.decide_types(profile.type_ratios(freq)).collect()}
    assert types == {"day": "date", "n": "int"}
    out = profile.convert(df, types, profile.induced_dates(freq)).select(F.col("day").cast("timestamp_ntz").alias("d"), "n").collect()
    assert [r["d"] for r in out] == [datetime(2020, 1 + i % 12, 1 + i % 28) for i in range(100)] and [r["n"] for r in out] == list(range(100))


def test_an_order_is_used_for_values_that_leave_it_open(spark):
    df = spark.createDataFrame([("05/06/2020",), ("25/06/2020",)], "day string")
    out = profile.convert(df, {"day": "date"}, profile.induced_dates(frequencies({"t": df})))
    assert [r[0] for r in out.select(F.date_format("day", "dd.MM")).collect()] == ["05.06", "25.06"]
