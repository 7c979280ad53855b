import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tabulant.functions.casts import DATETIME_LAYOUTS, _shape, infer_layouts, instant, iso_text, try_number

NUMBERS = {
    "1": 1.0, " 1 ": 1.0, "+1": 1.0, "1.": 1.0, ".5": 0.5, "1e3": 1000.0, "-2.5E-1": -0.25,
    "inf": float("inf"), "Infinity": float("inf"), "-Infinity": float("-inf"), "+inf": float("inf"), " inf": None,
    "1d": None, "1f": None, "1.5D": None, "1L": None, "nan": None, "NaN": None, "0x10": None, "0x1p3": None,
    "1,000": None, "1_000": None, "True": None, "": None, "  ": None, "1e400": None, "-1e400": None,
    "--1": None, "١": None, "12abc": None, ".": None, "1e": None,
}


def test_numbers_from_text(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS] + [(None,)], "t string")
    got = {r.t: r.x for r in rows.select("t", try_number(F.col("t")).alias("x")).collect()}
    assert got == {**NUMBERS, None: None}


D = dt.datetime
DATES = [
    (["2024-01-01", "2024-01-02 10:00", "01/02/2024"], [D(2024, 1, 1), None, None]),
    (["01/02/2024", "13/02/2024", "2024-01-01"], [D(2024, 1, 2), None, None]),
    (["13/02/2024", "01/02/2024"], [D(2024, 2, 13), D(2024, 2, 1)]),
    (["2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00", "2024-01-01"], [D(2024, 1, 1, 10), D(2024, 1, 1, 8), None]),
    (["20240101", "2024-01-01"], [D(2024, 1, 1), None]),
    (["Jan 5 2024", "2024-01-01"], [D(2024, 1, 5), None]),
    ([None, "bad", "2024-01-01"], [None, None, D(2024, 1, 1)]),
    (["2024", "2024-05"], [D(2024, 1, 1), None]),
    (["2024-02-30"], [None]),
    (["1700000000"], [None]),
    (["1600-01-01", "9999-12-31"], [D(1600, 1, 1), D(9999, 12, 31)]),
    (["2024-01-01 10:00:00.25", "2024-01-01 10:00:00.000001"], [D(2024, 1, 1, 10, 0, 0, 250000), D(2024, 1, 1, 10, 0, 0, 1)]),
    (["2024-01-01 10:00", "2024-01-01 23:59"], [D(2024, 1, 1, 10), D(2024, 1, 1, 23, 59)]),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_first_value_fixes_the_layout(spark, zone):
    names = [f"t{i}" for i in range(len(DATES))]
    depth = max(len(texts) for texts, _ in DATES)
    cells = [[texts[i] if i < len(texts) else None for texts, _ in DATES] for i in range(depth)]
    rows = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(cells)], "i int, " + ", ".join(f"{n} string" for n in names)
    )
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        layouts = infer_layouts(rows, names, [F.col("i")])
        read = rows.select("i", *(instant(rows, n, layouts[n]).alias(n) for n in names)).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, (texts, expected) in zip(names, DATES):
        assert [r[name] for r in read][: len(texts)] == expected, texts


def test_shapes_fit_their_layouts():
    texts = ["2024-1-05", "2024-01-05 10:20", "01/02/2024 10:20:30", "Jan 5 2024", "2024-01-01T10:00:00.123+02:00", "20240105", "2024"]
    fits = [[i for i, one in enumerate(DATETIME_LAYOUTS) if re.search(_shape(one), t)] for t in texts]
    assert [[DATETIME_LAYOUTS[i] for i in f] for f in fits] == [
        ["yyyy-M-d"], ["yyyy-M-d HH:mm"], ["M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss"], ["MMM d yyyy"],
        ["yyyy-M-d'T'HH:mm:ss.SSSSSSSSSXXX"], ["yyyyMMdd"], ["yyyy"],
    ]


def test_wall_clock_in_a_gap_survives_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string")
        got = rows.select(iso_text(instant(rows, "t", "yyyy-M-d HH:mm:ss")).alias("x")).first().x
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == "2024-03-10T02:30:00+00:00"


def test_iso_text_fraction(spark):
    rows = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 1, 1, 2, 3, 500000),)], "t timestamp_ntz")
    got = [r.x for r in rows.select(iso_text(F.col("t")).alias("x")).collect()]
    assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T01:02:03.500000+00:00"]
