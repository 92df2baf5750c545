import pytest
from pyspark.sql import functions as F

from conftest import rows
from sirenframe import functions as fn


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ('{"a":1}', '{"a":1}'),
        (' ```json\n{"a":1}\n``` ', '{"a":1}'),
        ('```\n{"a":1}```', '{"a":1}'),
        ("```json a ``` b ```json c", "a  b  c"),
        ('here it is: ```json\n{"a":1}\n```', 'here it is: ```json\n{"a":1}\n```'),
        ("  x\xa0", "x"),
    ],
)
def test_strip_code_fences(spark, text, cleaned):
    assert one(spark, fn.strip_code_fences(F.lit(text))) == cleaned


@pytest.mark.parametrize(
    ("text", "parsed"),
    [
        ("11/20/2025 23:59:15", "2025-11-20 23:59:15"),
        ("1/2/2025 3:4:5", "2025-01-02 03:04:05"),
        ("1/ 2/2025  3:4:5", "2025-01-02 03:04:05"),
        ("02/30/2025 10:00:00", None),
        ("012/02/2025 10:00:00", None),
        ("1/2/25 10:00:00", None),
        ("1/2/2025 24:00:00", None),
        ("1/2/2025 10:00:60", None),
        ("1/2/0000 10:00:00", None),
        ("1/2/2025 10:00:00 x", None),
        ("2025-01-02 10:00:00", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, text, parsed):
    column = fn.as_text(fn.parse_datetime_text(F.lit(text).cast("string")))
    assert one(spark, column) == parsed


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ("1/2/2025 3:4:5", None),
        ("02/30/2025 1:1:1", "day is out of range for month"),
        ("1/2/2025 1:1:61", "second must be in 0..59"),
        ("1/2/0000 1:1:1", "year 0 is out of range"),
        ("1/2/2025 1:1:1 pm", "unconverted data remains:  pm"),
        ("soon", "time data 'soon' does not match format '%m/%d/%Y %H:%M:%S'"),
    ],
)
def test_datetime_problem(spark, text, problem):
    column = F.lit(text)
    assert one(spark, fn.datetime_problem(column, fn.parse_datetime_text(column))) == problem


@pytest.mark.parametrize(
    ("start", "end", "night_hours"),
    [(23, 6, {0, 1, 4, 5, 23}), (1, 5, {1, 4}), (4, 4, set())],
)
def test_daypart(spark, start, end, night_hours):
    hours = [0, 1, 4, 5, 6, 22, 23]
    df = spark.createDataFrame([(h, f"2025-01-01 {h:02}:30:00") for h in hours], "h int, t string")
    got = df.select("h", fn.daypart(F.col("t").cast("timestamp_ntz"), start, end))
    assert {h for h, part in rows(got) if part == "night"} == night_hours


# Made from the grammar: territory, then a name before the first slash, then an address up to the first
# number sign; without a slash an ampersand makes all of the rest the address.
LOCATIONS = [
    # territory: one word, or two where the second is a suffix
    ("NORTHFIELD", ("NORTHFIELD", None, None, None)),
    ("NORTHFIELD BORO", ("NORTHFIELD BORO", None, None, None)),
    ("NORTHFIELD TWPLINE RD", ("NORTHFIELD", None, "TWPLINE RD", None)),
    ("BORO 8 CANAL ST", ("BORO", None, "8 CANAL ST", None)),
    # address alone, with and without a unit
    ("HARBOR 3 QUAY", ("HARBOR", None, "3 QUAY", None)),
    ("HARBOR BORO 3 QUAY #B", ("HARBOR BORO", None, "3 QUAY", "B")),
    ("HARBOR TWP #9", ("HARBOR TWP", None, None, "9")),
    # a name before a slash
    ("HARBOR FERRY HOUSE / QUAY 3", ("HARBOR", "FERRY HOUSE", "QUAY 3", None)),
    ("HARBOR TWP FERRY & SONS / QUAY 3 #1-A", ("HARBOR TWP", "FERRY & SONS", "QUAY 3", "1-A")),
    ("HARBOR BORO DEPOT / 5 RAIL ST / REAR", ("HARBOR BORO", "DEPOT", "5 RAIL ST / REAR", None)),
    # crossings
    ("HARBOR RAIL ST & QUAY", ("HARBOR", None, "RAIL ST & QUAY", None)),
    ("HARBOR TWP RAIL ST & QUAY #4", ("HARBOR TWP", None, "RAIL ST & QUAY #4", None)),
    # nothing
    ("\t ", (None, None, None, None)),
]


@pytest.mark.parametrize(("raw", "parts"), LOCATIONS)
def test_parse_location(spark, raw, parts):
    got = one(spark, fn.parse_location(F.lit(raw)))
    assert got["raw"] == raw
    assert tuple(got)[1:] == parts


def test_bound_text_counts_characters(spark):
    assert one(spark, fn.bound_text(F.lit("é" * 301), 300)) == "é" * 300
    assert one(spark, fn.bound_text(F.lit("😀" * 21), 20)) == "😀" * 20
    assert one(spark, fn.bound_text(F.lit(None).cast("string"), 20)) is None
