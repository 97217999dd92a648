"""Column functions, and the places where engines differ."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast import config as c
from shelfcast.functions import dates, labels, text


def one(spark, column, value=None, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2025-01-03", dt.date(2025, 1, 3)),
        ("1970-01-01", dt.date(1970, 1, 1)),
        ("2025-1-3", None),
        ("2025-01-03T10:00:00", None),
        ("2025-02-30", None),
        ("n/a", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date_is_lenient_about_values_not_about_form(spark, value, expected):
    assert one(spark, dates.parse_date(F.col("v")), value) == expected


@pytest.mark.parametrize(
    "day, weekday, weekend", [("2025-01-02", 4, 0), ("2025-01-03", 5, 1), ("2025-01-05", 7, 1), ("2025-01-06", 1, 0)]
)
def test_friday_to_sunday_is_weekend(spark, day, weekday, weekend):
    date = F.lit(day).cast("date")
    assert one(spark, dates.iso_weekday(date)) == weekday
    assert one(spark, dates.is_weekend(date)) == weekend


@pytest.mark.parametrize("value, hour", [(140000, 14), (90500, 9), (0, 0), (-1, -1), (-10000, -1)])
def test_order_hour_rounds_down(spark, value, hour):
    assert one(spark, dates.order_hour(F.col("v")), value, "bigint") == hour


@pytest.mark.parametrize("value, hour", [("140000", 14), ("90500", 90), ("x1", None), ("", None)])
def test_order_hour_from_text(spark, value, hour):
    assert one(spark, dates.order_hour_from_text(F.col("v")), value) == hour


def test_placeholder_becomes_null(spark):
    day = dates.without_placeholder(F.lit("1970-01-01").cast("date"))
    assert one(spark, day) is None
    assert one(spark, dates.without_placeholder(F.lit("1970-01-02").cast("date"))) == dt.date(1970, 1, 2)


def test_shortage_label_table(spark):
    pairs = [(5.0, 5.0), (5.0, 3.0), (5.0, None), (0.0, 0.0), (None, 0.0), (None, 5.0), (-1.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i INT, o DOUBLE, r DOUBLE")
    label = labels.shortage_label(F.col("o"), F.coalesce("r", F.lit(0.0)))
    got = [r["x"] for r in df.select("i", label.alias("x")).orderBy("i").collect()]
    assert got == [0, 1, 1, 0, None, None, 0]


@pytest.mark.parametrize(
    "p, level",
    [
        (0.8, c.CRITICAL), (0.79999, c.HIGH), (0.5, c.HIGH), (0.3, c.MEDIUM), (0.29, c.LOW),
        (None, c.LOW), (float("nan"), c.LOW), (1.0, c.CRITICAL),
    ],
)
def test_risk_bands(spark, p, level):
    assert one(spark, labels.risk_level(F.col("v")), p, "double") == level


def test_action_and_substitute_texts(spark):
    some, none = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    assert one(spark, labels.recommended_action(some)) == c.ACTION_LABELS[0]
    assert one(spark, labels.recommended_action(none)) == c.ACTION_LABELS[1]
    assert one(spark, text.joined_substitutes(some)) == "a, b"
    assert one(spark, text.joined_substitutes(none)) == "None Found"


@pytest.mark.parametrize("p, a, b", [(0.12345, "12.3%", "12.35%"), (1.0, "100.0%", "100.00%"), (0.0, "0.0%", "0.00%")])
def test_percent_texts(spark, p, a, b):
    assert one(spark, text.percent_one(F.col("v")), p, "double") == a
    assert one(spark, text.percent_two(F.col("v")), p, "double") == b


def test_order_option_round_trip(spark):
    label = text.order_option(F.lit(17), F.lit("40 | x"))
    assert one(spark, label) == "Order: 17 | Product: 40 | x"
    assert one(spark, text.option_order_number(label)) == 17
    assert one(spark, text.option_product_code(label)) == "40 | x"


@pytest.mark.parametrize(
    "payload, number, email",
    [
        ('{"orderNumber": "12", "customerEmail": " a@b "}', 12.0, "a@b"),
        ('{"body": {"orderNumber": 7, "customerEmail": "x@y"}}', 7.0, "x@y"),
        ('{"orderNumber": 1, "customerEmail": "flat", "body": {"orderNumber": 2, "customerEmail": "body"}}', 1.0, "body"),
        ("{}", 0.0, ""),
        ('{"orderNumber": "abc", "body": {"orderNumber": 2}}', None, ""),
        ('{"orderNumber": "NaN"}', None, ""),
        ('{"orderNumber": null, "body": {"orderNumber": 3}}', 3.0, ""),
        ("no json", 0.0, ""),
    ],
)
def test_request_fields(spark, payload, number, email):
    assert one(spark, text.request_number(F.col("v"), "orderNumber"), payload) == number
    assert one(spark, text.request_email(F.col("v")), payload) == email


@pytest.mark.parametrize(
    "value, number",
    [
        ('"5d"', None), ('"1f"', None), ('""', 0.0), ('"  "', 0.0), ('"\\t 12 \\n"', 12.0), ('"\\u00a07\\ufeff"', 7.0), ("true", 1.0), ("false", 0.0), ('"true"', None),
        ('"0x10"', 16.0), ('"0XfF"', 255.0), ('"0b101"', 5.0), ('"0o17"', 15.0), ('"-0x1"', None), ('"0x"', None), ('"+5"', 5.0), ('"-.5e1"', -5.0), ('"5."', 5.0),
        ('"."', None), ('"1e3"', 1000.0), ('"1_000"', None), ('"1,5"', None), ('"Infinity"', float("inf")), ('"-Infinity"', float("-inf")), ('"infinity"', None),
        ("12", 12.0), ("1.25", 1.25), ("-3e2", -300.0), ("[]", 0.0), ("[4]", 4.0), ('["0x4"]', 4.0), ("[null]", 0.0), ("[true]", None), ("[1, 2]", None), ('{"a": 1}', None), ("null", 0.0),
    ],
)
def test_number_grammar(spark, value, number):
    assert one(spark, text.request_number(F.col("v"), "n"), f'{{"n": {value}}}') == number
    assert one(spark, text.request_number(F.col("v"), "n"), f'{{"n": null, "body": {{"n": {value}}}}}') == number


@pytest.mark.parametrize("x, expected", [(12.0, "12"), (1.35, "1.35"), (9000499.0, "9000499")])
def test_number_text(spark, x, expected):
    assert one(spark, text.number_text(F.col("v")), x, "double") == expected
