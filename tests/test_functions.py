"""Scalar expressions on hand-made dirty values (FIXTURES.md section 3)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelsight.functions.scalars import (blend, calendar_parts, denormalize_rating, epoch_to_timestamp,
                                         first_number, genre_indicator, join_list, mean_label,
                                         normalize_rating, occupation_name, safe_int, sentinel_null,
                                         split_fields, zip_region)


def test_safe_int_truncates_and_nulls_bad_text(spark):
    df = spark.createDataFrame([("7.8",), ("N/A",), ("",), ("0.0",), ("90, 100",), (None,), (" 3 ",), ("-2.5",)],
                               "v string")
    got = [r[0] for r in df.select(safe_int("v")).collect()]
    assert got == [7, None, None, 0, None, None, 3, -2]


def test_first_number_of_list(spark):
    df = spark.createDataFrame([("90, 100",), ("71",), ("",), (None,), ("abc",)], "v string")
    got = [r[0] for r in df.select(first_number("v")).collect()]
    assert got == [90.0, 71.0, None, None, None]


def test_sentinels_become_null(spark):
    df = spark.createDataFrame([("N/A",), ("",), ("0.0",), ("7.5",), (None,)], "v string")
    assert [r[0] for r in df.select(sentinel_null("v")).collect()] == [None, None, None, "7.5", None]


def test_occupation_name_codes(spark):
    df = spark.createDataFrame([("0",), ("20",), ("21",), (None,), ("4",), ("x",)], "c string")
    got = [r[0] for r in df.select(occupation_name("c")).collect()]
    assert got == ["other or not specified", "writer", "Unknown", "Unknown", "college/grad student", "Unknown"]


def test_split_fields_multichar_and_short_line(spark):
    df = spark.createDataFrame([("1::A (1995)::Drama|War",), ("2::B",)], "value string")
    rows = df.select(*[c.alias(f"f{i}") for i, c in enumerate(split_fields("value", "::", 3))]).collect()
    assert tuple(rows[0]) == ("1", "A (1995)", "Drama|War")
    assert tuple(rows[1]) == ("2", "B", None)


def test_zip_region_keeps_leading_zero(spark):
    df = spark.createDataFrame([("01234",), ("98107-2117",)], "z string")
    assert [r[0] for r in df.select(zip_region("z")).collect()] == ["012", "981"]


def test_genre_indicator_null_and_outside_list(spark):
    df = spark.createDataFrame([("Drama|War",), (None,), ("Western",)], "g string")
    got = df.select(genre_indicator("g", "War").alias("w"), genre_indicator("g", "Drama").alias("d")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 0), (0, 0)]


def test_calendar_parts_sunday_is_one(spark):
    df = spark.createDataFrame([(1704067200,)], "e long")  # 2024-01-01, a Monday
    r = calendar_parts(df.withColumn("ts", epoch_to_timestamp("e")), "ts").collect()[0]
    assert (r.Year, r.Month, r.Day, r.DayOfWeek) == (2024, 1, 1, 2)


def test_join_list(spark):
    df = spark.createDataFrame([(["90", "100"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(join_list("a")).collect()] == ["90, 100", ""]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=5), min_size=1, max_size=20))
def test_denormalize_inverts_normalize(spark, ratings):
    df = spark.createDataFrame([(r,) for r in ratings], "r int")
    back = df.select(denormalize_rating(normalize_rating("r", "minmax"), "minmax").alias("b")).collect()
    assert [round(x.b, 9) for x in back] == [float(r) for r in ratings]


def test_blend_and_mean_label(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.2, 0.4)], "a double, b double, la double, lb double")
    r = df.select(blend("a", "b", 0.7, 0.3).alias("h"), mean_label("la", "lb").alias("m")).collect()[0]
    assert abs(r.h - 0.65) < 1e-12 and abs(r.m - 0.3) < 1e-12


def test_epoch_conversion_ignores_session_zone(spark):
    df = spark.createDataFrame([(1704067200,)], "e long")  # 2024-01-01 00:00:00 UTC
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = calendar_parts(df.withColumn("ts", epoch_to_timestamp("e")), "ts").collect()[0]
        assert (r.Year, r.Month, r.Day, r.DayOfWeek) == (2024, 1, 1, 2)
        local = calendar_parts(df.withColumn("ts", epoch_to_timestamp("e", tz="America/New_York")), "ts").first()
        assert (local.Year, local.Month, local.Day) == (2023, 12, 31)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
