"""Time, rounding and label rules on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.functions import scalars as s
from orderlens.plans.rfm import frequency_score, segment


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "end, floor, fraction",
    [
        ("2018-01-01 23:00:00", -1, -1 / 24),
        ("2018-01-02 05:00:00", 0, 5 / 24),
        ("2018-01-03 01:00:00", 1, 25 / 24),
    ],
)
def test_day_differences(spark, end, floor, fraction):
    start = ts("2018-01-02 00:00:00")
    assert value(spark, s.days_floor(start, ts(end))) == floor
    assert value(spark, s.days_fraction(start, ts(end))) == pytest.approx(fraction)


def test_truncation_goes_toward_zero(spark):
    start = ts("2018-01-02 00:00:00")
    assert value(spark, s.days_truncated(start, ts("2017-12-31 12:00:00"))) == -1
    assert value(spark, s.days_truncated(start, ts("2018-01-03 23:00:00"))) == 1


def test_weekday_conventions_and_month(spark):
    monday = ts("2018-08-27 10:00:00")
    assert value(spark, s.weekday_monday0(monday)) == 0
    assert value(spark, s.weekday_sunday0_text(monday)) == "1"
    assert value(spark, s.year_month(monday)) == "2018-08"


def test_time_rules_ignore_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        # the clock jumped over this hour in Sao Paulo
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        a, b = ts("2018-11-03 23:30:00"), ts("2018-11-04 00:30:00")
        assert value(spark, s.seconds_between(a, b)) == 3600
        assert value(spark, F.hour(b)) == 0
        assert value(spark, s.year_month(b)) == "2018-11"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_half_rounding(spark):
    x = F.lit(0.125)
    assert value(spark, s.half_even(x, 2)) == 0.12
    assert value(spark, s.half_up(x, 2)) == 0.13
    assert value(spark, s.half_up(-x, 2)) == -0.13


def test_bad_timestamp_is_null(spark):
    assert value(spark, s.parse_timestamp(F.lit("bad"))) is None
    good = value(spark, s.parse_timestamp(F.lit("2017-10-02 10:56:33")))
    assert good == dt.datetime(2017, 10, 2, 10, 56, 33)


def test_ratio_of_zero_is_null(spark):
    assert value(spark, s.ratio(F.lit(1), F.lit(0))) is None


def test_clip_keeps_null(spark):
    none = F.lit(None).cast("double")
    assert value(spark, s.clip(none, F.lit(1.0), F.lit(5.0))) is None
    assert value(spark, s.clip(F.lit(7.0), F.lit(1.0), F.lit(5.0))) == 5.0
    assert value(spark, s.clip(F.lit(0.0), low=F.lit(1.0))) == 1.0


def test_wilson(spark):
    low, high = s.wilson(F.lit(0), F.lit(50))
    assert value(spark, low) == 0
    assert value(spark, high) == pytest.approx(7.135, abs=1e-3)
    low, high = s.wilson(F.lit(0), F.lit(0))
    assert value(spark, low) is None and value(spark, high) is None


def test_effect_labels(spark):
    sizes = {0.05: "Small", -0.2: "Moderate", 0.3: "Large"}
    assert {k: value(spark, s.effect_label(F.lit(k))) for k in sizes} == sizes


@pytest.mark.parametrize(
    "r, f, name",
    [
        (4, 5, "Champions"),
        (3, 5, "Loyal"),
        (4, 3, "Loyal"),
        (5, 1, "New Customers"),
        (2, 3, "At Risk"),
        (1, 1, "Lost"),
        (3, 1, "Others"),
    ],
)
def test_segment_rule(spark, r, f, name):
    assert value(spark, segment(F.lit(r), F.lit(f))) == name


def test_frequency_score(spark):
    got = [value(spark, frequency_score(F.lit(n))) for n in (1, 2, 3, 9)]
    assert got == [1, 3, 5, 5]
