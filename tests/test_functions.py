from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillwise.functions import calendar, measures, rules, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_delta_and_change(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, measures.delta(a, b), a=15.0, b=10.0) == 50.0
    assert one(spark, measures.delta(a, b), a=15.0, b=0.0) == 0.0
    assert one(spark, measures.change_percent(a, b), a=15.0, b=0.0) is None
    assert one(spark, measures.change_percent(a, b), a=5, b=-10) == -150.0


def test_means_and_shares(spark):
    df = spark.createDataFrame([("x", 1), ("y", None), ("x", 4)], "k string, v int")
    got = df.agg(
        measures.exact_mean("v"),
        measures.share_of_rows(F.col("k") == "x"),
        F.count("v"),
        F.countDistinct("k"),
    ).first()
    assert tuple(got) == (2.5, 200 / 3, 2, 2)
    none = df.where("false").agg(
        measures.exact_mean("v"), measures.share_of_rows(F.col("k") == "x")
    )
    assert tuple(none.first()) == (None, None)


def test_ordered_mean_skips_nulls(spark):
    df = spark.createDataFrame(
        [("b", 0.2), ("a", 0.1), ("c", None), ("d", 0.3)], "k string, v double"
    )
    assert df.agg(measures.ordered_mean("k", "v")).first()[0] == (0.1 + 0.2 + 0.3) / 3


@pytest.mark.parametrize("value, digits", [(12.25, 1), (12.35, 1), (0.125, 2), (33.333, 1), (2.5, 0)])
def test_round_half_even_is_array_rounding(spark, value, digits):
    numpy = pytest.importorskip("numpy")
    assert one(spark, measures.round_half_even(F.col("v"), digits), v=value) == float(
        numpy.round(value, digits)
    )


def test_week_label_is_strftime_w(spark):
    first = date(1994, 12, 20)
    days = spark.range(14000).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("d")
    )
    got = rows(days.select("d", calendar.week_label(F.col("d"))))
    assert all(label == d.strftime("%Y-W%W") for d, label in got)
    assert dict(got)[date(2000, 1, 2)] == "2000-W00"
    assert dict(got)[date(2000, 1, 3)] == "2000-W01"


def test_calendar_parts(spark):
    day = F.lit(date(2024, 2, 14))
    got = spark.range(1).select(
        calendar.week_end(day),
        calendar.weekday_number(day),
        calendar.weekday_name(day),
        calendar.month_name(day),
        calendar.months_between_months(F.lit(date(2024, 1, 1)), day),
        calendar.add_hours(day, F.lit(47.99)),
        calendar.add_hours(day, F.lit(48)),
    )
    assert rows(got) == [
        (date(2024, 2, 18), 3, "Wed", "Feb", -1, date(2024, 2, 15), date(2024, 2, 16))
    ]


@pytest.mark.parametrize("value", [0.25, 0.15, 0.35, 2.675, 1234567.85, 999.95, 43.0])
def test_display_numbers_round_as_format_does(spark, value):
    v = F.col("v")
    assert one(spark, text.grouped(v, 1), v=value) == f"{value:,.1f}"
    assert one(spark, text.suffixed(v, 1, "%"), v=value) == f"{value:.1f}%"
    assert one(spark, text.money_text(v), v=value) == f"₹{value:,.0f}"
    assert one(spark, text.lakh_text(v), v=value) == f"₹{value / 100000:.1f}L"


def test_texts(spark):
    assert one(spark, text.signed_percent(F.col("v")), v=-1.25) == "-1.2%"
    assert one(spark, text.signed_percent(F.col("v")), v=0.0) == "+0.0%"
    assert one(spark, text.code("ORD", 6, F.col("v")), v=17) == "ORD000017"
    assert one(spark, text.contact_handle(F.col("v")), v="Ada de Vries") == "ada.de.vries"


@pytest.mark.parametrize(
    "spent, tier",
    [(50000, "Platinum"), (49999.99, "Gold"), (20000, "Gold"), (8000, "Silver"), (7999, "Bronze"), (0, "Bronze")],
)
def test_tier_thresholds_are_inclusive(spark, spent, tier):
    assert one(spark, rules.tier_of(F.col("v"), rules.TIER_THRESHOLDS), v=spent) == tier


def test_lookups(spark):
    zone = rules.lookup(F.col("v"), rules.ZONE_OF_STATE, rules.DEFAULT_ZONE)
    assert one(spark, zone, v="Kerala") == "South"
    assert one(spark, zone, v="Atlantis") == "North"
    assert one(spark, rules.lookup(F.col("v"), rules.FESTIVAL_WEIGHT_OF_MONTH, 1.0), v=10) == 2.8
    assert one(spark, rules.rank_in(F.col("v"), rules.TIERS), v="Gold") == 2
    assert one(spark, rules.rank_in(F.col("v"), rules.TIERS), v="Tin") == 5
    first = rules.first_containing(
        F.col("v"), {"Orders": "1", "late orders": "2"}, F.lit("none")
    )
    assert one(spark, first, v="Late ORDERS") == "1"
    assert one(spark, first, v="returns") == "none"


def test_dates_of_period():
    from tillwise import Period

    period = Period.of("2024-01-01", "2024-01-31")
    assert period.prior() == Period.of("2023-12-02", "2023-12-31")
    day = Period.of("2024-01-01", "2024-01-01")
    assert day.prior() == Period.of("2023-12-31", "2023-12-31")
    assert period.with_prior().end - period.with_prior().start == timedelta(days=60)
    with pytest.raises(ValueError, match="after its end"):
        Period.of("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError, match="outside the data"):
        period.within(date(2024, 1, 2), date(2024, 12, 31))
    assert period.within(date(2022, 1, 1), date(2024, 12, 31)) == period


def test_filters(spark):
    from tillwise import Filters

    df = spark.createDataFrame([("A", "x"), ("B", "x"), (None, "y")], "state string, zone string")
    for none in ("All", "", None):
        assert df.where(Filters(state=none).on("state", "zone")).count() == 3
    assert rows(df.where(Filters(state="A").on("state", "zone"))) == [("A", "x")]
    assert df.where(Filters(state="A' OR '1'='1").on("state")).count() == 0
    shown = Filters(state="A", segment="SME").summary()
    assert one(spark, shown) == "State: A / Segment: SME"
    assert one(spark, Filters().summary()) == "No filters applied"


def test_quoted_text_is_itself(spark):
    from tillwise.functions.text import quoted

    for value in ("it's", "back\\slash", "both \\' of", "₹", ""):
        assert spark.range(1).selectExpr(f"{quoted(value)} AS v").first()[0] == value
