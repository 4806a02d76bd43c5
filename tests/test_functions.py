from datetime import date

import pytest
from pyspark.sql import functions as F

from pacegrid.functions import geo, text, values


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("said", "expected"),
    [("2026-10-13", "2026-10-13T00:00:00"), ("13/10/2026", "2026-10-13T00:00:00"), ("2026-10-13T07:30:00Z", "2026-10-13T07:30:00+00:00"), ("2026-10-13 07:30", "2026-10-13T07:30:00"), ("2026-10-13T07:30:15+0530", "2026-10-13T07:30:15+05:30"), ("2026-10-13T07:30:15.25Z", "2026-10-13T07:30:15.250000+00:00"), ("3/4/2026 18:05", "2026-03-04T18:05:00"), ("2026-02-30", None), ("13 October 2026", "2026-10-13T00:00:00"), ("TBA", None), ("2027", "2027-03-05T00:00:00"), ("no date", None)],
)
def test_dates(spark, said, expected):
    assert one(spark, values.parse_date(F.lit(said), date(2026, 3, 5))) == expected


@pytest.mark.parametrize(("said", "expected"), [("3.1 Miles", ("5K", 4.989)), ("HM", ("Half Marathon", 21.098)), ("1500m", ("1.5K", 1.5)), ("5m", ("5K", 5.0)), ("3.1mi", ("3.1K", 3.1)), ("fun run", ("fun run", None)), ("70.3", ("Ironman 70.3", 113.137))])
def test_distances(spark, said, expected):
    label, km = values.parse_distance(F.lit(said))
    assert tuple(spark.range(1).select(label.alias("a"), km.alias("b")).first()) == expected


def test_text(spark):
    assert one(spark, text.clean_text(F.lit(" <b>Caf&eacute;</b>  &lt;i&gt; "))) == "Café <i>"
    assert one(spark, text.title_key(F.lit("The 5th Edition Run 2026!"))) == "the run"
    assert one(spark, text.clean_text(F.lit("  "))) is None


@pytest.mark.parametrize(("title", "city"), [("HYROX Vilnius", "Vilnius"), ("Winter Hyrox | Porto Novo -", "Porto Novo"), ("HYROX Championship Elite 15 Graz", "Graz"), ("hyrox", None), ("City Run Graz", None)])
def test_brand_city(spark, title, city):
    assert one(spark, geo.brand_city(F.lit(title))) == city


@pytest.mark.parametrize(("km", "near", "expected"), [(0.4, False, "<1 km"), (7.25, True, "~7.3 km"), (1234.4, False, "1,234 km"), (None, True, None)])
def test_distance_text(spark, km, near, expected):
    assert one(spark, geo.distance_text(F.lit(km).cast("double"), F.lit(near))) == expected


def test_small_texts(spark):
    assert one(spark, values.status_name(F.lit("https://schema.org/EventPostponed"))) == "EventPostponed"
    assert one(spark, text.slug_words(F.lit("lake_loop-run"))) == "lake loop run"
    assert one(spark, geo.short_place(F.lit("A, B ,C, D"))) == "A, B, C"
    assert one(spark, values.offers_fold(F.lit('[{"price": "3", "url": "mailto:x@y"}, {"price": 2, "url": " b?x=1 "}]'), F.lit("https://z.test/a/"))[3]) == "https://z.test/a/b?x=1"
