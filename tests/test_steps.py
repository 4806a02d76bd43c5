"""Work on rows: each step stands once in the plan, and small tables are dealt to several tasks."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from pacegrid.functions import text, values
from pacegrid.operators import lineage
from pacegrid.plans import catalog, pages, places, runs  # noqa: F401  the others register their queries in catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def times(df, *names):
    """How often functions stand in a query's plan."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")
    return sum(plan.count(f"{name}(") for name in names)


def test_small_tables_are_dealt(spark):
    few = spark.range(0, 60_001, 1, 1)
    assert lineage.dealt(few).rdd.getNumPartitions() == 3 and lineage.dealt(few).count() == 60_001
    assert lineage.dealt(spark.range(0, 60_001, 1, 9)).rdd.getNumPartitions() == 9
    assert lineage.dealt(spark.range(0, 25_000, 1, 1)).rdd.getNumPartitions() == 1


@tables
def test_address_steps_stand_once(spark):
    # two for each of the 19 keys; they stood there in each of the places that named the address
    assert times(catalog.QUERIES["address_flatten"](spark, SF), "get_json_object") <= 38


def test_odd_addresses(spark):
    said = [None, "", " Main St &amp; Co ", "{}", '{"street": {"name": "A"}, "city": "B", "state": "b", "zip": 7}', '{"street": " ", "line1": "<b>C</b>", "area": {"x": 1}}', '{"country": null, "region": ""}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, json string")
    found = values.with_address(df, F.col("json"), {c: c for c in ("address", "city", "region", "country")}).orderBy("k").drop("k", "json").collect()
    assert [tuple(r) for r in found] == [(None,) * 4, (None,) * 4, ("Main St & Co", None, None, None), (None,) * 4, ("A, B, 7", "B", "b", None), ("C", None, None, None), (None,) * 4]
    address, city, region, country = values.flatten_address(F.col("json"), full_entities=False)
    assert [tuple(r) for r in df.orderBy("k").select(address, city, region, country).collect()] == [tuple(r) for r in found]


@tables
def test_offer_steps_stand_once(spark):
    assert times(catalog.QUERIES["offers_fold"](spark, SF), "get_json_object") <= 32


def test_odd_offers(spark):
    said = [None, "", "[]", "7", '{"price": "1,000.5"}', '[{"price": true, "url": "mailto:x@y"}, {"lowPrice": 2e1, "url": " b?x=1 ", "priceCurrency": " EUR "}, {"price": -3, "url": "c"}, 4, null]']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, json string")
    names = ("price_min", "price_max", "currency", "link")
    found = [tuple(r) for r in values.with_offers(df, F.col("json"), F.lit("https://z.test/a/"), {c: c for c in names}).orderBy("k").drop("k", "json").collect()]
    assert found == [(None,) * 4] * 4 + [(1000.5, 1000.5, None, None), (-3.0, 20.0, "EUR", "https://z.test/a/b?x=1")]
    assert [tuple(r) for r in df.orderBy("k").select(*values.offers_fold(F.col("json"), F.lit("https://z.test/a/"), False)).collect()] == found


@tables
@pytest.mark.parametrize(("name", "most"), [("detail_pages", 300), ("service_races", 120)])
def test_mapper_steps_stand_once(spark, name, most):
    assert times(catalog.QUERIES[name](spark, SF), "get_json_object") <= most


@tables
def test_date_steps_stand_once(spark):
    # texts of a list and of the start; each Arrow function had copies of these steps (4 and 139)
    df = catalog.QUERIES["service_races"](spark, SF)
    assert times(df, "concat_ws") <= 2 and times(df, "regexp_replace") <= 40


def test_date_lists(spark, monkeypatch):
    said = [None, [], ["5/2/2030 09:00", None, "2030-05-02 07:00", "tba"], ["13 May 2030", " 13/5/2030", "x"], ["1/1/0000", "2030-01-01T07:00-00:00", "2030-01-01T07:00+25:00", "<b>2030</b>"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, said array<string>")
    read = lambda df: [r.read for r in values.with_date_list(df, "read", F.col("said"), date(2029, 6, 1)).orderBy("k").collect()]
    common = [None, [], ["2030-05-02T09:00:00", "2030-05-02T07:00:00"]]
    assert read(df) == [*common, ["2030-05-13T00:00:00", "2030-05-13T00:00:00"], ["2030-01-01T07:00:00+00:00", "2030-06-01T00:00:00"]]
    # lists of common forms only are not read by the Arrow function: this one would turn all it is given into nothing
    monkeypatch.setattr(values, "_fallback_list", lambda day: F.pandas_udf(lambda lists: lists.map(lambda own: own[:0] if len(own) == 0 else [None] * (1 // 0)), "array<string>"))
    assert read(df.where("k < 3")) == common


def test_odd_dates_are_left_to_the_slow_reader(spark):
    said = ["0000-01-01", "1/1/0000", "2030-01-01T07:00+25:00", "2030-01-01T07:00-0000", "2030-01-01T07:00+05:60", "2030-01-01T07:00-0001"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, said string")
    found = [None, None, None, "2030-01-01T07:00:00+00:00", "2030-01-01T07:00:00+06:00", "2030-01-01T07:00:00-00:01"]
    assert [r[0] for r in values.with_dates(df, {"read": F.col("said")}, date(2029, 6, 1)).orderBy("k").select("read").collect()] == found
    assert [r[0] for r in df.orderBy("k").select(values.parse_date(F.col("said"), date(2029, 6, 1))).collect()] == found


def test_keys_are_found_as_before(spark):
    said = ['{"a": 1}', '{"\\u0061": 2}', '{"b": "a"}', '{"a": {"b": [1]}}', "", None, "a"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, json string")
    for path in ("a", "a.b"):
        assert df.where(~text.json_at(F.col("json"), path).eqNullSafe(F.get_json_object("json", f"$.{path}"))).count() == 0
    assert df.select(text.json_at(F.col("json"), "a")).where("k = 1").first()[0] == "2"


@tables
@pytest.mark.parametrize("name", ["json_ld_events", "detail_pages", "service_races"])
def test_pages_are_dealt(spark, name, monkeypatch):
    monkeypatch.setattr(lineage, "DEALT_ROWS", 67)
    assert "Repartition 3, true" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_distance_sets_of_pairs(spark):
    """Sizes that are labels, whole and odd kilometres of their own, and the half marathon itself; the query named parse_distances() with texts."""
    part = spark.createDataFrame([(1, 10), (2, 21), (3, 42), (4, 7)], "p_partkey long, p_size int")
    found = places.distance_sets(lambda name: {"part": part}[name]).orderBy("p_partkey").collect()
    assert [tuple(r) for r in found] == [(1, "10K, Half Marathon", 10.0, 21.098), (2, "Half Marathon", 21.0, 21.098), (3, "Marathon, Half Marathon", 21.098, 42.0), (4, "7K, Half Marathon", 7.0, 21.098)]
