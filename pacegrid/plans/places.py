"""Registered queries of places, coordinates, distances and lists, over rows made from the driver's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.functions import fixed, geo, text, values
from pacegrid.operators import geocode, nearby, relational, search
from pacegrid.operators.lineage import new_folder
from pacegrid.plans.catalog import _LABEL, query
from pacegrid.streaming import lookups


def _living(t) -> DataFrame:
    """Customers with the names of their nation and region."""
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


_LIVING = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' East' WHEN 2 THEN n_name WHEN 3 THEN n_name END AS city FROM nation")
def branded_city(t):
    """Cities in branded titles; a title without the brand, or with nothing behind it, has none."""
    n, name = F.col("n_nationkey") % 5, F.col("n_name")
    title = F.when(n == 0, F.concat(F.lit("HYROX "), name)).when(n == 1, F.concat(F.lit("Acme Hyrox - "), name, F.lit("  East ||"))).when(n == 2, F.concat(F.lit("hyrox Youngstars "), name)).when(n == 3, F.concat(F.lit("HYROX to HYROX: World Championship "), name)).otherwise(F.concat(name, F.lit(" HYROX")))
    return t("nation").select("n_nationkey", geo.brand_city(title).alias("city"))


@query("SELECT c_custkey, concat_ws(', ', c_name, n_name, r_name) AS place FROM " + _LIVING)
def short_place(t):
    """The first three parts of long place names."""
    return _living(t).select("c_custkey", geo.short_place(F.concat(F.col("c_name"), F.lit(",  "), F.col("n_name"), F.lit(" ,"), F.col("r_name"), F.lit(", Earth, Sol"))).alias("place"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CASE WHEN c_custkey % 2 = 0 THEN '~' ELSE '' END || CASE WHEN km < 1 THEN '<1 km' WHEN km < 10 THEN printf('%.1f km', km) ELSE format('{:,} km', CAST(floor(km + 0.5) AS BIGINT)) END END AS distance
FROM (SELECT c_custkey, c_custkey * (c_custkey % 10) / 7.0 AS km FROM customer)""")
def distance_text(t):
    """Distances as a viewer reads them."""
    key = F.col("c_custkey")
    km = F.when(key % 11 != 0, key * (key % 10) / F.lit(7.0))
    return t("customer").select("c_custkey", geo.distance_text(km, key % 2 == 0).alias("distance"))


@query(f"""SELECT p_partkey, CASE WHEN label = 'Half Marathon' THEN label ELSE label || ', Half Marathon' END AS labels, least(km, 21.098) AS shortest, greatest(km, 21.098) AS longest
FROM (SELECT p_partkey, km, {_LABEL} AS label FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS km FROM part))""")
def distance_sets(t):
    """Several spellings of distances as distinct labels in order and distinct kilometres."""
    size = F.col("p_size").cast("string")
    texts = F.array(F.concat(size, F.lit(" km")), F.concat(size, F.lit("K")), F.lit("half marathon"), F.lit(None).cast("string"), F.lit("Half Marathon"))
    labels, kms = values.parse_distances(F.col("pairs"))
    return t("part").withColumn("pairs", values.distance_pairs(texts)).select("p_partkey", F.array_join(labels, ", ").alias("labels"), F.array_min(kms).alias("shortest"), F.array_max(kms).alias("longest"))


@query("SELECT p_partkey, p_name || ' ' || p_partkey AS words, 'Event' || p_type AS status FROM part")
def slug_words(t):
    """Titles out of slugs, and names out of status links."""
    slug = F.concat(F.translate("p_name", " ", "-"), F.lit("_"), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", text.slug_words(slug).alias("words"), values.status_name(F.concat(F.lit("https://schema.org/Event"), F.col("p_type"))).alias("status"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CASE event_id % 4 WHEN 0 THEN 'a,' || event_type WHEN 1 THEN event_type ELSE '' END AS listed,
  CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN event_type END AS first FROM events""")
def json_lists(t):
    """JSON with trailing commas repaired; lists, scalars, empty lists and nulls read as lists."""
    n = F.col("event_id") % 4
    said = F.when(n == 0, F.concat(F.lit('["a", null, "'), F.col("event_type"), F.lit('"]'))).when(n == 1, F.col("event_type")).when(n == 2, "[]")
    repaired = text.repair_json(F.concat(F.lit("[1, "), F.regexp_replace("props", r"\}$", " , }"), F.lit(",\n]")))
    return t("events").select("event_id", F.get_json_object(repaired, "$[1].k").alias("k"), F.array_join(text.coerce_list(said), ",").alias("listed"), text.first_of(said).alias("first"))


_NAMED = f"""named AS (SELECT c_custkey, n_nationkey, n_name AS city, CASE c_custkey % 3 WHEN 0 THEN r_name WHEN 1 THEN lower(n_name) END AS region, CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'India' END AS country,
  CASE WHEN c_custkey % 2 = 0 THEN 'in' ELSE '' END AS code FROM {_LIVING})"""


def _named(t) -> DataFrame:
    """Customers as events; every fifth has coordinates of its own, a third a region apart from the city, a third one equal to it."""
    key, city = F.col("c_custkey"), F.col("n_name")
    own = lambda x: F.when(key % 5 == 0, F.lit(x))
    return _living(t).select(
        key.cast("string").alias("id"), city.alias("city"), F.when(key % 3 == 0, F.col("r_name")).when(key % 3 == 1, F.lower(city)).alias("region"), F.when(key % 2 == 0, "IN").otherwise("India").alias("country"),
        own(1.5).alias("latitude"), own(2.5).alias("longitude"), F.lit(None).cast("string").alias("coords_source"),
    )


@query(f"""WITH {_NAMED} SELECT CAST(c_custkey AS VARCHAR) AS id, 0 AS rank, lower(city || CASE WHEN c_custkey % 3 = 0 THEN ', ' || region ELSE '' END) || '|' || code AS key FROM named WHERE c_custkey % 5 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, lower(city) || '|' || code FROM named WHERE c_custkey % 5 <> 0 AND c_custkey % 3 = 0""")
def place_keys(t):
    """Lookup keys of events without coordinates, with the region first where it tells more than the city."""
    return geocode.place_keys(_named(t)).select("id", "rank", "key")


def _places(t) -> DataFrame:
    """Known places: nations, some not found, some by old rules; every second nation with its region, too."""
    nation, n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    alone = nation.select(geo.place_key(F.col("n_name"), F.lit("IN")).alias("key"), F.col("n_name").alias("query"), (n + 0.5).alias("latitude"), (n % 4 != 0).alias("found"), F.when(n % 5 == 0, fixed.CACHE_VERSION - 1).otherwise(fixed.CACHE_VERSION).alias("version"))
    both = F.concat_ws(", ", "n_name", "r_name")
    exact = nation.where(n % 2 == 0).select(geo.place_key(both, F.lit("IN")).alias("key"), both.alias("query"), (n + 0.25).alias("latitude"), F.lit(True).alias("found"), F.lit(fixed.CACHE_VERSION).alias("version"))
    return alone.union(exact).withColumns({"country": F.lit("IN"), "longitude": F.lit(10.0)})


_ANNOTATED = f"""WITH {_NAMED}, annotated AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN 1.5 WHEN code = '' THEN NULL WHEN c_custkey % 3 = 0 AND n_nationkey % 2 = 0 THEN n_nationkey + 0.25
  WHEN n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 THEN n_nationkey + 0.5 END AS latitude, c_custkey % 5 = 0 AS had FROM named)"""


@query(f"{_ANNOTATED} SELECT id, CAST(latitude AS DOUBLE) AS latitude, CASE WHEN had THEN 2.5 WHEN latitude IS NOT NULL THEN 10.0 END::DOUBLE AS longitude, CASE WHEN had THEN 'listing' WHEN latitude IS NOT NULL THEN 'geocoded' END AS coords_source FROM annotated")
def place_annotation(t):
    """Coordinates of the most specific known place; listed ones stay."""
    return geocode.annotate(_named(t), _places(t)).select("id", "latitude", "longitude", "coords_source")


@query(f"{_ANNOTATED} SELECT count(*) FILTER (NOT had AND latitude IS NOT NULL) AS geocoded, count(*) FILTER (latitude IS NULL) AS without_coords FROM annotated")
def coordinate_counts(t):
    """How many events a lookup located, and how many have no coordinates."""
    return geocode.coordinate_counts(geocode.annotate(_named(t), _places(t)))


def _gazetteer(name: str, country: str) -> tuple[float, float, float | None, str] | None:
    """A finder with an answer of its own for each number in a name."""
    number = int(re.findall(r"\d+", name)[0])
    answers = (None, (number + 0.1234567, 1.0, 30.0, "city"), (number + 0.5, 1.0, 3000.0, "city"), (number + 0.5, 1.0, None, "state"), (number + 0.5, 1.0, None, "town"))
    return answers[number % len(answers)]


@query("""SELECT lower(n_name) || '|in' AS key, CASE WHEN n_nationkey % 3 = 0 THEN -1.0 WHEN n_nationkey % 5 = 1 THEN n_nationkey + 0.123457 WHEN n_nationkey % 5 = 4 THEN n_nationkey + 0.5 END::DOUBLE AS latitude,
  n_nationkey % 3 = 0 OR n_nationkey % 5 IN (1, 4) AS found FROM nation""")
def place_lookup(t):
    """Places that the table lacks, or has by old rules only, looked up; coarse ones count as not found."""
    n = F.col("n_nationkey")
    keys = t("nation").select(n.cast("string").alias("id"), F.lit(0).alias("rank"), geo.place_key(F.col("n_name"), F.lit("IN")).alias("key"), F.col("n_name").alias("query"), F.lit("IN").alias("country"))
    version = F.when(n % 3 == 0, fixed.CACHE_VERSION).otherwise(fixed.CACHE_VERSION - 1).alias("version")
    known = t("nation").where(n % 3 < 2).select(geo.place_key(F.col("n_name"), F.lit("IN")).alias("key"), F.col("n_name").alias("query"), F.lit("IN").alias("country"), F.lit(-1.0).alias("latitude"), F.lit(-1.0).alias("longitude"), F.lit(True).alias("found"), version)
    return geocode.look_up(keys.union(keys), known, _gazetteer, 0).select("key", "latitude", "found")


def _failing(name: str, country: str) -> tuple[float, float, float | None, str] | None:
    """The same answers from a service that fails for every seventh number."""
    if int(re.findall(r"\d+", name)[0]) % 7 == 0:
        raise OSError(name)
    return _gazetteer(name, country)


@query("""SELECT lower(c_name) || '|in' AS key, CASE WHEN c_custkey % 7 = 0 THEN 'open' ELSE 'answered' END AS state, CASE WHEN c_custkey % 7 = 0 THEN 2 - c_custkey % 2 ELSE 0 END AS failures,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN c_custkey + 0.123457 WHEN c_custkey % 5 = 4 THEN c_custkey + 0.5 END::DOUBLE AS latitude FROM customer""")
def lookup_states(t):
    """Customers' names as places that arrive in two streams, half of them twice: answers are committed batch by batch, failed keys join the next batch."""
    spark, key = t("customer").sparkSession, F.col("c_custkey")
    arriving = t("customer").select(geo.place_key(F.col("c_name"), F.lit("IN")).alias("key"), F.col("c_name").alias("query"), F.lit("IN").alias("country"), key)
    arrived, table, state = (new_folder(spark) for _ in range(3))
    for rows in (arriving.where(key % 2 == 0), arriving):
        rows.drop("c_custkey").write.mode("append").parquet(arrived)
        lookups.look_up(spark.readStream.schema("key string, query string, country string").parquet(arrived), table, state, _failing, 0, -1).awaitTermination()
    answers = lookups.places(spark, table).select("key", "latitude")
    return lookups.states(spark, table).join(answers, "key", "left").select("key", "state", F.col("failures").cast("int").alias("failures"), "latitude")


_SITES = """sites AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 48.1::DOUBLE ELSE (s_suppkey * 7919 % 1800) / 10.0 - 90 END AS slat, CASE WHEN s_suppkey % 3 = 0 THEN 11.5::DOUBLE ELSE (s_suppkey * 104729 % 3600) / 10.0 - 180 END AS slon FROM supplier WHERE s_suppkey % 10 <> 1),
homes AS (SELECT c_custkey, (c_custkey * 37 % 1801) / 10.0 - 90 AS clat, (c_custkey * 91 % 3601) / 10.0 - 180 AS clon FROM customer),
met AS (SELECT c_custkey, s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(slat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(slat)) * pow(sin(radians(slon - clon) / 2), 2))), 6) AS km FROM homes, sites)"""


def _around(t) -> tuple[DataFrame, DataFrame]:
    """Suppliers, a third of them at one spot and some at none, and customers as origins."""
    key, home = F.col("s_suppkey"), F.col("c_custkey")
    spot = lambda there, a, n: F.when(key % 10 != 1, F.when(key % 3 == 0, F.lit(there)).otherwise((key * a % n) / F.lit(10.0) - n / 20))
    events = t("supplier").select(key.alias("id"), spot(48.1, 7919, 1800).alias("latitude"), spot(11.5, 104729, 3600).alias("longitude"))
    return events, t("customer").select(home.alias("origin"), ((home * 37 % 1801) / F.lit(10.0) - 90).alias("latitude"), ((home * 91 % 3601) / F.lit(10.0) - 180).alias("longitude"))


@query(f"WITH {_SITES} SELECT c_custkey, count(*) AS n, round(min(km), 3) AS least, round(max(km), 3) AS most FROM met WHERE km <= 900 GROUP BY c_custkey")
def around_origins(t):
    """Of all suppliers within a radius of each customer: how many, the nearest and the farthest."""
    return nearby.around(*_around(t), 900).select(F.col("origin").alias("c_custkey"), "n", F.round("least", 3).alias("least"), F.round("most", 3).alias("most"))


@query(f"WITH {_SITES} SELECT c_custkey, place, s_suppkey, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS place FROM met) WHERE place <= 3")
def nearest_origins(t):
    """The three suppliers nearest to each customer, in order."""
    return nearby.nearest(*_around(t), 3).select(F.col("origin").alias("c_custkey"), "place", F.col("id").alias("s_suppkey"), F.round("km", 3).alias("km"))


_SEARCHED = """homes AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey * 37 % 180 - 90 AS DOUBLE) END AS lat, CAST(c_custkey * 91 % 360 - 180 AS DOUBLE) AS lon,
  CASE WHEN c_custkey % 4 > 0 THEN '2030-01-0' || (c_custkey % 4) ELSE '' END AS start FROM customer),
far AS (SELECT *, CASE WHEN lat IS NOT NULL THEN round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 18.5) / 2), 2) + cos(radians(18.5)) * cos(radians(lat)) * pow(sin(radians(lon - 73.9) / 2), 2))) / 500) END AS km FROM homes)"""


def _searchable(t) -> DataFrame:
    """Customers as events; every seventh without coordinates, every fourth undated."""
    key = F.col("c_custkey")
    spot = {"latitude": F.when(key % 7 > 0, key * 37 % 180 - 90).cast("double"), "longitude": (key * 91 % 360 - 180).cast("double"), "start": F.when(key % 4 > 0, F.concat(F.lit("2030-01-0"), key % 4)).otherwise("")}
    plain = {c: F.lit(None).cast("string") for c in ("city", "venue_name", "region", "country")}
    return t("customer").withColumns(spot | plain | {"title": F.col("c_name"), "distances": F.array(F.lit("10K"))})


@query(f"WITH {_SEARCHED} SELECT c_custkey, row_number() OVER (ORDER BY km NULLS LAST, start = '', start, lower(c_name)) - 1 AS place FROM far")
def search_order(t):
    """Customers by their distance from a place in steps of 500 km, unknown last; the same step by start, undated last, then name."""
    found = search.search(_searchable(t), term="10k", origin=(18.5, 73.9)).withColumn("km", F.round(F.col("km") / 500))
    return relational.numbered(found, search.result_order(True), "place").select("c_custkey", "place")


@query(f"WITH {_SEARCHED} SELECT c_custkey, row_number() OVER (ORDER BY start = '', start, lower(c_name)) - 1 AS place FROM far WHERE start <> ''")
def dated_order(t):
    """Dated customers without an origin: by start, then name."""
    return relational.numbered(search.search(_searchable(t), dated=True), search.result_order(False), "place").select("c_custkey", "place")
