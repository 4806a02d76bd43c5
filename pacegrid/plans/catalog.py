"""Registered queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.functions import fixed, geo, sports, text, urls, values
from pacegrid.operators import relational, search
from pacegrid.operators.lineage import dealt

RUN_DAY = "1998-01-01"
#: White space as the engine sees it, for DuckDB.
SPACE = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TITLES = ("City Marathon", "Trail Marathon 50k", "Ironman 70.3", "Gran Fondo", "open water 5 km", "Duathlon", "Walk for all", "HYROX Dubai", "bike_race", "Gala night", "10 K classic")
COUNTRIES = ("India", "U.S.A.", "de", "Atlantis", " great britain. ")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (tables by name) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pick(options: tuple[str, ...], number) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (number % len(options) + 1).cast("int"))


def _sql_pick(options: tuple[str, ...], number: str) -> str:
    return f"[{', '.join(repr(x) for x in options)}][CAST({number} % {len(options)} AS INT) + 1]"


def _sql_replaces(expression: str) -> str:
    for entity, char in text.COMMON_ENTITIES:
        expression = "replace({}, '{}', '{}')".format(expression, entity, char.replace("'", "''"))
    return expression


def _sql_clean(expression: str) -> str:
    bare = _sql_replaces(f"regexp_replace({expression}, '<[^>]+>', ' ', 'g')")
    return f"nullif(trim(regexp_replace({bare}, '{SPACE}', ' ', 'g')), '')"


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def facet_counts(t):
    """Events by type, most frequent first."""
    return relational.facets(t("events"), "event_type", "other")


@query("SELECT count(*) AS total, count(*) FILTER (ts IS NULL) AS dateless, count(*) FILTER (value IS NULL) AS unpriced, count(*) FILTER (event_type = 'error') AS errors FROM events")
def facet_scalars(t):
    """Counts of one pass."""
    return t("events").agg(F.count("*").alias("total"), F.count_if(F.col("ts").isNull()).alias("dateless"), F.count_if(F.col("value").isNull()).alias("unpriced"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT page_id, substr(sha1('pages|' || url), 1, 16) AS id FROM pages")
def stable_id(t):
    return t("pages").select("page_id", values.stable_id(F.lit("pages"), F.col("url")).alias("id"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '(?i)\b(20\d{2}|\d{1,2}(st|nd|rd|th)\s+edition|edition)\b', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM documents""")
def title_key(t):
    return t("documents").select("doc_id", text.title_key(F.col("text")).alias("title_key"))


@query(f"SELECT page_id, {_sql_clean('html')} AS text FROM pages")
def clean_text_pages(t):
    return t("pages").select("page_id", text.clean_text(F.col("html"), full_entities=False).alias("text"))


@query(f"SELECT page_id, {_sql_clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages")
def page_title(t):
    return t("pages").select("page_id", text.clean_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), full_entities=False).alias("title"))


@query("""SELECT page_id, count(*) AS n, count(DISTINCT link) AS n_distinct, min(link) AS first_link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY page_id""")
def page_links(t):
    """Links of each page, repeated ones counted."""
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("link").alias("n_distinct"), F.min("link").alias("first_link"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]+') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1) END AS link
FROM (SELECT page_id, trim(url) AS url FROM pages)""")
def url_normalise(t):
    return t("pages").select("page_id", urls.absolute_url(F.col("url"), full_entities=False).alias("link"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS price FROM events")
def json_field_price(t):
    return t("events").select("event_id", values.json_number(F.get_json_object("props", "$.k")).alias("price"))


_TOKENS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.SPORT_BY_TOKEN.items()) + "}"
_CASCADE = "CASE " + " ".join(f"WHEN regexp_matches(p_type || ' ' || p_name || ' ' || title, '(?i){p}') THEN '{s}'" for p, s in fixed.SPORT_PATTERNS) + " ELSE 'other' END"


@query(f"SELECT p_partkey, coalesce({_TOKENS}[lower(p_type)], {_TOKENS}[lower(p_name)], {_TOKENS}[lower(trim(title))], {_CASCADE}) AS sport FROM (SELECT *, {_sql_pick(TITLES, 'p_partkey')} AS title FROM part)")
def sport_cascade(t):
    """Exact tokens of any hint first, then the ordered patterns over all of them."""
    return t("part").select("p_partkey", sports.classify_sport(F.array("p_type", "p_name", _pick(TITLES, F.col("p_partkey")))).alias("sport"))


_LABEL = "CASE WHEN km IS NULL THEN NULL " + " ".join(f"WHEN abs(km - {c}) <= {tol} THEN '{name}'" for c, tol, name in fixed.DISTANCE_LABELS) + " WHEN abs(km - round_even(km, 0)) < 0.05 THEN CAST(CAST(round_even(km, 0) AS BIGINT) AS VARCHAR) || 'K' ELSE printf('%.1fK', km) END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, km, {_LABEL} AS label FROM (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN 21.098 WHEN 1 THEN l_quantity WHEN 2 THEN round(l_quantity * 1.609344, 3) WHEN 3 THEN CASE WHEN l_quantity * 100 >= 400 THEN round(l_quantity * 100 / 1000.0, 3) ELSE l_quantity * 100 END ELSE l_quantity + 0.5 END AS km FROM lineitem)""")
def distance_parse(t):
    """Quantities as texts of several units, read back as label and kilometres."""
    whole, n = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    said = F.when(n == 0, "half marathon").when(n == 1, F.concat(whole.cast("string"), F.lit("K"))).when(n == 2, F.concat(whole.cast("string"), F.lit(" miles"))).when(n == 3, F.concat((whole * 100).cast("string"), F.lit("m"))).otherwise(F.concat(whole.cast("string"), F.lit(".5 km")))
    return values.with_distance(t("lineitem").withColumn("said", said), F.col("said"), "label", "km").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "km", "label")


@query("SELECT l_orderkey, min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max FROM lineitem GROUP BY l_orderkey")
def price_range(t):
    """Least and largest of the prices that each order lists."""
    low, high = values.price_range(F.col("prices"))
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("prices")).select("l_orderkey", low.alias("price_min"), high.alias("price_max"))


@query("SELECT p_partkey, least(p_retailprice, CAST(p_size AS DOUBLE)) AS price_min, greatest(p_retailprice, CAST(p_size AS DOUBLE)) AS price_max, 'USD' AS currency, 'https://shop.test/p/' || p_partkey AS link FROM part")
def offers_fold(t):
    """Offers as JSON, folded to a price range, a currency and a link."""
    offers = F.concat(F.lit('[{"price":"'), F.col("p_retailprice").cast("string"), F.lit('","priceCurrency":"USD"},{"lowPrice":'), F.col("p_size").cast("string"), F.lit(',"url":"/p/'), F.col("p_partkey").cast("string"), F.lit('"}]'))
    names = {k: k for k in ("price_min", "price_max", "currency", "link")}
    return values.with_offers(dealt(t("part")).withColumn("offers", offers), F.col("offers"), F.lit("https://shop.test/list/all"), names).select("p_partkey", *names)


@query("SELECT n_nationkey, r_name, ['IN', 'U.S.A.', 'DE', 'Atlantis', 'GB'][CAST(n_nationkey % 5 AS INT) + 1] AS country FROM nation JOIN region ON n_regionkey = r_regionkey")
def country_fold(t):
    named = t("nation").withColumn("said", text.collapse(_pick(COUNTRIES, F.col("n_nationkey"))))
    return named.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", values.country_code(F.col("said")).alias("country"))


def _dated_orders(t) -> DataFrame:
    return t("orders").withColumn("start", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= DATE '{RUN_DAY}'")
def drop_past(t):
    """Rows whose day, as text, is not before the run's."""
    return _dated_orders(t).where(~relational.finished_before(F.col("start"), F.lit(None).cast("string"), RUN_DAY)).select("o_orderkey", "start")


@query(f"""SELECT count(*) AS seen, count(*) FILTER (no_url) AS no_url, count(*) FILTER (NOT no_url AND odd) AS non_sport, count(*) FILTER (NOT no_url AND NOT odd AND past) AS past, count(*) FILTER (NOT (no_url OR odd OR past)) AS kept
FROM (SELECT o_orderkey % 17 = 0 AS no_url, o_orderstatus = 'P' AS odd, o_orderdate < DATE '{RUN_DAY}' AS past FROM orders)""")
def funnel_report(t):
    """Rejections counted step after step in one pass."""
    past = relational.finished_before(F.col("start"), F.lit(None).cast("string"), RUN_DAY)
    return relational.funnel(_dated_orders(t), [("no_url", F.col("o_orderkey") % 17 == 0), ("non_sport", F.col("o_orderstatus") == "P"), ("past", past)])


@query("""WITH RECURSIVE keyed AS (
  SELECT event_id, user_id || '|' || event_type AS id, CAST(value AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, row_number() OVER (ORDER BY event_id) AS n, hash(user_id, event_type) AS i, hash(value, CAST(ts AS DATE)) AS k FROM events),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS UBIGINT[]) AS ids, CAST([] AS UBIGINT[]) AS keys
  UNION ALL
  SELECT x.n, CASE WHEN free THEN x.event_id END, CASE WHEN free THEN list_append(ids, i) ELSE ids END, CASE WHEN free THEN list_append(keys, k) ELSE keys END
  FROM (SELECT e.n, e.event_id, e.i, e.k, w.ids, w.keys, NOT list_contains(w.ids, e.i) AND NOT list_contains(w.keys, e.k) AS free FROM walk w JOIN keyed e ON e.n = w.n + 1) x)
SELECT event_id, id, key FROM walk JOIN keyed USING (event_id)""")
def dual_key_dedupe(t):
    """Ordered greedy dedupe of events by (user, type) and by (value, day); the SQL walks row by row."""
    keyed = t("events").withColumns({"id": F.concat_ws("|", "user_id", "event_type"), "key": F.concat_ws("|", F.col("value").cast("string"), F.to_date("ts").cast("string"))})
    return relational.dual_key_dedupe(keyed, "id", "key", "event_id").select("event_id", "id", "key")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(t):
    return relational.first_per_key(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(t):
    return relational.first_per_key(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r <= 3")
def page_cap(t):
    """The first rows of each page (here: part)."""
    return relational.first_per_key(t("lineitem"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")], 3).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH found AS (
  SELECT page_id, 1 AS rank, unnest(regexp_extract_all(html, '(?s)<h2>(.*?)</h2>', 1)) AS title FROM pages
  UNION ALL SELECT page_id, 2, unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 3, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) FROM pages)
SELECT page_id, rank, title FROM found QUALIFY rank = min(rank) OVER (PARTITION BY page_id)""")
def strategy_chain(t):
    """Titles by the first of three extractions that finds any."""
    found = lambda rank, tag, pages: pages.select("page_id", F.lit(rank).alias("rank"), F.explode(F.regexp_extract_all("html", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)).alias("title"))
    pages = t("pages")
    return relational.first_strategy(found(1, "h2", pages).union(found(2, "h1", pages.where("page_id % 2 = 0"))).union(found(3, "title", pages)), "page_id", "rank")


@query("""SELECT o_orderkey, o_orderstatus AS source, true AS carried FROM orders WHERE o_orderstatus NOT IN ('F') UNION ALL SELECT o_orderkey, o_orderstatus, false FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000""")
def carry_forward(t):
    """A refresh of one source over the previous snapshot."""
    previous = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("source"))
    fresh = t("orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", F.col("o_orderstatus").alias("source"))
    return relational.carry_forward(previous, fresh, ["F"])


@query("""WITH details AS (SELECT o_custkey AS k, o_orderpriority AS name, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)
SELECT coalesce(d.k, c.c_custkey) AS k, CASE WHEN d.k IS NULL THEN c_name ELSE name END AS name, CASE WHEN d.k IS NULL THEN c_acctbal ELSE price END AS price, d.k IS NOT NULL AS from_detail FROM customer c FULL JOIN details d ON d.k = c.c_custkey""")
def listing_detail_merge(t):
    """Listings superseded, as a whole, by the last detail of the same key."""
    listings = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"))
    last = relational.first_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return relational.prefer_details(listings, last.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price")), "k")


@query("""WITH places AS (SELECT n_name || ', ' || r_name AS place, n_nationkey * 2 AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, n_nationkey FROM nation WHERE n_nationkey % 3 = 0)
SELECT c_custkey, coalesce(a.code, b.code) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN places a ON a.place = n_name || ', ' || r_name LEFT JOIN places b ON b.place = n_name""")
def fallback_lookup(t):
    """Places by city and region, else by city alone."""
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    exact = named.where("n_nationkey % 2 = 0").select(F.concat_ws(", ", "n_name", "r_name").alias("place"), (F.col("n_nationkey") * 2).alias("code"))
    places = exact.union(t("nation").where("n_nationkey % 3 = 0").select("n_name", "n_nationkey"))
    keyed = t("customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(", ", "n_name", "r_name").alias("first_key"), F.col("n_name").alias("second_key"))
    return relational.lookup_with_fallback(keyed, ["first_key", "second_key"], places, "place", "code").select("c_custkey", "code")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate IS NULL, o_orderdate, lower(o_orderstatus), o_orderkey) - 1 AS place FROM orders")
def event_sort(t):
    """Place of each row among all by start, undated last, then title."""
    start = F.col("o_orderdate")
    return relational.numbered(t("orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [start.isNull(), start, F.lower("o_orderstatus"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


_LAT, _LON = "(c_custkey * 37 % 180 - 90)", "(c_custkey * 91 % 360 - 180)"


@query(f"""SELECT c_custkey, km FROM (SELECT c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians({_LAT} - 18.5) / 2), 2) + cos(radians(18.5)) * cos(radians({_LAT})) * pow(sin(radians({_LON} - 73.9) / 2), 2))), 3) AS km FROM customer) WHERE km <= 3000""")
def near_me(t):
    """Customers, at made-up coordinates, within a radius of a place."""
    lat, lon = (F.expr(x).cast("double") for x in (_LAT, _LON))
    return t("customer").select("c_custkey", F.round(geo.haversine_km(F.lit(18.5), F.lit(73.9), lat, lon), 3).alias("km")).where("km <= 3000")


@query("""SELECT n_nationkey, round(km, 6) AS km, km <= 400 AS precise FROM (SELECT n_nationkey, sqrt(pow(n_nationkey * 0.1 * 111.0, 2) + pow((n_regionkey + 1) * 0.5 * 111.0 * cos(radians((n_nationkey * 2 + n_nationkey * 0.1) / 2)), 2)) AS km FROM (SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_regionkey FROM nation))""")
def bbox_extent(t):
    key, region = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    km = geo.extent_km(key, key + key * 0.1, F.lit(0.0), (region + 1) * 0.5)
    return t("nation").select(key.alias("n_nationkey"), F.round(km, 6).alias("km"), geo.precise_enough(km, F.lit("city")).alias("precise"))


def _listed(t) -> DataFrame:
    """Customers as event rows: names as titles, nations as cities, made-up coordinates."""
    lat, lon = (F.expr(x).cast("double") for x in (_LAT, _LON))
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    blank = F.lit(None).cast("string")
    return named.select("c_custkey", F.col("c_name").alias("title"), F.col("n_name").alias("city"), blank.alias("venue_name"), blank.alias("region"), blank.alias("country"), F.array(F.lit("10K")).alias("distances"), F.when(F.col("c_custkey") % 3 > 0, "2030-01-01").alias("start"), F.lower("c_mktsegment").alias("sport"), F.lit("s").alias("source"), lat.alias("latitude"), lon.alias("longitude"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name || ' ' || n_name || '    ' || '10K'), 'nation_1')")
def text_search(t):
    """Events that hold a term in title, place or distances."""
    return search.search(_listed(t), term="Nation_1").select("c_custkey")


@query("""SELECT c_custkey FROM (SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin(radians((c_custkey * 37 % 180 - 90) - 18.5) / 2), 2) + cos(radians(18.5)) * cos(radians((c_custkey * 37 % 180 - 90))) * pow(sin(radians((c_custkey * 91 % 360 - 180) - 73.9) / 2), 2))) AS km FROM customer)
WHERE lower(c_mktsegment) = 'machinery' AND c_custkey % 3 > 0 AND km <= 6000""")
def viewer_filter(t):
    """Dated events of one sport within a radius."""
    return search.search(_listed(t), sport="machinery", source="s", dated=True, origin=(18.5, 73.9), radius_km=6000).select("c_custkey")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS subtypes FROM lineitem GROUP BY l_orderkey")
def subtype_sets(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("subtypes"))


@query("SELECT c_custkey, concat_ws(', ', c_name, n_name, CAST(c_custkey AS VARCHAR), r_name) AS address, n_name AS city, r_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def address_flatten(t):
    """Address objects as JSON, flattened; a region like the city, in other case, is left out."""
    named = dealt(t("customer")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    json = F.to_json(F.struct(F.col("c_name").alias("streetAddress"), F.col("n_name").alias("addressLocality"), F.lower("n_name").alias("addressRegion"), F.col("c_custkey").cast("string").alias("postalCode"), F.struct(F.col("r_name").alias("name")).alias("addressCountry")))
    names = {k: k for k in ("address", "city", "country")}
    return values.with_address(named, json, names).select("c_custkey", *names)


@query("SELECT CASE WHEN contains(html, 'ld+json') THEN 'json-ld' WHEN contains(html, '<h2>') THEN 'sections' WHEN contains(html, '<nav>') THEN 'navigation' ELSE 'none' END AS verdict, count(*) AS n FROM pages GROUP BY 1")
def verdict_case(t):
    has = lambda x: F.contains("html", F.lit(x))
    return t("pages").groupBy(F.when(has("ld+json"), "json-ld").when(has("<h2>"), "sections").when(has("<nav>"), "navigation").otherwise("none").alias("verdict")).agg(F.count("*").alias("n"))


_SITES = "VALUES ('click', true, false, NULL), ('view', false, false, NULL), ('podcast', true, false, NULL), ('radio', true, true, NULL), ('error', true, false, 'timeout')"


@query(f"""WITH sites(source, enabled, requires_js, error) AS ({_SITES}), counts AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY event_type)
SELECT source, coalesce(n, 0) AS n, CASE WHEN NOT enabled THEN 'skipped' WHEN requires_js AND n IS NULL THEN 'blocked' WHEN error IS NOT NULL THEN 'error' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM sites LEFT JOIN counts USING (source)""")
def site_status(t):
    events = t("events")
    sites = events.sparkSession.sql(f"SELECT * FROM {_SITES} AS sites(source, enabled, requires_js, error)")
    return relational.site_status(sites, events.select(F.col("event_type").alias("source")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') || CASE WHEN o_orderkey % 3 = 2 THEN '+00:00' ELSE '' END AS start FROM orders")
def date_parse(t):
    """Order dates in three forms, read back as ISO texts."""
    n = F.col("o_orderkey") % 3
    said = F.when(n == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'"))
    return values.with_dates(t("orders").withColumn("said", said), {"start": F.col("said")}, date(2026, 1, 1), full_entities=False).select("o_orderkey", "start")
