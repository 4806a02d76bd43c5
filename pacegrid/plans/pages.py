"""Registered queries of page extraction, services and the crawl, over pages and answers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.operators import crawl, extract, mappers
from pacegrid.operators.lineage import dealt
from pacegrid.plans.catalog import query
from pacegrid.sources import sites

RUN_AT = "2029-06-01T00:00:00+00:00"


def _script(json, kind: str):
    return F.concat(F.lit(f'<script type="{kind}">'), json, F.lit("</script>"))


def _paged(df: DataFrame, page_id, url, **more) -> DataFrame:
    return df.select(F.struct(page_id.cast("long").alias("page_id"), F.lit("s").alias("source"), url.alias("url"), F.lit(None).cast("string").alias("url_template")).alias("page"), *[c.alias(k) for k, c in more.items()])


@query("""SELECT p_partkey AS page_id, p_name || ' Run ' || p_partkey AS title, 'https://shop.test/p/' || p_partkey AS source_url, strftime(DATE '2030-01-01' + CAST(p_partkey % 300 AS INTEGER), '%Y-%m-%dT00:00:00') AS start,
  p_retailprice AS price_min, p_retailprice AS price_max, 'EUR' AS currency, 'running' AS sport, p_brand AS city, 'EventScheduled' AS status, p_brand || ', Ireland' AS address FROM part""")
def json_ld_events(t):
    """Parts as JSON-LD pages, read back as events."""
    place = F.struct(F.struct(F.col("p_brand").alias("addressLocality"), F.struct(F.lit("Ireland").alias("name")).alias("addressCountry")).alias("address"))
    offer = F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency"))
    day = F.date_format(F.date_add(F.lit("2030-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")), "yyyy-MM-dd")
    node = F.struct(F.lit("SportsEvent").alias("@type"), F.concat_ws(" Run ", "p_name", "p_partkey").alias("name"), F.concat(F.lit("/p/"), F.col("p_partkey")).alias("url"), day.alias("startDate"), F.lit("https://schema.org/EventScheduled").alias("eventStatus"), place.alias("location"), F.array(offer).alias("offers"))
    pages = dealt(t("part")).select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.test/list").alias("url"), _script(F.to_json(node), "application/ld+json").alias("html"))
    events = mappers.schema_events(extract.json_ld(pages), RUN_AT)
    return events.select(F.col("page.page_id").alias("page_id"), "title", "source_url", "start", "price_min", "price_max", "currency", "sport", "city", "status", "address")


@query("""SELECT s_suppkey AS page_id, CASE s_suppkey % 3 WHEN 0 THEN 'script[type=json]' WHEN 1 THEN '__NUXT__' ELSE 'JSON.parse' END AS label, 'Trail ' || s_name AS title, 'https://fair.test/e/' || s_suppkey AS source_url,
  '2030-05-04T00:00:00' AS start, 'trail_running' AS sport, s_acctbal AS price_min, 'NL' AS city FROM supplier""")
def script_events(t):
    """Suppliers as payloads of three forms, found, judged and read back as events."""
    node = F.to_json(F.struct(F.concat(F.lit("Trail "), F.col("s_name")).alias("eventName"), F.lit("05/04/2030").alias("event_date"), F.concat(F.lit("/e/"), F.col("s_suppkey")).alias("link"), F.struct(F.lit("NL").alias("town")).alias("spot"), F.col("s_acctbal").alias("entryFee")))
    wrapped = F.concat(F.lit('{"list": [{"name": "menu", "url": "/"}, '), node, F.lit("]}"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(wrapped, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = F.col("s_suppkey") % 3
    html = F.when(kind == 0, _script(wrapped, "application/json")).when(kind == 1, F.concat(F.lit("<script>window.__NUXT__ = "), wrapped, F.lit(";</script>"))).otherwise(F.concat(F.lit("<script>var a = JSON.parse("), quoted, F.lit(")</script>")))
    pages = dealt(t("supplier")).select(F.col("s_suppkey").alias("page_id"), F.lit("https://fair.test/list").alias("url"), html.alias("html"))
    events = mappers.loose_events(extract.event_nodes(extract.script_payloads(pages), mappers.run_day(RUN_AT)), RUN_AT)
    return events.select(F.col("page.page_id").alias("page_id"), "label", "title", "source_url", "start", "sport", "price_min", "city")


@query("""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*[^<\\s][^<]*</a></li>')) FROM pages) GROUP BY page_id""")
def selected_links(t):
    """Navigation entries of real pages by selectors."""
    chosen = F.create_map(*[F.lit(x) for kv in {"container": "nav li", "title": "a", "url": "a"}.items() for x in kv])
    return extract.selected(t("pages").withColumn("selectors", chosen)).groupBy(F.col("page.page_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("""WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1)[2:]) AS item FROM pages)
SELECT page_id, count(*) AS n, count(*) FILTER (contains(item, 'href="/t')) AS linked FROM items WHERE regexp_matches(item, '>[^<]*[^<\\s][^<]*<') GROUP BY page_id""")
def selected_items(t):
    """Navigation entries of real pages but the first one, by children, places and attribute operators."""
    chosen = F.create_map(*[F.lit(x) for kv in {"container": "nav > ul > li:not(:first-child)", "title": "a", "url": 'a[href^="/t"]'}.items() for x in kv])
    return extract.selected(t("pages").withColumn("selectors", chosen)).groupBy(F.col("page.page_id").alias("page_id")).agg(F.count("*").alias("n"), F.count("url").alias("linked"))


@query("""SELECT c_custkey AS page_id, c_name || ' 5K' AS title, 'https://races.test/' || c_custkey AS source_url, '2030-05-02T07:00:00' AS start, 'running' AS sport, '5K, Half Marathon' AS distances, 'running_race, trail_race' AS types,
  20.0::DOUBLE AS price_min, 35.5::DOUBLE AS price_max, 'USD' AS currency, n_name AS city, 'US' AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def service_races(t):
    """Customers as answers of a race service with two sub-events each."""
    part = lambda distance, kind, start, fee: F.struct(F.lit(distance).alias("distance"), F.lit(kind).alias("event_type"), F.lit(start).alias("start_time"), F.array(F.struct(F.lit(fee).alias("race_fee"))).alias("registration_periods"))
    race = F.struct(F.concat(F.col("c_name"), F.lit(" 5K")).alias("name"), F.concat(F.lit("https://races.test/"), F.col("c_custkey")).alias("url"), F.struct(F.col("n_name").alias("city"), F.lit("US").alias("country_code")).alias("address"), F.array(part("5 km", "running_race", "5/2/2030 09:00", "$20.00"), part("HM", "trail_race", "5/2/2030 07:00", "$35.50")).alias("events"))
    named = dealt(t("customer")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    answers = _paged(named, F.col("c_custkey"), F.lit("https://races.test/rest"), kind=F.lit("running_race"), json=F.to_json(F.struct(F.array(F.struct(race.alias("race"))).alias("races"))))
    events = mappers.race_events(answers, RUN_AT)
    return events.select(F.col("page.page_id").alias("page_id"), "title", "source_url", "start", "sport", F.array_join("distances", ", ").alias("distances"), F.array_join("event_subtypes", ", ").alias("types"), "price_min", "price_max", "currency", "city", "country")


@query("""SELECT n_nationkey AS page_id, 'HYROX ' || n_name AS title, n_name AS city, 'https://posts.test/' || n_nationkey AS source_url, 'unavailable_phase1' AS date_status FROM nation""")
def service_posts(t):
    """Nations as posts of a blog service, undated, with the city in the title."""
    post = F.array(F.struct(F.struct(F.concat(F.lit("HYROX "), F.col("n_name")).alias("rendered")).alias("title"), F.concat(F.lit("https://posts.test/"), F.col("n_nationkey")).alias("link")))
    return mappers.post_events(_paged(t("nation"), F.col("n_nationkey"), F.lit("https://posts.test/"), json=F.to_json(post)), RUN_AT).select(F.col("page.page_id").cast("int").alias("page_id"), "title", "city", "source_url", "date_status")


SITES = """
sites:
  - {key: fair, name: Fair, default_country: India, seeds: [https://fair.test/0, https://fair.test/1, https://fair.test/2, https://fair.test/3, https://fair.test/4]}
  - {key: closed, enabled: false}
  - {key: app, requires_js: true, seeds: [https://app.test/]}
  - {key: odd, type: radio}
  - {key: quiet, seeds: [https://fair.test/none]}
"""


def fair_pages(t) -> DataFrame:
    """Suppliers on five listing pages."""
    day = F.when(F.col("s_suppkey") % 7 == 0, "1999-05-01").otherwise(F.date_format(F.date_add(F.lit("2030-01-01").cast("date"), F.col("s_suppkey").cast("int")), "yyyy-MM-dd"))
    node = F.struct(F.lit("Event").alias("@type"), F.concat(F.when(F.col("s_suppkey") % 11 == 0, "Gala ").otherwise("Run "), F.col("s_name")).alias("name"), F.concat(F.lit("/e/"), F.col("s_suppkey") % 40).alias("url"), day.alias("startDate"))
    listed = t("supplier").groupBy((F.col("s_suppkey") % 5).alias("seed")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", node.alias("node")))).alias("rows"))
    return listed.select(F.concat(F.lit("https://fair.test/"), F.col("seed")).alias("url"), F.lit(200).alias("status"), _script(F.to_json(F.transform("rows", lambda x: x.node)), "application/ld+json").alias("html"), F.lit(None).cast("string").alias("error"))


def _crawl(t) -> crawl.Crawl:
    pages = fair_pages(t)
    return crawl.crawl(sites.read_sites(pages.sparkSession, SITES), pages, RUN_AT)


_RAW = """raw AS (SELECT s_suppkey AS k, (CASE WHEN s_suppkey % 11 = 0 THEN 'Gala ' ELSE 'Run ' END) || s_name AS title, 'https://fair.test/e/' || (s_suppkey % 40) AS source_url,
  CASE WHEN s_suppkey % 7 = 0 THEN '1999-05-01T00:00:00' ELSE strftime(DATE '2030-01-01' + CAST(s_suppkey AS INTEGER), '%Y-%m-%dT00:00:00') END AS start FROM supplier),
open AS (SELECT * FROM raw WHERE k % 11 <> 0 AND start >= '2029-06-01'),
kept AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY k % 5, k) = 1)"""


@query(f"WITH {_RAW} SELECT substr(sha1('fair|' || source_url), 1, 16) AS id, title, source_url, start, 'IN' AS country, 'running' AS sport FROM kept")
def crawl_events(t):
    """Suppliers on five listing pages, crawled: default country, filters, dedupe in order, sort."""
    return _crawl(t).events.select("id", "title", "source_url", "start", "country", "sport")


@query(f"""WITH {_RAW} SELECT 0::BIGINT AS rejected_no_url, (SELECT count(*) FROM raw WHERE k % 11 = 0) AS rejected_non_sport, (SELECT count(*) FROM raw WHERE k % 11 <> 0 AND start < '2029-06-01') AS rejected_past,
  (SELECT count(*) FROM open) - (SELECT count(*) FROM kept) AS duplicates_dropped, 0::BIGINT AS geocoded, (SELECT count(*) FROM kept) AS without_coords, (SELECT count(*) FROM kept) AS total_events, (SELECT count(DISTINCT s_suppkey % 5) FROM supplier) AS requests_made""")
def crawl_report(t):
    """The run's counts."""
    return _crawl(t).report


@query("""SELECT 'fair' AS key, 'ok' AS status, count(*) AS events, CAST(NULL AS VARCHAR) AS reason FROM supplier UNION ALL SELECT * FROM (VALUES ('closed', 'skipped', 0::BIGINT, 'disabled in config'),
  ('app', 'blocked', 0::BIGINT, 'not reached this run, so client-side rendering unconfirmed'), ('odd', 'error', 0::BIGINT, 'unknown type ''radio'''), ('quiet', 'empty', 0::BIGINT, 'no events parsed')) t""")
def crawl_sites(t):
    """The run's results by site."""
    return _crawl(t).sites.select("key", "status", "events", "reason")
