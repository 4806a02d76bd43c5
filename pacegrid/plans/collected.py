"""Registered queries of services and of listings with detail pages, over stored answers made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.operators import crawl, geocode, relational
from pacegrid.operators.lineage import new_folder, written
from pacegrid.plans.catalog import query
from pacegrid.plans.pages import RUN_AT
from pacegrid.schema import as_events
from pacegrid.sources import published, services, sites, web
from pacegrid.streaming import frontier

#: Rows of an answer or listing page.
PER_PAGE = 20


def stored(answers: DataFrame) -> dict:
    """Options of the web sources that know nothing but ``answers`` (url, status, text)."""
    folder = new_folder(answers.sparkSession)
    web.store_answers(answers, folder)
    return {"cache": folder, "offline": "true", "delay": "0", "retries": "0"}


RACES = f"""
sites:
  - {{key: races, name: Races, type: api, service: races, url: "https://races.test/rest", event_types: [running_race, trail_race], results_per_page: {PER_PAGE}, max_pages_per_type: 1000000, days_ahead: 90, default_country: Ireland}}
"""


def race_service(t) -> dict:
    """Customers as the answers of a race service: two kinds, pages of PER_PAGE, for one window of days only."""
    rows = relational.numbered(t("customer").select("c_custkey", "c_name"), [F.col("c_custkey")], "n")
    day = F.date_format(F.date_add(F.lit("2029-06-02").cast("date"), (F.col("c_custkey") % 80).cast("int")), "M/d/yyyy")
    race = F.struct(F.concat(F.col("c_name"), F.lit(" 5K")).alias("name"), F.concat(F.lit("https://races.test/r/"), F.col("c_custkey") % 1000).alias("url"), day.alias("next_date"))
    pages = rows.groupBy((F.col("n") % 2).alias("kind"), F.floor(F.col("n") / (2 * PER_PAGE)).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(race.alias("race")).alias("r")))), lambda x: x.r).alias("races"))
    kind = F.when(F.col("kind") == 0, "running_race").otherwise("trail_race")
    url = F.concat(F.lit(f"https://races.test/rest?format=json&results_per_page={PER_PAGE}&page="), F.col("page") + 1, F.lit("&events=T&event_type="), kind, F.lit("&race_event_days_from=2029-06-01&race_event_days_to=2029-08-30"))
    return stored(pages.select(url.alias("url"), F.lit(200).alias("status"), F.to_json(F.struct("races")).alias("text")))


@query("""WITH rows AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT c_name || ' 5K' AS title, 'https://races.test/r/' || (c_custkey % 1000) AS source_url, strftime(DATE '2029-06-02' + CAST(c_custkey % 80 AS INTEGER), '%Y-%m-%dT00:00:00') AS start, 'IE' AS country FROM rows
QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY n % 2, n) = 1""")
def service_crawl(t):
    """Customers as races of a paged service, crawled: conditions on kind and window reach the service, pages are read up to a short
    or missing one, repeats go in order of kinds, pages and places."""
    spark = t("customer").sparkSession
    listed = sites.read_sites(spark, RACES)
    rows = services.served(listed, RUN_AT, options=race_service(t))
    none = spark.createDataFrame([], "url string, status int, html string, error string")
    return crawl.crawl(listed, none, RUN_AT, served=rows).events.select("title", "source_url", "start", "country")


def _state(props) -> F.Column:
    return F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": '), F.to_json(props), F.lit("}}</script>"))


@query(f"""WITH n AS (SELECT count(*) AS n FROM supplier), shown AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 4 <> 0),
named AS (SELECT s_suppkey AS k, s_name, row_number() OVER (ORDER BY s_suppkey DESC) AS spot FROM supplier WHERE s_suppkey % 3 = 0), told AS (SELECT * FROM named, n WHERE spot <= n // 4 AND k % 5 <> 0),
merged AS (SELECT coalesce(s.k, d.k) AS k, d.k IS NOT NULL AS from_detail, coalesce(s.s_name, d.s_name) AS s_name, s.k AS first, d.spot FROM shown s FULL JOIN told d ON s.k = d.k)
SELECT 'https://fair.test/e/s-' || k AS source_url, CASE WHEN from_detail THEN 'Trail ' || s_name ELSE s_name || ' Run' END AS title, CASE WHEN from_detail THEN 'trail_running' ELSE 'running' END AS sport,
  row_number() OVER (ORDER BY first NULLS LAST, spot) AS place FROM merged""")
def listed_with_details(t):
    """Suppliers on listing pages, some with a detail page that a sitemap names: two dependent scans, put together in order of first appearance."""
    rows = written(relational.numbered(t("supplier").where("s_suppkey % 4 <> 0"), [F.col("s_suppkey")], "n"))
    item = F.struct(F.concat(F.col("s_name"), F.lit(" Run")).alias("title"), F.concat(F.lit("s-"), F.col("s_suppkey")).alias("slug"), F.struct(F.lit("2030-03-01").alias("start")).alias("eventDate"))
    pages = rows.groupBy(F.floor(F.col("n") / PER_PAGE).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))), lambda x: x["item"]).alias("events"))
    listing = pages.select(F.concat(F.lit("https://fair.test/list/"), "page").alias("url"), F.lit(200).alias("status"), _state(F.struct(F.struct("events").alias("eventsData"))).alias("text"))
    info = F.struct(F.concat(F.lit("Trail "), "s_name").alias("title"), F.concat(F.lit("s-"), F.col("s_suppkey")).alias("slug"), F.lit("2030-03-02").alias("eventDate"))
    link = F.concat(F.lit("https://fair.test/events/s-"), F.col("s_suppkey"))
    named = t("supplier").where("s_suppkey % 3 = 0")
    detail = named.where("s_suppkey % 5 <> 0").select(link.alias("url"), F.lit(200).alias("status"), _state(F.struct(info.alias("eventInfo"))).alias("text"))
    # one sitemap file names them all, as the site's does
    entries = named.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", link.alias("link"))), False), lambda x: F.concat(F.lit("<url><loc>"), x.link, F.lit("</loc></url>"))), "\n").alias("text"))
    options = stored(listing.union(detail).union(entries.select(F.lit("https://fair.test/sitemap.xml"), F.lit(200), "text")))
    spark, last = t("supplier").sparkSession, t("supplier").count()
    seeds = ", ".join(f"https://fair.test/list/{k}" for k in range(-(-last // PER_PAGE)))
    text = f"sites: [{{key: fair, type: nextdata, service: listing, sitemap: 'https://fair.test/sitemap.xml', url_template: 'https://fair.test/e/{{slug}}', max_detail_pages: {last // 4}, seeds: [{seeds}]}}]"
    found = services.served(sites.read_sites(spark, text), RUN_AT, options=options)
    return found.select("source_url", "title", "sport", (F.col("place") + 1).cast("long").alias("place"))


@query("""WITH c AS (SELECT c_custkey % 5 = 0 AS open, c_nationkey % 2 = 0 AS known FROM customer) SELECT line_no, line FROM (
SELECT 0 AS line_no, '  total ' || count(*) || ' events (1 duplicates dropped, 2 rejected for no url, 3 non-sport filtered, 4 already finished) in ' || count(*) || ' requests' AS line FROM c
UNION ALL SELECT 1, '  ' || count(*) FILTER (open AND known) || ' located by city name, ' || count(*) FILTER (open AND NOT known) || ' with no known location' FROM c)""")
def annotated_report(t):
    """Customers as a published run that is given coordinates afterwards: the report's lines follow the events."""
    spark, folder, key = t("customer").sparkSession, new_folder(t("customer").sparkSession), F.col("c_custkey")
    spot = {"city": F.concat(F.lit("Town "), "c_nationkey"), "country": F.lit("Ireland"), "id": key.cast("string"), "title": F.col("c_name"), "source_url": F.concat(F.lit("https://e.test/"), key), "start": F.lit("2030-01-01")}
    events = as_events(t("customer").withColumns(spot | {c: F.when(key % 5 > 0, F.lit(50.0)) for c in ("latitude", "longitude")}))
    events = written(events.withColumn("coords_source", F.when(F.col("latitude").isNotNull(), "listing")))
    counts = {"rejected_no_url": 2, "rejected_non_sport": 3, "rejected_past": 4, "duplicates_dropped": 1, "geocoded": 0}
    report = events.agg(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()], F.count_if(F.col("latitude").isNull()).alias("without_coords"), F.count("*").alias("total_events"), F.count("*").alias("requests_made"))
    published.save_crawl(crawl.Crawl(events, spark.createDataFrame([], "key string"), report), folder, RUN_AT)
    keys = geocode.place_keys(events).groupBy("key").agg(F.min("query").alias("query"), F.min("country").alias("country"))
    known = F.substring_index("query", " ", -1).cast("int") % 2 == 0
    places = keys.select("key", "query", "country", F.when(known, 51.0).alias("latitude"), F.when(known, -9.0).alias("longitude"), known.alias("found"), F.lit(geocode.fixed.CACHE_VERSION).alias("version"))
    published.annotate_published(spark, folder, places)
    return crawl.summary_totals(published.published(spark, folder, "report"))


@query("""SELECT 'https://p.test/' || s_suppkey AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'done' WHEN s_suppkey % 3 = 1 THEN 'failed' ELSE 'open' END AS state, CASE s_suppkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 503 END AS status,
  CASE WHEN s_suppkey % 3 = 2 THEN 2 ELSE 1 END AS attempts FROM supplier""")
def frontier_states(t):
    """Links to suppliers that arrive twice, in two streams of batches: what was answered isn't asked again, what failed is."""
    key, spark = F.col("s_suppkey"), t("supplier").sparkSession
    rows = t("supplier").select(F.concat(F.lit("https://p.test/"), key).alias("url"), F.when(key % 3 == 0, 200).when(key % 3 == 1, 404).otherwise(503).alias("status"), F.col("s_name").alias("text"), key)
    options = stored(rows.select("url", "status", "text"))
    arrived, table, state = (new_folder(spark) for _ in range(3))
    for _ in range(2):
        rows.select("url").write.mode("append").parquet(arrived)
        frontier.fetch(spark.readStream.schema("url string").parquet(arrived), table, state, options, tasks=8).awaitTermination()
    return frontier.states(spark, table).select("url", "state", "status", F.col("attempts").cast("int").alias("attempts"))
