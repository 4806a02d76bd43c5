"""Registered queries of sinks, streams, link lists, reports and page properties, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.operators import crawl, extract, mappers
from pacegrid.operators.lineage import dealt, new_folder
from pacegrid.plans.catalog import query
from pacegrid.plans.pages import RUN_AT, SITES, _script, fair_pages
from pacegrid.schema import EVENT_DDL, as_events
from pacegrid.sources import sites, snapshots, web
from pacegrid.streaming import refresh


def _orders(t):
    """Orders as event records."""
    key = F.col("o_orderkey").cast("string")
    prices = {"price_min": F.col("o_totalprice"), "distances": F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderpriority"), F.lit("5K")))}
    return as_events(t("orders").withColumns({"id": key, "title": F.concat(F.lit("Run "), key), "source": F.col("o_orderstatus"), "start": F.date_format("o_orderdate", "yyyy-MM-dd"), **prices}))


_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Run ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS start, o_totalprice AS price_min, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ',5K' END AS distances FROM orders"
_SHOWN = ("id", "title", "start", "price_min")


@query(_ORDERS)
def snapshot_json(t):
    """A snapshot written as JSON and read again."""
    events, folder = _orders(t), new_folder(t("orders").sparkSession)
    snapshots.write_snapshot(events, folder, "json")
    return snapshots.read_snapshot(events.sparkSession, folder, "json").select(*_SHOWN, F.array_join("distances", ",").alias("distances"))


@query(_ORDERS + " WHERE o_orderstatus <> 'F'")
def snapshot_replaced(t):
    """A snapshot replaced by a part of itself."""
    folder, spark = new_folder(t("orders").sparkSession), t("orders").sparkSession
    snapshots.write_snapshot(_orders(t), folder)
    snapshots.replace_snapshot(snapshots.read_snapshot(spark, folder, "parquet").where("source <> 'F'"), folder)
    return snapshots.read_snapshot(spark, folder, "parquet").select(*_SHOWN, F.array_join("distances", ",").alias("distances"))


@query("""SELECT CAST(user_id AS VARCHAR) AS id, event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S') || lpad(CAST(event_id AS VARCHAR), 12, '0') AS scraped_at
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id DESC) = 1""")
def stream_refresh(t):
    """Versions of events that arrive as a stream of files, in two runs; the newest of each stays."""
    events, spark = t("events"), t("events").sparkSession
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    versions = as_events(events.withColumns({"id": F.col("user_id").cast("string"), "title": F.col("event_type"), "scraped_at": at, "start": F.col("event_id").cast("string")}))
    arrived, table, state = (new_folder(spark) for _ in range(3))
    for half in (0, 1):
        versions.where(F.col("start").cast("long") % 2 == half).write.mode("append").parquet(arrived)
        refresh.refresh(spark.readStream.schema(EVENT_DDL).parquet(arrived), table, state).awaitTermination()
    return refresh.newest(spark.read.parquet(table)).select("id", "title", "scraped_at")


@query("SELECT DISTINCT 'https://fair.test/' || n_regionkey AS url FROM nation")
def seed_links(t):
    """Distinct links of two text files with blanks, empty lines and repeats."""
    spark, link = t("nation").sparkSession, F.concat(F.lit("https://fair.test/"), F.col("n_regionkey"))
    folders = [new_folder(spark), new_folder(spark)]
    t("nation").select(F.concat(F.lit("  "), link, F.lit(" \t")).alias("value")).union(t("region").select(F.lit(" "))).write.text(folders[0])
    t("nation").select(link.alias("value")).write.text(folders[1])
    return sites.read_links(spark, folders).select("url")


@query("SELECT 'https://fair.test/events/' || s_suppkey AS link FROM supplier WHERE s_suppkey % 4 <> 0")
def sitemap_links(t):
    """Event links of sitemaps that repeat each other."""
    part = F.when(F.col("s_suppkey") % 4 == 0, "/about/").otherwise("/events/")
    entry = F.concat(F.lit("<url>\n<LOC> https://fair.test"), part, F.col("s_suppkey"), F.lit(" </LOC></url>"))
    maps = t("supplier").groupBy((F.col("s_suppkey") % 3).alias("map")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "").alias("html"))
    maps = maps.select(F.concat(F.lit("https://fair.test/map"), "map").alias("url"), "html")
    return sites.sitemap_links(maps.union(maps.select(F.concat(F.col("url"), F.lit("-old")), "html"))).select("link")


@query("SELECT page_id, url FROM pages a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id % 3 = 0 AND b.url = a.url)")
def page_cache(t):
    """Pages that a table of read pages lacks; those that failed are not in it."""
    status = F.when(F.col("page_id") % 3 == 0, 200).when(F.col("page_id") % 3 == 1, 404)
    cache = web.as_cache(t("pages").select("url", status.alias("status"), "html", F.lit(None).cast("string").alias("error"), "page_id"))
    return web.not_cached(t("pages").select("page_id", "url"), cache)


@query("""SELECT key, '  ' || rpad(key, 8, ' ') || rpad(status, 12, ' ') || lpad(CAST(n AS VARCHAR), 6, ' ') || '  ' || substr(note, 1, 52) AS line FROM (SELECT 'fair' AS key, 'ok' AS status, count(*) AS n, '' AS note FROM supplier
UNION ALL SELECT 'old', 'carried', count(*), 'not in --only; kept from previous run' FROM customer HAVING count(*) > 0
UNION ALL SELECT 'app', 'ok', count(*), 'read without a browser (js: menu=' || count(*) FILTER (n_nationkey % 2 = 1) || ', races=' || count(*) FILTER (n_nationkey % 2 = 0) || ')' FROM nation
UNION ALL SELECT * FROM (VALUES ('closed', 'skipped', 0, 'disabled in config'), ('odd', 'error', 0, 'unknown type ''radio'''), ('quiet', 'empty', 0, 'no events parsed')) t)""")
def summary_lines(t):
    """The run's report, one line a site, from what was found, read and carried of each."""
    found = t("supplier").select(F.lit("fair").alias("source"), F.lit(None).cast("string").alias("label")).union(t("nation").select(F.lit("app"), F.when(F.col("n_nationkey") % 2 == 0, "races").otherwise("menu")))
    pages = t("region").select(F.concat(F.lit("https://fair.test/"), F.col("r_regionkey")).alias("url"), F.lit(200).alias("status"), F.lit("").alias("html"), F.lit(None).cast("string").alias("error"))
    listed = sites.read_sites(pages.sparkSession, SITES)
    results = crawl.site_results(listed, found, sites.seed_pages(listed, pages))
    return crawl.summary_lines(results.unionByName(crawl.carried_results(t("customer").select(F.lit("old").alias("source")))))


_FRESH = """SELECT 'Run ' || s_name AS title, 'https://fair.test/e/' || (s_suppkey % 40) AS source_url, 'fair' AS source FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY s_suppkey % 5, s_suppkey) = 1"""


@query(f"SELECT 'Old ' || c_name AS title, 'https://old.test/' || c_custkey AS source_url, 'old' AS source FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 2 = 1 UNION ALL {_FRESH}")
def crawl_refresh(t):
    """A run for one site over an earlier snapshot: other sources' coming events are carried along."""
    old = t("customer").select(F.concat(F.lit("Old "), "c_name").alias("title"), F.concat(F.lit("https://old.test/"), F.col("c_custkey")).alias("source_url"), F.when(F.col("c_custkey") % 3 > 0, "old").otherwise("fair").alias("source"), F.when(F.col("c_custkey") % 2 == 0, "1999-01-01").otherwise("2031-01-01").alias("start"))
    pages = fair_pages(t)
    ran = crawl.crawl(sites.read_sites(pages.sparkSession, SITES), pages, RUN_AT, as_events(old), ["fair"])
    return ran.events.select("title", "source_url", "source")


@query("""SELECT s_suppkey AS page_id, CASE s_suppkey % 6 WHEN 0 THEN 'html (JSON-LD)' WHEN 1 THEN 'js (inline JSON)' WHEN 2 THEN 'html (CSS only)' WHEN 3 THEN 'js present, no events' WHEN 4 THEN 'no data in HTML' ELSE 'unreachable' END AS verdict,
  CAST(s_suppkey % 6 = 0 AS BIGINT) AS jsonld, CAST(s_suppkey % 6 = 1 AS BIGINT) AS js, CAST(s_suppkey % 6 = 2 AS BIGINT) AS css, CASE s_suppkey % 6 WHEN 1 THEN 'races' WHEN 3 THEN 'menu' ELSE '' END AS labels,
  CASE WHEN s_suppkey % 6 < 3 THEN 'Run ' || s_name END AS title FROM supplier""")
def page_verdicts(t):
    """What can be read of pages of six forms."""
    kind, title = F.col("s_suppkey") % 6, F.concat(F.lit("Run "), "s_name")
    linked = _script(F.to_json(F.struct(F.lit("Event").alias("@type"), title.alias("name"), F.lit("/e").alias("url"), F.lit("2030-01-01").alias("startDate"))), "application/ld+json")
    filler = F.lit("on the green behind the old town hall, by the river; " * 5)
    listed = F.concat(F.lit("<script>const races = ["), F.to_json(F.struct(title.alias("title"), F.lit("2030-01-01").alias("date"), F.lit("/e").alias("link"), F.lit("Cork").alias("city"), filler.alias("description"))), F.lit("];</script>"))
    marked = F.concat(F.lit('<ul><li class="race"><a href="/e">'), title, F.lit("</a></li></ul>"))
    menu = F.concat(F.lit("<script>var menu = "), F.to_json(F.struct(F.lit("dark").alias("theme"), filler.alias("intro"))), F.lit(";</script>"))
    html = F.when(kind == 0, linked).when(kind == 1, listed).when(kind == 2, marked).when(kind == 3, menu).when(kind == 4, "<p>none</p>")
    chosen = F.create_map(*[F.lit(x) for kv in {"container": "li.race", "title": "a", "url": "a"}.items() for x in kv])
    pages = t("supplier").select(F.col("s_suppkey").alias("page_id"), F.lit("https://fair.test/").alias("url"), html.alias("html"), chosen.alias("selectors"))
    first = lambda c: F.get(c, 0)
    return crawl.verdicts(pages, RUN_AT).select("page_id", "verdict", "jsonld", "js", "css", F.coalesce(F.array_join("payload_labels", ","), F.lit("")).alias("labels"), F.coalesce(first("jsonld_titles"), first("js_titles"), first("css_titles")).alias("title"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'date TBC' ELSE '2030-05-0' || (p_partkey % 5) END AS day, p_name AS title, 'trail running' AS sport, '5K, 10K' AS distances,
  p_brand || ', Ireland' AS location, CASE WHEN p_partkey % 3 > 0 THEN 'EUR ' || CAST(p_size AS DOUBLE) || CASE WHEN p_partkey % 3 = 2 THEN '–' || CAST(p_size + 1 AS DOUBLE) ELSE '' END END AS price FROM part""")
def display_rows(t):
    """What a list of events shows."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    shown = {
        "id": key.cast("string"), "title": F.col("p_name"), "sport": F.lit("trail_running"), "distances": F.array(F.lit("5K"), F.lit("10K")), "city": F.col("p_brand"), "region": F.lit(""), "country": F.lit("Ireland"), "currency": F.lit("EUR"),
        "start": F.when(key % 5 > 0, F.concat(F.lit("2030-05-0"), key % 5, F.lit("T08:00:00"))).otherwise(""), "price_min": F.when(key % 3 > 0, size), "price_max": F.when(key % 3 == 1, size).when(key % 3 == 2, size + 1),
    }
    return crawl.display_rows(as_events(t("part").withColumns(shown)))


def _props(df, page_id, props):
    """Pages whose state script holds ``props``."""
    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": '), F.to_json(props), F.lit("}}</script>"))
    return extract.page_props(df.select(page_id.cast("long").alias("page_id"), F.lit("https://run.test/list").alias("url"), F.lit("https://run.test/e/{slug}").alias("url_template"), state.alias("html")))


@query("""SELECT p_partkey AS page_id, p_name || ' Run' AS title, 'https://run.test/e/part-' || p_partkey AS source_url, '2030-02-03T00:00:00' AS start, 'running' AS sport, '10K, 5K' AS distances, CAST(p_size AS DOUBLE) AS price_min,
  CAST(p_size + 100 AS DOUBLE) AS price_max, 'INR' AS currency, p_brand AS city, 'About ' || p_name AS description FROM part""")
def detail_pages(t):
    """Parts as detail pages with two categories each."""
    kind = lambda distance, price: F.struct(F.lit("running").alias("sportName"), F.struct(F.lit(distance).alias("distance")).alias("distance"), F.struct(price.cast("string").alias("value"), F.lit("INR").alias("currency")).alias("price"))
    info = F.struct(F.concat(F.col("p_name"), F.lit(" Run")).alias("title"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("slug"), F.lit("2030-02-03").alias("eventDate"), F.struct(F.col("p_brand").alias("city")).alias("location"), F.array(kind("10K", F.col("p_size") + 100), kind("5K", F.col("p_size"))).alias("categories"), F.array(F.struct(F.concat(F.lit("<p>About "), F.col("p_name"), F.lit("</p>")).alias("content"))).alias("aboutRace"))
    events = mappers.detail_events(_props(dealt(t("part")), F.col("p_partkey"), F.struct(info.alias("eventInfo"))), RUN_AT)
    return events.select(F.col("page.page_id").alias("page_id"), "title", "source_url", "start", "sport", F.array_join("distances", ", ").alias("distances"), "price_min", "price_max", "currency", "city", "description")


@query("""SELECT s_suppkey % 5 AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'supplier ' || s_suppkey END AS title, 'https://run.test/e/supplier-' || s_suppkey AS source_url, '2030-03-0' || (s_suppkey % 5 + 1) || 'T00:00:00' AS start,
  'cycling' AS sport, '10K' AS distances, 250.0::DOUBLE AS price_min FROM supplier""")
def listing_pages(t):
    """Suppliers as rows of five listing pages, half of them titled by their slug only."""
    key = F.col("s_suppkey")
    item = F.struct(F.when(key % 2 == 0, F.col("s_name")).otherwise("").alias("title"), F.concat(F.lit("supplier-"), key).alias("slug"), F.struct(F.concat(F.lit("2030-03-0"), key % 5 + 1).alias("start")).alias("eventDate"), F.array(F.struct(F.lit("10K").alias("category"))).alias("categories"), F.array(F.lit("cycling")).alias("sportsType"), F.lit("250").alias("price"))
    listed = t("supplier").groupBy((key % 5).alias("page")).agg(F.collect_list(item).alias("events"))
    events = mappers.listing_events(_props(listed, F.col("page"), F.struct(F.struct("events").alias("eventsData"))), RUN_AT)
    return events.select(F.col("page.page_id").alias("page_id"), "title", "source_url", "start", "sport", F.array_join("distances", ", ").alias("distances"), "price_min")
