"""Paged services, their conditions and the cache as transport, listings with detail pages, and the ordered upsert."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import relational
from pacegrid.plans.collected import stored
from pacegrid.sources import services, sites, web

RUN_AT = "2029-06-01T00:00:00+00:00"


def answers(spark, rows):
    return stored(spark.createDataFrame(rows, "url string, status int, text string"))


@pytest.fixture(scope="module")
def paged(spark):
    """Kinds: full (two pages and a short one), empty (an empty page), failed (an error behind a full page), ended (a 400), odd (no JSON)."""
    web.register(spark)
    page = lambda n: json.dumps({"rows": list(range(n))})
    rows = [(f"s://x/full?page={k}", 200, page(2 if k < 3 else 1)) for k in (1, 2, 3, 4)] + [("s://x/empty?page=1", 200, page(0)), ("s://x/empty?page=2", 200, page(2))]
    rows += [("s://x/failed?page=1", 200, page(2)), ("s://x/failed?page=2", 500, None), ("s://x/failed?page=3", 200, page(2)), ("s://x/ended?page=1", 200, page(2)), ("s://x/ended?page=2", 400, None), ("s://x/odd?page=1", 200, "<p>")]
    rows += [("s://x/full?page=1&from_day=2029-06-01&to_day=2029-07-01", 200, page(1))]
    own = {"url": "s://x/{kind}?page={page}", "kinds": "full empty failed ended odd", "pages": "9", "per_page": "2", "list": "rows", "from": "from_day", "to": "to_day"}
    return lambda: spark.read.format("paged").options(**answers(spark, rows), **own).load()


def test_paging_ends(paged):
    found = {}
    for r in paged().collect():
        found.setdefault(r["kind"], []).append((r["place"], r["status"]))
    assert found == {"full": [(1, 200), (2, 200), (3, 200)], "empty": [(1, 200)], "failed": [(1, 200), (2, 500)], "ended": [(1, 200)], "odd": [(1, 200)]}


def test_conditions_reach_the_service(spark, paged, capsys):
    day = lambda text: F.lit(text).cast("date")
    asked = paged().where(F.col("kind").isin("full", "none") & (F.col("date_from") == day("2029-06-01")) & (F.col("date_to") == day("2029-07-01")))
    asked.explain()
    assert "Filter " not in capsys.readouterr().out  # of a node; the scan itself says RuntimeFilters
    assert [(r["url"], r["date_from"]) for r in asked.collect()] == [("s://x/full?page=1&from_day=2029-06-01&to_day=2029-07-01", date(2029, 6, 1))]
    assert asked.rdd.getNumPartitions() == 1
    # what a service can't be asked stays with Spark, and so do conditions that contradict each other
    assert {r["kind"] for r in paged().where("kind like 'e%'").collect()} == {"empty", "ended"}
    assert not paged().where((F.col("date_from") == day("2029-06-01")) & (F.col("date_from") == day("2029-06-02"))).collect()
    assert not paged().where((F.col("kind") == "full") & (F.col("kind") == "odd")).collect()
    assert not paged().where("date_from is not null").collect()


def test_fetched_from_a_cache(spark):
    options = answers(spark, [("https://a.test/1", 200, "<p>ä</p>"), ("https://a.test/2", 404, None), ("https://b.test/robots.txt", 200, "User-agent: *\nDisallow: /x")])
    links = spark.createDataFrame([("https://a.test/1",), ("https://a.test/2",), ("https://a.test/1",), ("https://b.test/x",), ("https://b.test/y",), (None,)], "url string")
    found = {r["url"]: tuple(r)[1:] for r in web.fetched(links, options).collect()}
    assert found == {"https://a.test/1": (200, "<p>ä</p>", None, 1), "https://a.test/2": (404, None, "HTTP 404", 1), "https://b.test/x": (None, None, "disallowed by robots.txt", 0), "https://b.test/y": (404, None, "not stored", 1)}


def test_sites_and_their_forms(spark):
    text = "defaults: {delay_seconds: 3}\nsites: [{key: runsignup, type: api, event_types: [a, b]}, {key: hyrox, type: api}, {key: indiarunning, type: nextdata}, {key: own, type: api, service: posts}, {key: hyrox2, type: jsonld}, {key: off, type: api, enabled: false, service: posts}]"
    rows = [r.asDict() for r in sites.read_sites(spark, text).orderBy("site_no").collect()]
    assert [services.form_of(r) for r in rows] == ["races", "posts", "listing", "posts", None, "posts"]
    assert rows[0]["settings"]["event_types"] == "a b" and rows[0]["settings"]["delay_seconds"] == "3"
    links = spark.createDataFrame([(r["site_no"], "k", [f"u{i}" for i in range(3)]) for r in rows], "site_no long, key string, seeds array<string>").select("*", *[F.lit(None).alias(c) for c in ("url_template", "selectors")], F.lit(True).alias("enabled"), F.lit(True).alias("use_js"), F.lit(False).alias("requires_js"))
    pages = spark.createDataFrame([], "url string, status int, html string, error string")
    assert sites.seed_pages(links, pages).select("page_id").distinct().count() == 18


def test_posts_in_order(spark):
    post = lambda k: {"title": {"rendered": f"HYROX Town{k}"}, "link": f"https://p.test/{k}"}
    options = answers(spark, [("https://p.test/api?per_page=2&page=1", 200, json.dumps([post(1), post(2)])), ("https://p.test/api?per_page=2&page=2", 200, json.dumps([post(3)]))])
    text = "sites: [{key: p, type: api, service: posts, url: 'https://p.test/api', per_page: 2}, {key: down, type: api, service: posts, url: 'https://q.test/api'}]"
    found = services.served(sites.read_sites(spark, text), RUN_AT, options=options)
    assert [(r["source"], r["city"], r["date_status"]) for r in found.orderBy("page_id", "place").collect()] == [("p", f"Town{k}", "unavailable_phase1") for k in (1, 2, 3)]
    assert services.served(sites.read_sites(spark, "sites: [{key: a, seeds: [u]}]"), RUN_AT) is None


def brute_upsert(listings, details):
    out = {}
    for k, *row in listings:
        out.setdefault(k, row)
    for k, *row in details:
        out[k] = row
    return [(k, *row) for k, row in out.items()]


def test_ordered_upsert(spark):
    """Against a dictionary that keeps the order of insertion; one key holds a third of the rows, and null is a key."""
    listings = [(None if k % 7 == 0 else f"k{k % 5 if k % 3 else 0}", k, f"l{k}") for k in range(60)]
    details = [(None if k % 11 == 0 else f"k{k % 9}", k, f"d{k}") for k in range(40)]
    frames = [spark.createDataFrame(rows, "key string, place long, said string").repartition(5) for rows in (listings, details)]
    found = [(r["key"], r["place"], r["said"]) for r in relational.ordered_upsert(*frames, "key", "place").orderBy("position").collect()]
    assert found == brute_upsert(listings, details)
    assert [tuple(r)[:3] for r in relational.ordered_upsert(frames[0], frames[1].limit(0), "key", "place").orderBy("position").collect()] == brute_upsert(listings, [])
    assert not relational.ordered_upsert(frames[0].limit(0), frames[1].limit(0), "key", "place").count()


def test_cached_links_of_one_host_are_dealt(spark, tmp_path):
    from pacegrid.sources import web

    links = spark.range(40).selectExpr("concat('https://one.test/', id) AS url")
    cached = lambda **more: web.fetched(links, {"cache": str(tmp_path / "none"), "offline": "true", "delay": "0", **more}, 8)
    readers = lambda df: df.selectExpr("spark_partition_id() AS p").distinct().count()
    assert readers(cached()) > 1 and readers(cached(delay="0.001")) == 1


def test_answers_share_files(spark, tmp_path):
    """2,000 answers took as many files; repeated links give their last answer, whatever lies beside it, and a cache of the earlier form is still read."""
    folder = str(tmp_path / "cache")
    first = spark.range(2_000).select(F.concat(F.lit("s://x/"), "id").alias("url"), F.lit(200).alias("status"), F.concat(F.lit('{"key":"\u2028\n'), "id", F.lit('"}')).alias("text"))
    web.store_answers(first, folder)
    assert len(list((tmp_path / "cache").rglob("part-*"))) <= 16
    web.store_answers(spark.createDataFrame([("s://x/7", 404, None), ("s://x/new", None, None), (None, 200, "")], "url string, status int, text string"), folder)
    web.store_answers(first.where("id = 8").withColumn("text", F.repeat(F.lit("long "), 2_000_000)), folder)
    digest = hashlib.sha1(b"s://x/old").hexdigest()
    (tmp_path / "cache" / f"key={digest}").mkdir()
    (tmp_path / "cache" / f"key={digest}" / "part-0.txt").write_text('{"status":200,"text":"old"}\n')
    asked = first.select("url").union(spark.createDataFrame([("s://x/new",), ("s://x/old",), ("s://x/none",)], "url string"))
    for delay in ("0", "0.000001"):
        found = {r["url"]: (r["status"], r["html"]) for r in web.fetched(asked, {"cache": folder, "offline": "true", "delay": delay, "retries": "0"}, 3).collect()}
        odd = {f"s://x/{k}": found.pop(f"s://x/{k}") for k in (7, 8, "new", "old", "none")}
        assert odd == {"s://x/7": (404, None), "s://x/8": (200, "long " * 2_000_000), "s://x/new": (None, None), "s://x/old": (200, "old"), "s://x/none": (404, None)}
        assert len(found) == 1_998 and all(v == (200, '{"key":"\u2028\n' + k.removeprefix("s://x/") + '"}') for k, v in found.items())
