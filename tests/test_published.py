"""Versioned sinks and the crawl frontier: what fails half-way, what is repeated, and what readers see."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pacegrid.functions import fixed
from pacegrid.operators import crawl, geocode
from pacegrid.schema import as_events
from pacegrid.sources import published
from pacegrid.streaming import frontier


def test_versions(spark, tmp_path):
    folder, n = str(tmp_path / "out"), lambda k: spark.range(k).toDF("n")
    assert published.current(spark, folder) is None and published.published(spark, folder, "a") is None
    first = published.publish({"a": n(3), "b": n(1)}, folder)
    old = published.published(spark, folder, "a")
    broken = n(5).select(F.raise_error(F.lit("half-way")).alias("n"))
    with pytest.raises(Exception, match="half-way"):
        published.publish({"a": n(4), "b": broken}, folder)  # a is written, b fails
    assert published.current(spark, folder) == first
    assert [published.published(spark, folder, x).count() for x in "ab"] == [3, 1]
    second = published.publish({"a": published.published(spark, folder, "a").union(n(2)), "b": n(2)}, folder)
    assert [published.published(spark, folder, x).count() for x in "ab"] == [5, 2] and old.count() == 3
    published.publish({"a": n(1)}, folder, keep=1)
    assert published.versions(spark, folder)[0] == second and len(published.versions(spark, folder)) == 2
    assert published.published(spark, folder, "b", second).count() == 2


def test_annotation_of_what_is_published(spark, tmp_path):
    folder = str(tmp_path / "run")
    rows = [("1", "Sligo", None, None), ("2", "Nowhere", None, None), ("3", "Sligo", 1.5, "listing")]
    events = as_events(spark.createDataFrame(rows, "id string, city string, latitude double, coords_source string").withColumn("longitude", F.col("latitude")).withColumn("country", F.lit("IE")))
    report = spark.createDataFrame([(7, 0, 2)], "total_events long, geocoded long, without_coords long")
    sites = spark.createDataFrame([("a", "blocked"), ("b", "ok")], "key string, status string")
    assert published.annotate_published(spark, folder, spark.createDataFrame([], geocode.PLACE)) is None
    published.save_crawl(crawl.Crawl(events, sites, report), folder, "2029-06-01")
    calls = str(tmp_path / "calls")

    def find(query, country):
        with open(calls, "a") as file:
            file.write(f"{query}\n")
        return (54.2, -8.4, 9.0, "city") if query == "Sligo" else None

    places = published.save_places(spark, str(tmp_path / "places"), geocode.place_keys(events), find, pause=0)
    asked = len(open(calls).readlines())
    places = published.save_places(spark, str(tmp_path / "places"), geocode.place_keys(events), find, pause=0)
    assert asked == len(open(calls).readlines()) == places.count() == 2 and places.first()["version"] == fixed.CACHE_VERSION
    published.annotate_published(spark, folder, places)
    found = {r["id"]: (r["latitude"], r["coords_source"]) for r in published.published(spark, folder, "events").collect()}
    assert found == {"1": (54.2, "geocoded"), "2": (None, None), "3": (1.5, "listing")}
    assert tuple(published.published(spark, folder, "report").first()) == (7, 1, 1, "2029-06-01")
    assert [r["key"] for r in crawl.blocked(published.published(spark, folder, "sites")).collect()] == ["a"]


class Site(BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):
        Site.asked.append(self.path)
        status = {"/robots.txt": 404, "/gone": 410}.get(self.path, 200)
        if self.path == "/flaky" and Site.asked.count("/flaky") < 2:
            status = 503
        self.send_response(status)
        self.end_headers()
        self.wfile.write(self.path.encode())

    def log_message(self, *_):
        pass


def test_frontier(spark, tmp_path, monkeypatch):
    """A batch that dies after some of its fetches is fetched again; finished batches and answered links are not."""
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    arrived, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: frontier.fetch(spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).json(arrived), table, state, {"delay": "0", "retries": "0"}).awaitTermination()
    arrive = lambda *paths: spark.createDataFrame([(base + p if p else None,) for p in paths], "url string").coalesce(1).write.mode("append").json(arrived)
    arrive("/a", "/flaky", "/gone", "/a", None)
    run()
    assert {r["url"].removeprefix(base): r["state"] for r in frontier.states(spark, table).collect()} == {"/a": "done", "/flaky": "open", "/gone": "failed"}
    fetched = frontier.web.fetched

    def dies(links, *rest):
        fetched(links, *rest).collect()
        raise RuntimeError("killed")

    monkeypatch.setattr(frontier.web, "fetched", dies)
    arrive("/a", "/b", "/flaky")
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(frontier.web, "fetched", fetched)
    before = {p: Site.asked.count(p) for p in ("/a", "/gone")}
    run()
    run()
    server.shutdown()
    assert {p: Site.asked.count(p) for p in before} == before == {"/a": 1, "/gone": 1}
    assert Site.asked.count("/b") == 2  # once by the batch that died, once by its repetition
    found = {r["url"].removeprefix(base): (r["attempts"], r["tries"], r["status"], r["state"]) for r in frontier.states(spark, table).collect()}
    assert found == {"/a": (1, 1, 200, "done"), "/b": (1, 1, 200, "done"), "/flaky": (2, 2, 200, "done"), "/gone": (1, 1, 410, "failed")}
    assert {r["url"].removeprefix(base): r["html"] for r in frontier.pages(spark, table).collect()} == {"/a": "/a", "/b": "/b", "/flaky": "/flaky", "/gone": None}
    assert frontier.requests_made(spark, table).first()[0] == 5
    assert not frontier.states(spark, str(tmp_path / "none")).count()


def test_links_are_given_up(spark, tmp_path):
    rows = [("u", 503, None, "HTTP 503", 3, 0), ("u", 503, None, "HTTP 503", 3, 4), ("v", None, None, "disallowed by robots.txt", 0, 0)]
    spark.createDataFrame(rows, frontier.TRIES).write.parquet(str(tmp_path / "out"))
    assert sorted((r["url"], r["attempts"], r["state"]) for r in frontier.states(spark, str(tmp_path / "out")).collect()) == [("u", 6, "failed"), ("v", 0, "failed")]
    assert {r["url"]: r["state"] for r in frontier.states(spark, str(tmp_path / "out"), before=4).collect()} == {"u": "open", "v": "failed"}
