import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from pacegrid.operators import geocode
from pacegrid.schema import EVENT_DDL, as_events
from pacegrid.sources import snapshots, web
from pacegrid.streaming import refresh


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        known = {"/robots.txt": "User-agent: *\nDisallow: /private", "/a": "<p>a</p>"}
        self.send_response(200 if self.path in known else 404)
        self.end_headers()
        self.wfile.write(known.get(self.path, "").encode())

    def log_message(self, *_):
        pass


def test_pages_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(web.PagesSource)
    df = spark.read.format("pages").option("urls", f"{base}/a {base}/b {base}/private/x {base}/a").option("delay", "0").load()
    rows = {r["url"].removeprefix(base): r for r in df.collect()}
    server.shutdown()
    assert {k: v["status"] for k, v in rows.items()} == {"/a": 200, "/b": 404, "/private/x": None}
    assert rows["/a"]["html"] == "<p>a</p>"


def test_snapshots(spark, tmp_path):
    events = as_events(spark.createDataFrame([("Run", "s", "https://x.test/1", "1"), ("Ride", "s", "https://x.test/2", "2")], "title string, source string, source_url string, id string")).coalesce(1)
    for format in ("json", "parquet"):
        snapshots.write_snapshot(events, str(tmp_path / format), format)
        assert snapshots.read_snapshot(spark, str(tmp_path / format), format).collect() == events.collect()
    assert not snapshots.read_snapshot(spark, str(tmp_path / "none")).collect()
    for name, array in (("wide", '[\n {"title": "Run",\n  "id": "1"},\n {"title": "Ride", "id": "2", "more": 1}\n]\n'), ("flat", '[{"title": "Run", "id": "1"}, {"title": "Ride", "id": "2"}]'), ("empty", "")):
        (tmp_path / name).write_text(array)
        assert [r["title"] for r in snapshots.read_snapshot(spark, str(tmp_path / name)).collect()] == ([] if name == "empty" else ["Run", "Ride"])


PLACES = {("Tralee, Kerry", "IN"): None, ("Tralee", "IN"): (25.0, 73.8, 30.0, "city"), ("Atlantica", "IN"): (20.0, 78.0, 3000.0, "country"), ("Sligo", "IN"): (18.52, 73.85, None, "city")}


def test_geocoding(spark, tmp_path):
    rows = [("1", "Sligo", None, None), ("2", "Tralee", "Kerry", None), ("3", "Atlantica", None, None), ("4", "Sligo", None, 12.97)]
    events = spark.createDataFrame(rows, "id string, city string, region string, latitude double").select("*", F.lit("IN").alias("country"), (F.col("latitude") * 6).alias("longitude"), F.lit(None).cast("string").alias("coords_source"))
    calls = str(tmp_path / "calls")

    def find(query, country):
        with open(calls, "a") as file:
            file.write(f"{query}\n")
        return PLACES.get((query, country))

    known = spark.createDataFrame([], geocode.PLACE)
    places = spark.createDataFrame(geocode.look_up(geocode.place_keys(events), known, find, 0).collect(), geocode.PLACE)
    found = {r["id"]: r for r in geocode.annotate(events, places).collect()}
    assert [found[k]["latitude"] for k in "1234"] == [18.52, 25.0, None, 12.97]
    assert [found[k]["coords_source"] for k in "1234"] == ["geocoded", "geocoded", None, "listing"]
    before = len(open(calls).readlines())
    assert geocode.look_up(geocode.place_keys(events), places, find, 0).count() == places.count()
    assert len(open(calls).readlines()) == before


def test_geocoding_gives_up(spark, tmp_path):
    keys = spark.createDataFrame([(str(i), 0, f"k{i}|", f"k{i}", "") for i in range(10)], "id string, rank int, key string, query string, country string")
    calls = str(tmp_path / "calls")

    def find(query, country):
        with open(calls, "a") as file:
            file.write(f"{query}\n")
        raise OSError("offline")

    assert not geocode.look_up(keys, spark.createDataFrame([("k1|", "k1", "", 1.0, 1.0, True, 1)], geocode.PLACE), find, 0).collect()
    assert len(open(calls).readlines()) == 3


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda title, at: as_events(spark.createDataFrame([(title, "1", at)], "title string, id string, scraped_at string"))
    for title, at in (("Old", "2026-01-01"), ("New", "2026-01-02")):
        make(title, at).write.mode("append").parquet(source)
        refresh.refresh(spark.readStream.schema(EVENT_DDL).parquet(source), out, str(tmp_path / "state")).awaitTermination()
    assert [r["title"] for r in refresh.newest(spark.read.parquet(out)).collect()] == ["New"]
