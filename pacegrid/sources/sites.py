"""The list of sites and lists of links."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.operators.relational import first_per_key

SITE = (
    "site_no long, key string, name string, type string, enabled boolean, requires_js boolean, note string, default_country string, url_template string, use_js boolean, "
    "selectors map<string,string>, seeds array<string>, sports_only boolean, drop_past boolean, settings map<string,string>"
)
#: Bits of a page id that number the seeds or pages of a site.
PAGE_BITS = 40
TYPES = ("jsonld", "css", "api", "nextdata")


def read_sites(spark: SparkSession, text: str) -> DataFrame:
    """Sites of a YAML text with ``defaults`` and ``sites``, in order; a site's own setting goes before the default, even a null one.

    The list is a setting of the run, written by hand. An empty text gives no rows.
    """
    given = yaml.safe_load(text) or {}
    defaults, rows = given.get("defaults") or {}, []
    for number, own in enumerate(given.get("sites") or []):
        site = defaults | own
        key = str(site.get("key", "?"))
        yes = lambda name, otherwise, site=site: bool(site.get(name, otherwise))
        rows.append((number, key, site.get("name", key), site.get("type", "jsonld"), yes("enabled", True), yes("requires_js", False), site.get("note"), site.get("default_country"), site.get("url_template"), yes("use_js", True), site.get("selectors"), site.get("seeds") or [], bool(defaults.get("sports_only", True)), bool(defaults.get("drop_past", True)), _settings(site)))
    return spark.createDataFrame(rows, SITE)


def _settings(site: dict) -> dict[str, str]:
    """All scalars of a site and its lists of scalars, joined by spaces, as texts."""
    flat = {k: " ".join(map(str, v)) if isinstance(v, list) else v for k, v in site.items() if not isinstance(v, dict)}
    return {str(k): str(v) for k, v in flat.items() if v is not None}


def select_sites(sites: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The sites that a run is asked for; all without a wish."""
    return sites.where(F.col("key").isin(*only)) if only else sites


def seed_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds of enabled sites with what was read of them: page_id (in order of sites and seeds), source, url, html, status, error
    and the site's url_template, use_js, selectors, requires_js. Of a site that needs a browser only the first seed is tried."""
    seeds = sites.where("enabled").select("site_no", "key", "url_template", "use_js", "selectors", "requires_js", F.posexplode("seeds").alias("seed_no", "url")).where("not requires_js or seed_no = 0")
    numbered = seeds.withColumn("page_id", F.shiftleft("site_no", PAGE_BITS) + F.col("seed_no"))
    return numbered.join(pages.select("url", "status", "html", "error"), "url", "left").select("page_id", F.col("key").alias("source"), "url", "html", "status", "error", "url_template", "use_js", "selectors", "requires_js")


def read_links(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct links of text files, one a line, in order of first appearance: url, place."""
    every = None
    for number, path in enumerate(paths):
        lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("url"), F.lit(number).alias("file"), F.monotonically_increasing_id().alias("line")).where("url <> ''")
        every = lines if every is None else every.union(lines)
    return first_per_key(every, ["url"], [F.col("file"), F.col("line")]).select("url", F.struct("file", "line").alias("place"))


def sitemap_links(sitemap: DataFrame, part: str = "/events/", limit: int | None = None) -> DataFrame:
    """Links of sitemap texts (url, html) that contain ``part``: page, place, link; the first of each stays, up to ``limit`` of them."""
    found = sitemap.select(F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("place", "link")).where(F.contains("link", F.lit(part)))
    once = first_per_key(found, ["link"], [F.col("page"), F.col("place")])
    return once.orderBy("page", "place").limit(limit) if limit else once
