"""Sites that are read as services: paged answers of races or posts, and listings with detail pages.

A site's form is looked up by its type and key, or given by its setting ``service``. Its rows are those that
crawl() takes as ``served``, in the order in which the service gives them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.functions import fixed
from pacegrid.operators import extract, mappers, relational
from pacegrid.operators.crawl import _RECORD, JSON_LD, placed
from pacegrid.operators.lineage import dealt, written
from pacegrid.sources import sites, web

#: Answers of many rows each that a task is dealt.
DEALT_ANSWERS = 1_000
#: Bits of a page id that number the pages of a kind.
KIND_BITS = 20


def _page(site: dict, number: Column, url: Column, template: str | None = None) -> Column:
    page_id = F.shiftleft(F.lit(site["site_no"]).cast("long"), sites.PAGE_BITS) + number.cast("long")
    return F.struct(page_id.alias("page_id"), F.lit(site["key"]).alias("source"), url.alias("url"), F.lit(template).cast("string").alias("url_template")).alias("page")


def _options(site: dict, options: dict) -> dict:
    delay = site["settings"].get("delay_seconds")
    return options | ({"delay": delay} if delay and "delay" not in options else {})


def race_answers(spark: SparkSession, site: dict, run_at: str, options: dict) -> DataFrame:
    """(page, kind, json) of a race service: each of the site's kinds, within its window of days; both are conditions on the
    source, which makes them parameters of the requests."""
    given = site["settings"]
    kinds = given.get("event_types", "running_race").split()
    link = given.get("url", fixed.SERVICES["runsignup"][1])
    per_page = given.get("results_per_page", "50")
    parameters = {"format": "json", "results_per_page": per_page, "page": "{page}", "events": "T", "event_type": "{kind}"}
    own = {"url": web.service_url(link, parameters), "kinds": " ".join(kinds), "pages": given.get("max_pages_per_type", "2"), "per_page": per_page, "list": "races"}
    window = web.date_window(date.fromisoformat(run_at[:10]), given.get("date_from"), given.get("date_to"), int(given.get("days_ahead", 0)))
    answers = spark.read.format("paged").options(**_options(site, options), **own).load().where(F.col("kind").isin(kinds))
    for column, name in (("date_from", "race_event_days_from"), ("date_to", "race_event_days_to")):
        answers = answers.where(F.col(column) == F.lit(window[name]).cast("date")) if name in window else answers
    order = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)]), F.col("kind"))
    # one task reads a kind, but its answers are mapped by many
    return dealt(written(answers.where("status = 200").select(_page(site, F.shiftleft(order.cast("long"), KIND_BITS) + F.col("place"), F.col("url")), "kind", "json")), DEALT_ANSWERS)


def post_answers(spark: SparkSession, site: dict, run_at: str, options: dict) -> DataFrame:
    """(page, json) of a blog service."""
    given = site["settings"]
    per_page = given.get("per_page", "100")
    own = {"url": web.service_url(given.get("url", fixed.SERVICES["hyrox"][1]), {"per_page": per_page, "page": "{page}"}), "pages": given.get("max_pages", "3"), "per_page": per_page}
    answers = spark.read.format("paged").options(**_options(site, options), **own).load()
    return answers.where("status = 200").select(_page(site, F.col("place"), F.col("url")), "json")


def _listed(spark: SparkSession, site: dict, run_at: str, options: dict) -> DataFrame:
    """Events of listing pages, put in order with those of the detail pages that the sitemap names, the first so many of them.

    Two scans: the sitemap's answer gives the links of the second one, which never pass through the driver. A
    link keeps the place where it first came; what its detail page tells stands for all that the listing did.
    """
    given, own = site["settings"], _options(site, options)
    sitemap, template = given.get("sitemap", fixed.SERVICES["indiarunning"][1]), site["url_template"] or fixed.SERVICES["indiarunning"][2]
    seeds = spark.createDataFrame(list(enumerate(site["seeds"])), "seed_no long, url string")
    pages = written(web.fetched(seeds.select("url"), own).where("status = 200"))
    shown = seeds.join(dealt(pages, DEALT_ANSWERS), "url").select(F.lit(site["key"]).alias("source"), _page(site, F.col("seed_no"), F.col("url"), template)["page_id"].alias("page_id"), "url", F.lit(template).alias("url_template"), "html")
    listings = mappers.listing_events(extract.page_props(shown), run_at)
    listings = listings.select(F.struct("page.page_id", F.col("at").cast("long").alias("at")).alias("came"), *_RECORD)
    details = listings.limit(0)
    if given.get("use_sitemap", "True") != "False":
        named = written(web.fetched(spark.createDataFrame([(sitemap,)], "url string"), own).where("status = 200"))
        links = sites.sitemap_links(named, limit=int(given.get("max_detail_pages", 40)))
        links = written(relational.numbered(links, [F.col("page"), F.col("place")], "detail_no").select(F.col("link").alias("url"), "detail_no"))
        found = written(web.fetched(links.select("url"), own).where("status = 200"))
        number = F.lit(1 << (sites.PAGE_BITS - 1)).cast("long") + F.col("detail_no")
        told = links.join(dealt(found), "url").select(F.lit(site["key"]).alias("source"), _page(site, number, F.col("url"), template)["page_id"].alias("page_id"), "url", F.lit(template).alias("url_template"), "html")
        details = mappers.detail_events(extract.page_props(told), run_at).select(F.struct("page.page_id", F.col("at").cast("long").alias("at")).alias("came"), *_RECORD)
    merged = relational.ordered_upsert(listings, details, "source_url", "came")
    page_id = F.shiftleft(F.lit(site["site_no"]).cast("long"), sites.PAGE_BITS) + F.shiftleft(F.col("position.side").cast("long"), sites.PAGE_BITS - 1)
    ranked = relational.numbered(merged, [F.col("position")], "place")
    return ranked.select(page_id.alias("page_id"), F.lit(JSON_LD).alias("rank"), F.lit(None).cast("string").alias("label"), F.col("place").cast("int").alias("place"), *_RECORD)


#: A form's reader: (session, site, time of the run, options of the web sources) to placed() rows.
FORMS: dict[str, Callable[[SparkSession, dict, str, dict], DataFrame]] = {
    "races": lambda *a: placed(mappers.race_events(race_answers(*a), a[2]), JSON_LD),
    "posts": lambda *a: placed(mappers.post_events(post_answers(*a), a[2]), JSON_LD),
    "listing": _listed,
}


def form_of(site: dict) -> str | None:
    """The form that a site is read in; null for pages that are read by their seeds."""
    if site["settings"].get("service"):
        return site["settings"]["service"]
    return fixed.SERVICES[site["key"]][0] if site["type"] in ("api", "nextdata") and site["key"] in fixed.SERVICES else None


def served(site_list: DataFrame, run_at: str, only: list[str] | None = None, options: dict | None = None) -> DataFrame | None:
    """Rows for crawl()'s ``served``: what the enabled services among ``site_list`` (see read_sites) give; null without any.

    The list of sites is a setting of the run and read by the driver; answers are not. A service's own errors leave it without rows.
    """
    spark, out = site_list.sparkSession, None
    web.register(spark)
    for row in sites.select_sites(site_list, only).where("enabled").orderBy("site_no").collect():
        site = row.asDict() | {"settings": row["settings"] or {}}
        form = form_of(site)
        if form in FORMS:
            rows = written(FORMS[form](spark, site, run_at, options or {}))
            out = rows if out is None else out.unionByName(rows)
    return out
