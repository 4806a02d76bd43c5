"""Events from what pages and services hold: schema.org nodes, loose objects, selected elements and three API shapes.

Every mapper takes rows with a ``page`` (see extract.with_page) and gives the event record with ``page`` in front and
an ``at`` to order by; rows without a title or a link are left out. ``run_at`` is the time of the run as text.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.functions import fixed
from pacegrid.functions.geo import brand_city
from pacegrid.functions.sports import classify_sport
from pacegrid.functions.text import blank_to_null, clean_text, coerce_list, first_of, json_at, settled, slug_words, with_clean
from pacegrid.functions.urls import fill_template, with_links
from pacegrid.functions.values import address_parts, distance_pairs, distinct_parts, json_number, offers_parts, parse_distances, parse_price, stable_id, status_name, with_date_list, with_dates
from pacegrid.operators.extract import field, inner_field, scalar
from pacegrid.operators.relational import first_per_key
from pacegrid.schema import EVENT_DDL

LIMITS = {"t_description": 600}
NAME_LIMITS = {"t_venue_name": 200, "t_organizer": 200}
_RECORD = [x.strip().split(" ", 1) for x in EVENT_DDL.split(",")]


def run_day(run_at: str) -> date:
    """The day of a run, which stands in for what dates leave out."""
    return date.fromisoformat(run_at[:10])


def _get(json: Column, path: str) -> Column:
    return json_at(json, path)


def _is_object(json: Column) -> Column:
    return F.coalesce(F.ltrim(json).startswith("{"), F.lit(False))


def _objects(json: Column) -> Column:
    """Objects of a JSON list, or the one there is."""
    return F.filter(coerce_list(json), lambda x: F.ltrim(x).startswith("{"))


def _clean_list(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda x: clean_text(x, full_entities=False)), lambda x: x.isNotNull())


def _address(json: Column) -> dict[str, Column]:
    """Texts of an address: its parts if it is an object, else the whole."""
    placed = _is_object(json)
    return {"plain": F.when(~placed, json), **{k: F.when(placed, v) for k, v in address_parts(json).items()}}


def _joined_address() -> dict[str, Column]:
    """The address out of the cleaned texts of _address()."""
    return {"address": F.coalesce("t_plain", distinct_parts(*[F.col(f"t_{k}") for k in ("street", "city", "region", "postal", "country")]))}


def _subtypes(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))))


def _template_link() -> Column:
    return F.when(F.col("page.url_template").isNotNull(), fill_template(F.col("page.url_template"), F.col("t_slug")))


def _events(rows: DataFrame, at: Column, texts: dict[str, Column], links: dict[str, Column], rest: dict[str, Column], dates: dict[str, Column], run_at: str, base: Column | None = None, limits: dict[str, int] | None = None, distances: Column | None = None) -> DataFrame:
    """Event records of ``rows`` with a title and a link. ``texts`` are cleaned (t_name), ``links`` cleaned and made absolute
    (l_name), ``dates`` read (d_name); ``rest`` may build on all of these and goes before them. ``distances`` are texts of distances."""
    if distances is not None:
        rows = rows.withColumn("pairs", distance_pairs(_clean_list(distances)))
        rest = rest | dict(zip(("distances", "distance_km"), parse_distances(F.col("pairs")), strict=True))
    rows = with_clean(rows.withColumn("at", at), {f"t_{k}": c for k, c in texts.items()} | {f"l_{k}": c for k, c in links.items()}, {k: v for k, v in (LIMITS | (limits or {})).items() if k[2:] in texts})
    rows = with_links(rows, [f"l_{k}" for k in links], base)
    rows = with_dates(rows, {f"d_{k}": c for k, c in dates.items()}, run_day(run_at)) if dates else rows
    columns = {k: F.col(f"{sign}_{k}") for sign, own in (("t", texts), ("l", links), ("d", dates)) for k in own} | rest
    given = rows.withColumns({f"e_{k}": c for k, c in columns.items()})
    given = given.select("page", "at", *[F.col(f"e_{k}").alias(k) for k in columns if k in dict(_RECORD)])
    given = settled(given, F.col("title").isNotNull() & F.col("source_url").isNotNull())
    given = given.withColumns({"source": F.col("page.source"), "found_on_url": F.col("page.url"), "scraped_at": F.lit(run_at), "id": stable_id(F.coalesce("page.source", F.lit("")), F.col("source_url"))})
    filled = {"date_status": F.lit("ok"), "is_online": F.lit(False), "ticket_url": F.col("source_url"), **{k: F.array().cast(t) for k, t in (("distances", "array<string>"), ("distance_km", "array<double>"), ("event_subtypes", "array<string>"))}}
    given = given.withColumns({k: F.coalesce(k, c) if k in given.columns else c for k, c in filled.items()})
    return given.select("page", "at", *[(F.col(c) if c in given.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _RECORD])


def schema_events(nodes: DataFrame, run_at: str, at: Column | None = None) -> DataFrame:
    """Events of schema.org ``nodes`` (page, json, node)."""
    j = lambda path: _get(F.col("json"), path)
    rows = nodes.withColumns({"spot": first_of(j("location")), "seller": first_of(j("organizer"))}).withColumn("placed", _is_object(F.col("spot")))
    own = _get(F.col("spot"), "address")
    rows = rows.withColumn("where", F.when(F.col("placed"), F.when(own.isin("", "{}", "[]"), F.col("spot")).otherwise(F.coalesce(own, F.col("spot")))))
    rows = rows.withColumn("sold", _objects(j("offers")))
    low, high, currency, link = offers_parts(F.col("sold"))
    geo = lambda name: json_number(F.when(F.col("placed"), _get(F.col("spot"), f"geo.{name}")))
    texts = {
        "title": j("name"), "description": j("description"), "venue_name": F.when(F.col("placed"), _get(F.col("spot"), "name")).otherwise(F.col("spot")), **_address(F.col("where")),
        "organizer": F.when(_is_object(F.col("seller")), _get(F.col("seller"), "name")).otherwise(F.col("seller")), "said_status": j("eventStatus"),
    }
    rest = {
        **_joined_address(), "sport": classify_sport(F.concat(coerce_list(j("keywords")), F.array("t_title"))), "event_subtypes": F.array_remove(_subtypes(coerce_list(_get(F.col("json"), "@type"))), "Event"),
        "is_online": F.coalesce(F.contains(j("eventAttendanceMode"), F.lit("Online")), F.lit(False)), "latitude": geo("latitude"), "longitude": geo("longitude"), "price_min": low, "price_max": high, "currency": currency, "status": status_name(F.col("t_said_status")),
    }
    links = {"source_url": j("url"), "ticket_url": link, "image_url": first_of(j("image"))}
    return _events(rows, F.col("node") if at is None else at, texts, links, rest, {"start": j("startDate"), "end": j("endDate")}, run_at, F.col("page.url"))


def _hints() -> Column:
    """Texts that tell the sport: of distance, title and description, and of the objects in their lists."""

    def told(name: str) -> Column:
        found = field(name)
        inner = lambda x, group: F.when(inner_field(x, group).kind == "text", inner_field(x, group).text)
        listed = F.flatten(F.transform(found["items"], lambda x: F.when(x.kind == "text", F.array(x.text)).otherwise(F.array(inner(x, "title"), inner(x, "distance")))))
        return F.coalesce(F.when(found.kind == "text", F.array(found.text)).when(found.kind == "list", listed), F.array().cast("array<string>"))

    return F.concat(told("distance"), told("title"), told("description"))


def _distance_texts() -> Column:
    """A scalar, or what a list holds: scalars as they are, of objects the distance and the title."""
    found = field("distance")
    listed = F.flatten(F.transform(found["items"], lambda x: F.when(x.kind == "object", F.array(inner_field(x, "distance").text, inner_field(x, "title").text)).when(x.kind != "none", F.array(x.text)).otherwise(F.array(F.lit(None).cast("string")))))
    return F.when(found.kind.isin("text", "number", "flag"), F.array(found.text)).when(found.kind == "list", listed)


def loose_events(nodes: DataFrame, run_at: str) -> DataFrame:
    """Events of event_nodes(): those of a schema.org type by schema_events(), the others by their field groups. A link is the
    node's, made absolute against the page's, else the page's template with the slug. The first of each link on a page stays,
    up to EVENTS_PER_PAGE. Column ``label`` names the payload's form."""
    at = F.struct("payload", "node", "label")
    prices = F.array(*[json_number(field(k).text) for k in ("price", "price_max")])
    online = field("online")
    rows = nodes.where("not schema").withColumns({"hints": _hints(), "said_distances": _distance_texts()})
    texts = {"title": field("title").text, "slug": scalar("slug"), "description": field("description").text, "venue_name": scalar("venue"), "organizer": scalar("organizer"), **{k: field(k).text for k in ("city", "region", "country", "currency")}}
    rest = {
        "source_url": F.coalesce("l_source_url", _template_link()), "sport": classify_sport(F.col("hints")), "latitude": json_number(field("latitude").text), "longitude": json_number(field("longitude").text),
        "is_online": online.isNotNull() & ~(online.kind.isin("flag", "number") & online.text.isin("false", "0", "0.0")), "price_min": F.array_min(prices), "price_max": F.array_max(prices),
    }
    loose = _events(rows, at, texts, {"source_url": scalar("url"), "image_url": scalar("image")}, rest, {"start": scalar("start"), "end": scalar("end")}, run_at, F.col("page.url"), NAME_LIMITS, F.col("said_distances"))
    both = loose.unionByName(schema_events(nodes.where("schema"), run_at, at))
    once = first_per_key(both, ["page.page_id", "source_url"], [F.col("at")])
    return first_per_key(once, ["page.page_id"], [F.col("at")], fixed.EVENTS_PER_PAGE).withColumn("label", F.col("at.label"))


def selected_events(rows: DataFrame, run_at: str) -> DataFrame:
    """Events of selected() elements."""
    price = parse_price(F.col("price"))
    rest = {"sport": classify_sport(F.array("distance", "t_title")), "price_min": price, "price_max": price}
    return _events(rows, F.col("place"), {"title": F.col("title"), "venue_name": F.col("venue")}, {"source_url": F.col("url"), "image_url": F.col("image")}, rest, {"start": F.col("date")}, run_at, F.col("page.url"), distances=F.array("distance"))


def race_events(responses: DataFrame, run_at: str) -> DataFrame:
    """Events of a race service's ``responses`` (page, kind, json: races, each with sub-events): the distances, types and fees of
    the sub-events together, the earliest start of any of them."""
    races = responses.select("page", "kind", F.posexplode(F.from_json(_get(F.col("json"), "races"), "array<string>")).alias("place", "outer")).withColumn("race", _get(F.col("outer"), "race"))
    r = lambda path: _get(F.col("race"), path)
    parts = races.withColumn("parts", _objects(r("events")))
    parts = with_date_list(parts, "starts", F.transform("parts", lambda x: _get(x, "start_time")), run_day(run_at))
    parts = parts.withColumns({"types": _subtypes(F.transform("parts", lambda x: _get(x, "event_type"))), "where": F.coalesce(r("address"), F.lit("{}"))})
    parts = parts.withColumn("fees", F.transform(F.flatten(F.transform("parts", lambda x: _objects(_get(x, "registration_periods")))), lambda x: json_number(_get(x, "race_fee"))))
    low = F.array_min("fees")
    rest = {
        **_joined_address(), "sport": classify_sport(F.concat("types", F.array("kind", "t_title"))), "event_subtypes": F.col("types"),
        "price_min": low, "price_max": F.array_max("fees"), "currency": F.when(low.isNotNull(), "USD"),
    }
    texts = {"title": r("name"), "description": r("description"), "venue_name": r("address.street"), **_address(F.col("where"))}
    links = {"source_url": r("url"), "ticket_url": r("external_race_url"), "image_url": r("logo_url")}
    return _events(parts, F.col("place"), texts, links, rest, {"start": F.coalesce(F.array_min("starts"), r("next_date")), "end": r("next_end_date")}, run_at, distances=F.transform("parts", lambda x: _get(x, "distance")))


def detail_events(props: DataFrame, run_at: str) -> DataFrame:
    """Events of detail pages (page, props: page properties with eventInfo): prices and distances of its categories together."""
    i = lambda path: _get(F.col("props"), f"eventInfo.{path}")
    rows = props.where(_is_object(_get(F.col("props"), "eventInfo"))).withColumns({"kinds": _objects(i("categories")), "about": first_of(i("aboutRace")), "where": F.coalesce(i("location"), F.lit("{}"))})
    each = lambda path: F.transform("kinds", lambda x: _get(x, path))
    rows = rows.withColumn("prices", F.transform(each("price.value"), json_number))
    texts = {"title": i("title"), "slug": i("slug"), "description": F.when(_is_object(F.col("about")), _get(F.col("about"), "content")).otherwise(F.col("about")), "venue_name": i("location.area"), **_address(F.col("where"))}
    rest = {
        **_joined_address(), "source_url": F.coalesce(_template_link(), F.col("l_page")), "sport": classify_sport(F.concat(each("sportName"), F.array("t_title"))), "event_subtypes": _subtypes(_clean_list(each("title"))),
        "latitude": json_number(i("location.latitude")), "longitude": json_number(i("location.longitude")), "price_min": F.array_min("prices"), "price_max": F.array_max("prices"), "currency": F.get(_clean_list(each("price.currency")), 0),
    }
    return _events(rows, F.lit(0), texts, {"page": F.col("page.url"), "image_url": first_of(i("bannerImageUrl"))}, rest, {"start": i("eventDate"), "end": i("endDate")}, run_at, distances=each("distance.distance"))


def listing_events(props: DataFrame, run_at: str) -> DataFrame:
    """Events of listing pages (page, props: page properties with eventsData, a list or an object with one); without a title the slug's words stand in."""
    data = _get(F.col("props"), "eventsData")
    items = props.select("page", F.posexplode(F.from_json(F.when(_is_object(data), _get(data, "events")).otherwise(data), "array<string>")).alias("place", "item")).where(_is_object(F.col("item")))
    i = lambda path: _get(F.col("item"), path)
    rows = items.withColumns({"kinds": F.transform(_objects(i("categories")), lambda x: _get(x, "category")), "dated": _is_object(i("eventDate")), "price": json_number(i("price")), "where": F.coalesce(i("locationInfo"), F.lit("{}"))})
    texts = {"named": F.coalesce(blank_to_null(i("title")), i("name")), "slug": i("slug"), "venue_name": i("locationInfo.area"), **_address(F.col("where")), "currency": i("currency"), "organizer": i("orgName")}
    title = F.coalesce("t_named", slug_words(F.col("t_slug")))
    rest = {**_joined_address(), "title": title, "source_url": _template_link(), "sport": classify_sport(F.concat(coerce_list(i("sportsType")), F.array(title))), "event_subtypes": _subtypes(F.col("kinds")), "price_min": F.col("price"), "price_max": F.col("price")}
    dates = {"start": F.when(F.col("dated"), i("eventDate.start")).otherwise(i("eventDate")), "end": F.when(F.col("dated"), i("eventDate.end"))}
    return _events(rows, F.col("place"), texts, {"image_url": first_of(i("imageUrls"))}, rest, dates, run_at, distances=F.col("kinds"))


def post_events(responses: DataFrame, run_at: str) -> DataFrame:
    """Events of a blog service's ``responses`` (page, json: a list of posts): undated, their city in the branded title."""
    items = responses.select("page", F.posexplode(F.from_json("json", "array<string>")).alias("place", "post"))
    city = brand_city(F.col("t_title"))
    rest = {"date_status": F.lit("unavailable_phase1"), "sport": F.lit("hyrox"), "event_subtypes": F.array(F.lit("hyrox")), "city": city, "address": city}
    return _events(items, F.col("place"), {"title": _get(F.col("post"), "title.rendered")}, {"source_url": _get(F.col("post"), "link")}, rest, {}, run_at)
