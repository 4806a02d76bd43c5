"""Dates, money, distances, countries, addresses and identities on columns."""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pacegrid.functions import fixed
from pacegrid.functions.text import bind, blank_to_null, clean_text, coerce_list, held, json_at, list_or_empty
from pacegrid.functions.urls import absolute_url

NUMBER = r"-?\d+(?:\.\d+)?"


def stable_id(source: Column, url: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of source|url."""
    return F.substring(F.sha1(F.concat(source, F.lit("|"), url).cast("binary")), 1, 16)


def parse_price(c: Column) -> Column:
    """First number of a text, thousands commas ignored; null without one, which is not left to the cast: that makes an exception of it."""
    return blank_to_null(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), NUMBER, 0)).try_cast("double")


def json_number(json: Column) -> Column:
    """Number of a JSON scalar: numbers as they are, booleans null, strings by parse_price."""
    plain = lambda j: F.regexp_like(j, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    return bind(json, lambda j: F.when(j.isin("true", "false"), F.lit(None).cast("double")).when(plain(j), j.try_cast("double")).otherwise(parse_price(j)))


def price_range(values: Column) -> tuple[Column, Column]:
    """Least and largest of an array of numbers, nulls ignored."""
    return F.array_min(values), F.array_max(values)


def _objects(json: Column) -> Column:
    """Objects of a JSON list, or the one there is."""
    return F.filter(coerce_list(json), lambda x: F.ltrim(x).startswith("{"))


def offers_parts(each: Column) -> tuple[Column, Column, Column, Column]:
    """price_min, price_max, currency and link of an array of JSON offers: least and largest of all prices,
    the first currency, and the first link, as it is, that is no mail address or the like."""
    prices = F.flatten(F.transform(each, lambda o: F.array(*[json_number(json_at(o, k)) for k in fixed.OFFER_PRICE_KEYS])))
    said = lambda key: F.filter(F.transform(each, lambda o: clean_text(json_at(o, key), full_entities=False)), lambda x: x.isNotNull())
    link = F.get(F.filter(said("url"), lambda x: ~F.regexp_like(x, F.lit(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"))), 0)
    return F.array_min(prices), F.array_max(prices), F.get(said("priceCurrency"), 0), link


def with_offers(df: DataFrame, offers: Column, base: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with offers_fold() of a JSON offer or list of offers (price_min, price_max, currency, link, under the given ``names``),
    common entities only, in steps that each stand once in the plan."""
    df = df.withColumn("_offers", _objects(offers))
    df = df.withColumns(dict(zip(("_low", "_high", "_currency", "_link"), offers_parts(F.col("_offers")), strict=True)))
    df = df.withColumn("_link", absolute_url(F.col("_link"), base, False))
    made = {"price_min": "_low", "price_max": "_high", "currency": "_currency", "link": "_link"}
    return df.withColumns({name: F.col(made[k]) for k, name in names.items()}).drop("_offers", *made.values())


def offers_fold(offers: Column, base: Column | None = None, full_entities: bool = True) -> tuple[Column, Column, Column, Column]:
    """offers_parts() of a JSON offer or list of offers, with the link made absolute against ``base``."""
    low, high, currency, link = offers_parts(_objects(offers))
    return low, high, currency, absolute_url(link, base, full_entities)


def _fallback(run_date: date, day_first: bool):
    @F.pandas_udf(StringType())
    def parse(texts: pd.Series) -> pd.Series:
        from dateutil import parser

        default = datetime(run_date.year, run_date.month, run_date.day)

        def one(text: str) -> str | None:
            try:
                return parser.parse(text, dayfirst=day_first, default=default).isoformat()
            except (ValueError, OverflowError, TypeError):
                return None

        return texts.map(one, na_action="ignore")

    return parse


#: Forms that are read in the JVM: ISO-8601 without fractions of seconds, and month or day first; no year 0, no distance from UTC that isn't one.
_ISO = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:Z|(?!-00:?00)[+-](?:[01]\d|2[0-3]):?[0-5]\d)?)?$"
_SLASHED = r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}(?: (?:[01]\d|2[0-3]):[0-5]\d)?$"


def parse_iso(text: Column, once=lambda value, work: work(value)) -> Column:
    """ISO-8601 and month-first dates in ISO form (day first where the month can't be one); null for other texts and for
    fractions of seconds. Stays in the JVM. ``once`` may be bind() where no Arrow function makes ``text``."""
    iso = text
    for pattern, into in ((r"^(.{10})$", "$1T00:00:00"), (r"^(.{10}) ", "$1T"), (r"^(.{16})(?!:)", "$1:00"), ("Z$", "+00:00"), (r"([+-]\d{2})(\d{2})$", "$1:$2")):
        iso = F.regexp_replace(iso, pattern, into)

    def slashed(pieces: Column) -> Column:
        one, two, late = (F.get(pieces, k) for k in range(3))
        swapped = one.try_cast("int") > 12
        day = F.concat_ws("-", F.substring(late, 1, 4), F.lpad(F.when(swapped, two).otherwise(one), 2, "0"), F.lpad(F.when(swapped, one).otherwise(two), 2, "0"))
        at = F.when(F.length(late) > 4, F.substring(late, 6, 5)).otherwise("00:00")
        return once(day, lambda d: F.when(d.try_cast("date").isNotNull(), F.concat(d, F.lit("T"), at, F.lit(":00"))))

    fits = F.regexp_like(text, F.lit(_ISO)) & F.substring(text, 1, 10).try_cast("date").isNotNull()
    return F.when(fits, iso).when(F.regexp_like(text, F.lit(_SLASHED)), once(F.split(text, "/"), slashed))


def _date_text(c: Column, full_entities: bool) -> Column:
    return bind(clean_text(c, full_entities=full_entities), lambda x: F.when(~F.lower(x).isin("null", "none", "tbd", "tba"), x))


def parse_date(c: Column, run_date: date, day_first: bool = False, full_entities: bool = True) -> Column:
    """Date text in ISO form; null for empty, ``null``, ``none``, ``tbd``, ``tba`` and what can't be read.

    Common forms are read in the JVM; the rest goes to dateutil, where parts that the text lacks are
    taken from ``run_date``. with_dates() does the same with each step worked out once.
    """
    text = _date_text(c, full_entities)
    fast = F.lit(None).cast("string") if day_first else parse_iso(text)
    return F.coalesce(fast, _fallback(run_date, day_first)(F.when(fast.isNull(), text)))


def with_dates(df: DataFrame, columns: dict[str, Column], run_date: date, full_entities: bool = True) -> DataFrame:
    """``df`` with parse_date() of each of ``columns`` under its name, in steps that each stand once in the plan."""
    names = list(columns)
    df = df.withColumns({f"_told_{k}": c for k, c in columns.items()})
    df = held(held(df).withColumns({f"_said_{k}": _date_text(F.col(f"_told_{k}"), full_entities) for k in names}))
    df = held(df.withColumns({f"_fast_{k}": parse_iso(F.col(f"_said_{k}"), bind) for k in names}))
    slow = _fallback(run_date, False)
    df = df.withColumns({k: F.coalesce(f"_fast_{k}", slow(F.when(F.col(f"_fast_{k}").isNull(), F.col(f"_said_{k}")))) for k in names})
    return df.drop(*[f"_{step}_{k}" for k in names for step in ("told", "said", "fast")])


def _fallback_list(run_date: date):
    @F.pandas_udf("array<string>")
    def read(lists: pd.Series) -> pd.Series:
        from dateutil import parser

        default = datetime(run_date.year, run_date.month, run_date.day)

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else parser.parse(text, default=default).isoformat()
            except (ValueError, OverflowError, TypeError):
                return None

        return lists.map(lambda own: [one(x) for x in own])

    return read


def with_date_list(df: DataFrame, name: str, texts: Column, run_date: date) -> DataFrame:
    """``df`` with parse_date() of each text of an array under ``name``, unread ones left out, common entities only, in steps that each
    stand once in the plan. Only lists with a text that is none of the common forms are read by an Arrow function."""
    df = df.withColumn("_said", F.filter(F.transform(texts, lambda x: _date_text(x, False)), lambda x: x.isNotNull()))
    df = df.withColumn("_fast", F.transform("_said", lambda x: parse_iso(x, bind)))
    df = df.withColumn("_odd", list_or_empty(F.exists("_fast", lambda x: x.isNull()), F.transform("_said", lambda x, k: F.when(F.get("_fast", k).isNull(), x))))
    df = df.withColumn("_slow", _fallback_list(run_date)(F.col("_odd")))
    read = F.transform("_fast", lambda x, k: F.coalesce(x, F.get("_slow", k)))
    return df.withColumn(name, F.filter(read, lambda x: x.isNotNull())).drop("_said", "_fast", "_odd", "_slow")


def distance_label(km: Column) -> Column:
    """Name of a distance in kilometres."""
    label = F.when(km.isNull(), F.lit(None).cast("string"))
    for centre, tolerance, name in fixed.DISTANCE_LABELS:
        label = label.when(F.abs(km - F.lit(float(centre))) <= F.lit(float(tolerance)), name)
    whole = F.rint(km)
    return label.when(F.abs(km - whole) < 0.05, F.concat(whole.cast("long").cast("string"), F.lit("K"))).otherwise(F.format_string("%.1fK", km))


def _known_km(key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in fixed.DISTANCE_ALIASES.items() for x in kv])[key]


def _measured_km(key: Column, number: Column) -> Column:
    miles = (F.abs(number - 70.3) < 0.01) | (F.abs(number - 140.6) < 0.01) | F.contains(key, F.lit("mile")) | F.regexp_like(key, F.lit(r"(?U)\bmi\b"))
    metres = F.contains(key, F.lit("meter")) | F.contains(key, F.lit("metre")) | (F.regexp_like(key, F.lit(r"(?U)\d\s*m\b")) & (number >= 400))
    return F.when(miles, number * fixed.MILE_KM).when(metres, number / 1000.0).otherwise(number)


def _distance(text: Column) -> Column:
    """label and km of parse_distance(), each step worked out once."""
    read = bind(F.lower(F.trim(text)), lambda key: F.struct(key.alias("key"), parse_price(key).alias("number"), _known_km(key).alias("known")))
    km = bind(read, lambda x: F.struct(x.known.alias("known"), F.round(F.coalesce(x.known, _measured_km(x.key, x.number)), 3).alias("km")))
    return bind(km, lambda x: F.struct(F.coalesce(bind(F.coalesce(x.known, x.km), distance_label), text).alias("label"), x.km.alias("km")))


def parse_distance(text: Column) -> tuple[Column, Column]:
    """Label and kilometres of a cleaned distance text; a text without a number is its own label."""
    return _distance(text).label, _distance(text).km


def with_distance(df: DataFrame, text: Column, label: str, km: str) -> DataFrame:
    """``df`` with parse_distance() of a cleaned text, in steps that each stand once in the plan."""
    df = df.withColumn("_key", F.lower(F.trim(text))).withColumns({"_known": _known_km(F.col("_key")), "_number": parse_price(F.col("_key"))})
    df = df.withColumn(km, F.round(F.coalesce("_known", _measured_km(F.col("_key"), F.col("_number"))), 3))
    return df.withColumn(label, F.coalesce(distance_label(F.coalesce("_known", km)), text)).drop("_key", "_known", "_number")


def distance_pairs(texts: Column) -> Column:
    """label and km of each of an array of cleaned texts."""
    return F.transform(texts, _distance)


def parse_distances(pairs: Column) -> tuple[Column, Column]:
    """Distinct labels in order, and distinct kilometres ascending, of distance_pairs()."""
    present = lambda field: F.filter(F.transform(pairs, lambda p: p[field]), lambda x: x.isNotNull())
    return F.array_distinct(present("label")), F.array_sort(F.array_distinct(present("km")))


def country_code(text: Column) -> Column:
    """Two-letter code of a cleaned country name; two letters in upper case, others as they are."""
    known = F.create_map(*[F.lit(x) for kv in fixed.COUNTRY_CODES.items() for x in kv])[F.regexp_replace(F.lower(text), r"^[. ]+|[. ]+$", "")]
    return F.coalesce(known, F.when(F.regexp_like(text, F.lit(r"(?U)^\p{L}{2}$")), F.upper(text)).otherwise(text))


def distinct_parts(*parts: Column) -> Column:
    """Parts joined by comma, nulls and later repeats (in any case) left out; null without parts."""
    kept = lambda listed: F.filter(listed, lambda x, i: ~F.exists(F.slice(listed, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return blank_to_null(F.array_join(bind(F.filter(F.array(*parts), lambda x: x.isNotNull()), kept), ", "))


def address_parts(json: Column) -> dict[str, Column]:
    """street, city, region, postal and country of a JSON address object, uncleaned: of each, the first key with more than blanks."""

    def pick(keys: tuple[str, ...]) -> Column:
        named = lambda v: F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$.name")).otherwise(v)
        told = lambda x: F.when(F.regexp_like(x, F.lit(r"(?U)\S")), x)
        return F.coalesce(*[bind(bind(json_at(json, key), named), told) for key in keys])

    return {part: pick(keys) for part, keys in fixed.ADDRESS_KEYS.items()}


def flatten_address(json: Column, full_entities: bool = True) -> tuple[Column, Column, Column, Column]:
    """address, city, region and country of a JSON address: an object's parts, or a text as it is."""
    is_object = F.ltrim(json).startswith("{")
    parts = {k: clean_text(F.when(is_object, v), full_entities=full_entities) for k, v in address_parts(json).items()}
    joined = distinct_parts(parts["street"], parts["city"], parts["region"], parts["postal"], parts["country"])
    return F.when(is_object, joined).otherwise(clean_text(json, full_entities=full_entities)), parts["city"], parts["region"], parts["country"]


def with_address(df: DataFrame, json: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with flatten_address() of a JSON address (address, city, region, country, under the given ``names``), common entities
    only, in steps that each stand once in the plan."""
    df = df.withColumn("_json", json).withColumn("_object", F.ltrim("_json").startswith("{"))
    df = df.withColumn("_said", F.array(*[F.when(F.col("_object"), v) for v in address_parts(F.col("_json")).values()], F.when(~F.col("_object"), F.col("_json"))))
    df = df.withColumn("_read", F.transform("_said", lambda x: clean_text(x, full_entities=False)))
    street, city, region, postal, country, plain = (F.get("_read", k) for k in range(6))
    made = {"address": F.when(F.col("_object"), distinct_parts(street, city, region, postal, country)).otherwise(plain), "city": city, "region": region, "country": country}
    return df.withColumns({name: made[k] for k, name in names.items()}).drop("_json", "_object", "_said", "_read")


def status_name(status: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(status, "/"), -1)
