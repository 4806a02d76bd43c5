"""Links on columns."""

from __future__ import annotations

from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pacegrid.functions.text import bind, clean_text, list_or_empty


@F.pandas_udf(StringType())
def _join(url: pd.Series, base: pd.Series) -> pd.Series:
    def one(u: str | None, b: str | None) -> str | None:
        try:
            found = urljoin(b, u) if b else u
            return found if urlparse(found).scheme else None
        except (ValueError, TypeError):
            return None

    return pd.Series([one(u, b) if u is not None else None for u, b in zip(url, base, strict=True)], dtype=object)


def collapse_slashes(url: Column) -> Column:
    """Runs of slashes in the path as one."""
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$", 1)
    return F.when(F.contains(path, F.lit("//")), F.concat(head, F.regexp_replace(path, "/{2,}", "/"), rest)).otherwise(url)


def absolute_url(url: Column, base: Column | None = None, full_entities: bool = True) -> Column:
    """Absolute http(s) link with single slashes in its path, or null.

    Links that start with a scheme stay in the JVM; relative ones are resolved against ``base`` by an
    Arrow function that sees only those.
    """
    text = clean_text(url, full_entities=full_entities)
    if base is not None:
        has_scheme = F.regexp_like(text, F.lit(r"(?i)^https?://"))
        text = F.when(has_scheme, text).otherwise(_join(F.when(~has_scheme, text), F.when(~has_scheme, base)))
    return bind(text, lambda x: F.when(F.regexp_like(x, F.lit(r"(?i)^https?://[^/?#]+")), collapse_slashes(x)))


@F.pandas_udf(ArrayType(StringType()))
def _join_all(urls: pd.Series, base: pd.Series) -> pd.Series:
    def one(u: str | None, b: str) -> str | None:
        try:
            return None if u is None else urljoin(b, u)
        except ValueError:
            return None

    return pd.Series([None if own is None or b is None else [one(u, b) for u in own] for own, b in zip(urls, base, strict=True)], dtype=object)


def with_links(df: DataFrame, columns: list[str], base: Column | None) -> DataFrame:
    """``df`` with the cleaned links ``columns`` made absolute. Rows with a relative one go through one Arrow function, with all
    their links; relative links without a base become null."""
    df = df.withColumn("_links", F.array(*columns))
    if base is None:
        df = df.withColumn("_whole", F.col("_links"))
    else:
        df = df.withColumn("_relative", F.exists("_links", lambda x: ~F.regexp_like(x, F.lit(r"(?i)^https?://"))))
        joined = _join_all(list_or_empty(F.col("_relative"), F.col("_links")), F.when(F.col("_relative"), base))
        df = df.withColumn("_whole", F.coalesce(F.when(F.col("_relative"), joined), F.col("_links"))).drop("_relative")
    whole = lambda k: F.get("_whole", k)
    return df.withColumns({c: F.when(F.regexp_like(whole(k), F.lit(r"(?i)^https?://[^/?#]+")), collapse_slashes(whole(k))) for k, c in enumerate(columns)}).drop("_links", "_whole")


def fill_template(template: Column, slug: Column) -> Column:
    """``{slug}`` of a link template filled in."""
    return F.replace(template, F.lit("{slug}"), slug)
