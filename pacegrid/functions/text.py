"""Text functions on columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Entities that the JVM-side variant knows; & comes last. Fixed values.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All HTML entities; rows that are null cost nothing."""
    return text.map(html.unescape, na_action="ignore")


def bind(value: Column, work) -> Column:
    """work(value) with ``value`` worked out once, however often ``work`` names it. ``work`` may hold no Arrow function."""
    return F.get(F.transform(F.array(value), work), 0)


def blank_to_null(c: Column) -> Column:
    """Empty text as null. ``c`` is worked out once, in lambdas too, where nullif would do so twice."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), 0)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends, empty as null."""
    return blank_to_null(F.trim(F.regexp_replace(c, SPACE, " ")))


def strip_tags(c: Column) -> Column:
    """Tags as spaces."""
    return F.regexp_replace(c, r"<[^>]+>", " ")


def shorten(c: Column, limit: int | None) -> Column:
    """Text above ``limit`` characters, cut one before it and marked with dots."""
    if limit is None:
        return c
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)\s+$", ""), F.lit("..."))).otherwise(c)


def clean_text(c: Column, limit: int | None = None, full_entities: bool = True) -> Column:
    """Tags off, entities decoded after that, white space collapsed, empty as null.

    ``full_entities=False`` stays in the JVM and knows COMMON_ENTITIES only; otherwise texts with an
    ampersand, and no others, go through an Arrow function.
    """
    bare = strip_tags(c)
    if full_entities:
        bare = F.coalesce(unescape_html(F.when(F.contains(bare, F.lit("&")), bare)), bare)
    else:
        for entity, char in COMMON_ENTITIES:
            bare = F.replace(bare, F.lit(entity), F.lit(char))
    return shorten(collapse(bare), limit)


def list_or_empty(wanted: Column, texts: Column) -> Column:
    """An array of texts for an Arrow function where it is ``wanted``, else an empty one: nulls in a row of lists are walked again
    for each row that Spark adds to a batch."""
    return F.when(wanted, texts).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda own: [html.unescape(x) if x and "&" in x else x for x in own], na_action="ignore")


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet ``condition``, tested where its columns have been worked out. The optimizer would copy the condition below the
    steps that make these columns, with all their expressions and Arrow functions; the task number in between keeps it here."""
    return df.withColumn("_here", F.spark_partition_id()).where(condition & (F.col("_here") >= 0)).drop("_here")


def held(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out here, once, as settled() does: where Arrow functions follow, the optimizer would copy steps that
    are named several times into each place that names them."""
    return settled(df, F.lit(True))


def with_clean(df: DataFrame, columns: dict[str, Column], limits: dict[str, int] | None = None) -> DataFrame:
    """``df`` with clean_text() of each of ``columns`` under its name. All texts of a row go through one Arrow function together, and
    only rows with an ampersand do; each step stands once in the plan."""
    df = df.withColumn("_bare", F.array(*[strip_tags(c.cast("string")) for c in columns.values()]))
    df = df.withColumn("_marked", F.exists("_bare", lambda x: F.contains(x, F.lit("&"))))
    df = df.withColumn("_read", F.when(F.col("_marked"), _unescape_all(list_or_empty(F.col("_marked"), F.col("_bare")))).otherwise(F.col("_bare")))
    df = held(df.withColumns({name: collapse(F.get("_read", k)) for k, name in enumerate(columns)}).drop("_bare", "_marked", "_read"))
    return df.withColumns({name: shorten(F.col(name), limit) for name, limit in (limits or {}).items()})


def title_key(title: Column) -> Column:
    """Title without years, editions, case and punctuation; empty where nothing is left. Only ASCII digits count,
    which spares the pattern the slow Unicode classes."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\b(?:20\d{2}|(?:\d{1,2}(?:st|nd|rd|th)[\s\x{a0}]+)?edition)\b", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", " "))


def slug_words(slug: Column) -> Column:
    """Slug with spaces for ``_`` and ``-``."""
    return F.translate(slug, "_-", "  ")


def repair_json(c: Column) -> Column:
    """JSON text without trailing commas."""
    return F.regexp_replace(c, r",(?U)\s*([}\]])", "$1")


def coerce_list(json: Column) -> Column:
    """JSON array or scalar as an array of JSON texts (strings bare), nulls left out; null gives an empty array."""
    listed = bind(json, lambda j: F.when(F.ltrim(j).startswith("["), F.from_json(j, "array<string>")).otherwise(F.array(j)))
    return F.coalesce(F.filter(listed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def json_at(json: Column, path: str) -> Column:
    """get_json_object() of ``path``, a row of keys with dots between. Only texts that name the last key, or escape something, are
    parsed: most keys of a list of alternatives are in none."""
    key = F.lit(path.rpartition(".")[2])
    return bind(json, lambda j: F.when(F.contains(j, key) | F.contains(j, F.lit("\\")), F.get_json_object(j, f"$.{path}")))


def first_of(json: Column) -> Column:
    """First element of a JSON array, or the scalar itself."""
    return F.get(coerce_list(json), 0)
