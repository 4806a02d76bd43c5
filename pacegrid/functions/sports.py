"""Sport classification on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacegrid.functions import fixed
from pacegrid.functions.text import bind, strip


def classify_sport(hints: Column) -> Column:
    """Sport of an array of hints: the first exact token of any hint, else the first pattern that the
    joined hints match, else ``other``. Null and empty hints count as absent."""
    values = F.filter(hints, lambda x: x.isNotNull() & (x != ""))
    tokens = F.create_map(*[F.lit(x) for kv in fixed.SPORT_BY_TOKEN.items() for x in kv])

    def cascade(joined: Column) -> Column:
        found = F.lit("other")
        for pattern, sport in reversed(fixed.SPORT_PATTERNS):
            found = F.when(F.regexp_like(joined, F.lit(f"(?iU){pattern}")), sport).otherwise(found)
        return found

    exact = lambda own: F.get(F.filter(F.transform(own, lambda x: tokens[F.lower(strip(x))]), lambda x: x.isNotNull()), 0)
    return bind(values, lambda own: F.coalesce(exact(own), bind(F.coalesce(F.array_join(own, " "), F.lit("")), cascade)))
