import math
import random

import pytest

from pacegrid.operators import nearby


def apart(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), 6)


SPOT = "latitude double, longitude double"


@pytest.fixture(scope="module")
def globe():
    r = random.Random(5)
    spots = [(round(r.uniform(-90, 90), 2), round(r.uniform(-180, 180), 2)) for _ in range(250)]
    spots += [(90.0, 0.0), (-90.0, 77.0), (89.99, -170.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.99), (10.0, -179.99)] + [(48.1, 11.5)] * 130 + [(48.1 + r.uniform(-0.2, 0.2), 11.5 + r.uniform(-0.2, 0.2)) for _ in range(60)]
    return [(k, *s) for k, s in enumerate(spots)], [(f"o{k}", *s) for k, s in enumerate([(90.0, 10.0), (-89.5, 0.0), (0.0, 180.0), (10.0, -180.0), (48.1, 11.5), (60.0, 30.0), (-33.0, 151.0)])]


@pytest.mark.parametrize("radius", [0, 1.5, 300, 4000, 9999, 21000])
def test_within(spark, globe, radius, monkeypatch):
    monkeypatch.setattr(nearby, "PART_ROWS", 40)
    events, origins = globe
    found = nearby.within(spark.createDataFrame([*events, (999, None, 1.0), (998, float("nan"), 1.0), (997, 95.0, 1.0)], f"id long, {SPOT}"), spark.createDataFrame([*origins, ("none", None, None)], f"origin string, {SPOT}"), radius)
    assert sorted((r["origin"], r["id"]) for r in found.collect()) == sorted((o[0], e[0]) for o in origins for e in events if apart(o[1:], e[1:]) <= radius)


@pytest.mark.parametrize("k", [1, 3, 150, 100_000])
def test_nearest(spark, globe, k):
    events, origins = globe
    found = nearby.nearest(spark.createDataFrame(events, f"id long, {SPOT}"), spark.createDataFrame(origins + origins[:1], f"origin string, {SPOT}"), k)
    want = [(o[0], n, e[0]) for o in origins for n, e in enumerate(sorted(events, key=lambda e, o=o: (apart(o[1:], e[1:]), e[0]))[:k], 1)]
    assert sorted((r["origin"], r["place"], r["id"]) for r in found.collect()) == sorted(want)


def test_nothing_there(spark, globe):
    events, origins = spark.createDataFrame(globe[0], f"id long, {SPOT}"), spark.createDataFrame(globe[1], f"origin string, {SPOT}")
    assert not nearby.nearest(events.limit(0), origins, 2).count() and not nearby.nearest(events, origins.limit(0), 2).count() and not nearby.nearest(events, origins, 0).count()
    assert not nearby.within(events, origins, -1).count() and not nearby.within(events.limit(0), origins, 100).count()


def test_around(spark, globe, monkeypatch):
    """Counts of pairs of rows, though only pairs of spots are measured."""
    events, origins = globe
    met, pairs = [], nearby._pairs
    monkeypatch.setattr(nearby, "_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    found = nearby.around(spark.createDataFrame([*events, (0, 48.1, 11.5), (999, None, 1.0)], f"id long, {SPOT}"), spark.createDataFrame([*origins, *origins[4:5], (None, 48.1, 11.5), ("none", None, None), ("far", -50.0, -120.0)], f"origin string, {SPOT}"), 300).collect()
    at = {o[0]: [apart(o[1:], e[1:]) for e in [*events, (0, 48.1, 11.5)] if apart(o[1:], e[1:]) <= 300] for o in [*origins, (None, 48.1, 11.5), ("far", -50.0, -120.0)]}
    want = {o: (len(own) * (2 if o == "o4" else 1), min(own), max(own)) for o, own in at.items() if own}
    assert {r["origin"]: (r["n"], r["least"], r["most"]) for r in found} == want
    assert want["o4"][0] > 2 * 190 and met[0].count() < 190  # one spot has 131 of the rows
