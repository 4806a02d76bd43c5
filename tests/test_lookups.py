import itertools

import pyarrow as pa
import pytest

from pacegrid.operators import geocode
from pacegrid.streaming import lookups


def keys(*names):
    return pa.RecordBatch.from_pylist([{"key": n, "query": n, "country": ""} for n in names])


def test_rest_of_a_failing_service():
    """After three failures in a row keys are passed over for sixty seconds of a clock that only sleeping moves."""
    now = [1000.0]
    calls = []

    def find(name, _):
        calls.append((name, now[0]))
        if name.startswith("x"):
            raise OSError
        return 1.0, 2.0, 5.0, "city"

    def sleep(seconds):
        now[0] += seconds

    def clock():
        now[0] += 5  # a key that is passed over takes time, too
        return now[0]

    names = ["a", "x1", "x2", "b", "x3", "x4", "x5", *[f"c{k}" for k in range(12)], "x6"]
    rows = [r for batch in geocode.asked(iter([keys(*names[:6]), keys(*names[6:])]), find, 1.0, 60.0, clock=clock, sleep=sleep) for r in batch.to_pylist()]
    states = [r["state"] for r in rows]
    assert states[:7] == ["answered", "failed", "failed", "answered", "failed", "failed", "failed"]
    passed = list(itertools.takewhile("passed".__eq__, states[7:]))
    assert 0 < len(passed) < 12 and states[7 + len(passed)] == "answered" and states[-1] == "failed"
    again = dict(calls)[names[7 + len(passed)]]
    assert 60 < again - rows[6]["asked_at"] < 75
    assert [r["turn"] for r in rows] == list(range(len(names)))
    resting = [r["state"] for batch in geocode.asked(iter([keys("a", "b")]), find, 1.0, 60.0, geocode.Breaker(3, now[0]), clock, sleep) for r in batch.to_pylist()]
    assert resting == ["passed", "passed"]


def test_restarts(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.write_text("")

    def find(name, _, log=str(log)):
        with open(log, "a") as f:
            f.write(f"{name}\n")
        if name == "bad":
            raise OSError
        return (1.0, 2.0, 9000.0, "country") if name == "wide" else (1.0, 2.0, None, "town")

    arrived, table, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema("key string, query string, country string").option("maxFilesPerTrigger", 1).json(arrived)
    run = lambda: lookups.look_up(stream(), table, state, find, 0, 0).awaitTermination()
    arrive = lambda *names: spark.createDataFrame([(n, n, "") for n in names], "key string, query string, country string").coalesce(1).write.mode("append").json(arrived)
    asked = lambda: sorted(log.read_text().split())
    assert not lookups.states(spark, table).count() and lookups.breaker(spark, table) == (0, 0.0)
    arrive("a", "bad", "a", "wide", None)
    run()
    assert asked() == ["a", "bad", "wide"] and lookups.breaker(spark, table)[0] == 0  # wide was asked after bad
    real = geocode.attempts

    def dies(*args):
        real(*args).collect()
        raise RuntimeError("killed")

    monkeypatch.setattr(geocode, "attempts", dies)
    arrive("a", "b", "wide")
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(geocode, "attempts", real)
    run()
    run()
    assert asked() == ["a", "b", "b", "bad", "bad", "bad", "wide"]  # only the open batch was asked again
    assert {r["key"]: (r["state"], r["failures"]) for r in lookups.states(spark, table).collect()} == {"a": ("answered", 0), "b": ("answered", 0), "wide": ("answered", 0), "bad": ("open", 2)}
    assert lookups.breaker(spark, table)[0] == 1
    assert {r["key"]: (r["found"], r["latitude"]) for r in lookups.places(spark, table).collect()} == {"a": (True, 1.0), "b": (True, 1.0), "wide": (False, None)}
    for _ in range(5):
        arrive("a")
        run()
    assert asked().count("bad") == 3 + 4 and asked().count("a") == 1
    assert {r["state"] for r in lookups.states(spark, table).where("key = 'bad'").collect()} == {"failed"}
