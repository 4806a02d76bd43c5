import random

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import relational, search


def walk(rows):
    ids, keys, kept = set(), set(), []
    for seq, row_id, key in rows:
        if row_id in ids or (key and key in keys):
            continue
        ids.add(row_id)
        keys |= {key} if key else set()
        kept.append(seq)
    return kept


@pytest.mark.parametrize("rows", [[], [(0, "a", "x"), (1, "b", "x"), (2, "b", "y")], [(i, random.Random(i).choice("abcdefgh"), random.Random(i + 99).choice(["x", "y", "z", "", None])) for i in range(60)]])
def test_dual_key_dedupe(spark, rows):
    df = spark.createDataFrame(rows, "seq long, id string, key string")
    assert sorted(r["seq"] for r in relational.dual_key_dedupe(df, "id", "key", "seq").collect()) == walk(rows)


def test_finished_rows(spark):
    rows = [("2026-05-01T10:00", None), ("2026-05-01", "2026-05-09"), (None, None), ("", "2026-05-01")]
    df = spark.createDataFrame(rows, "start string, end string")
    assert [r[0] for r in df.select(relational.finished_before(F.col("start"), F.col("end"), "2026-05-05")).collect()] == [True, False, False, True]


def test_carry_forward_keeps_null_sources(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, k int")
    new = spark.createDataFrame([("a", 4)], "source string, k int")
    assert sorted((r["k"], r["carried"]) for r in relational.carry_forward(old, new, ["a"]).collect()) == [(2, True), (3, True), (4, False)]


def test_search(spark):
    schema = "title string, city string, venue_name string, region string, country string, distances array<string>, start string, sport string, source string, latitude double, longitude double"
    rows = [("City Run", "Pune", None, None, "IN", ["10K"], "2026-05-01", "running", "s", 18.5, 73.9), ("Far Swim", "Oslo", None, None, "NO", None, None, "swimming", "s", 59.9, 10.7), ("Nowhere", None, None, None, None, [], "", "running", "s", None, None)]
    df = spark.createDataFrame(rows, schema)
    titles = lambda **x: [r["title"] for r in search.search(df, **x).collect()]
    assert titles() == ["City Run", "Far Swim", "Nowhere"]
    assert titles(term="10k") == ["City Run"]
    assert titles(dated=True) == ["City Run"]
    assert titles(sport="running", origin=(18.0, 73.0)) == ["City Run", "Nowhere"]
    assert titles(origin=(18.0, 73.0), radius_km=500) == ["City Run"]


def chain(n):
    """Conflicts of each row with the next, by id or by key."""
    return [(k, f"i{k // 2}", f"k{(k + 1) // 2}") for k in range(n)]


def tables_for(spark, rows, monkeypatch):
    """Kept rows, and how many tables the dedupe wrote for them."""
    made, write = [], relational.written
    monkeypatch.setattr(relational, "written", lambda df: made.append(1) or write(df))
    df = spark.createDataFrame(rows, "seq long, id string, key string")
    found = sorted(r["seq"] for r in relational.dual_key_dedupe(df, "id", "key", "seq").collect())
    monkeypatch.setattr(relational, "written", write)
    return found, len(made)


def test_long_chains_end_soon(spark, monkeypatch):
    """A chain of conflicts above GROUP_ROWS: four times the rows take a few tables more, not four times as many."""
    monkeypatch.setattr(relational, "GROUP_ROWS", 20)
    short, long = tables_for(spark, chain(500), monkeypatch), tables_for(spark, chain(2000), monkeypatch)
    assert (short[0], long[0]) == (walk(chain(500)), walk(chain(2000)))
    assert long[1] <= short[1] + 6


def test_conflict_groups_walked(spark, monkeypatch):
    """Many groups, hot ids and keys, null ids and null and empty keys, with and without rounds before."""
    draw = random.Random(5)
    rows = [(k, draw.choice(["hot", None, *"abcdefghijkl"]) if draw.random() < 0.5 else f"i{draw.randrange(150)}", draw.choice(["", None, "hot"]) if draw.random() < 0.4 else f"k{draw.randrange(150)}") for k in range(600)]
    monkeypatch.setattr(relational, "GROUP_ROWS", 0)
    for rounds in (0, 1):
        monkeypatch.setattr(relational, "PARALLEL_ROUNDS", rounds)
        df = spark.createDataFrame(rows, "seq long, id string, key string")
        assert sorted(r["seq"] for r in relational.dual_key_dedupe(df, "id", "key", "seq").collect()) == walk(rows)


def test_copies_and_hot_keys_need_no_groups(spark, monkeypatch):
    """Copies of the same ids and keys, and copies with ids of their own that want the same keys, are settled above GROUP_ROWS without conflict groups."""
    draw = random.Random(7)
    one = [(draw.randrange(40), draw.choice([None, *range(1, 61)])) for _ in range(300)]
    copies = [(n, f"i{i}", k and f"k{k}") for n, (i, k) in enumerate(one * 20)]
    apart = [(n, f"i{n // 300}-{i}", k and f"k{k}") for n, (i, k) in enumerate(one * 20)]
    daily = [(n, f"i{n % 20}-{draw.randrange(40)}", f"k{n // 600}-{draw.randrange(6)}") for n in range(6000)]
    monkeypatch.setattr(relational, "GROUP_ROWS", 400)
    monkeypatch.setattr(relational, "_walk_groups", lambda undecided: pytest.fail("conflict groups walked"))
    for rows, most in ((copies, 2), (apart, 10), (daily, 60)):
        found, made = tables_for(spark, rows, monkeypatch)
        assert found == walk(rows) and made <= most


def test_first_rows_then_rounds(spark, monkeypatch):
    """Rounds and walks of first rows in turn, null ids and null and empty keys among them, down to the last rows and to groups."""
    draw = random.Random(11)
    rows = [(3 * n, draw.choice([None, "", *"abcdefgh"]) if draw.random() < 0.1 else f"i{draw.randrange(400)}", draw.choice(["", None, "hot"]) if draw.random() < 0.1 else f"k{draw.randrange(400)}") for n in range(1500)]
    for limit, rounds in ((30, 3), (5, 1), (300, 2)):
        monkeypatch.setattr(relational, "GROUP_ROWS", limit)
        monkeypatch.setattr(relational, "PARALLEL_ROUNDS", rounds)
        assert tables_for(spark, rows, monkeypatch)[0] == walk(rows)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["place"] == r["x"] for r in relational.numbered(df, [F.col("x")], "place").collect())
