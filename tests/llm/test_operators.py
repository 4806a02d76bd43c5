"""Each operator against brute force on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import chat, decontam, fingerprint, langid, mixing, near_dedup, quality, queries, sharding, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def corpus():
    base = prose(1, 120).split()
    texts = [None, "", " \n\t", "one two", "One  TWO", prose(2, 4000)]
    for k in range(40):  # a group of near copies, two replaced words each
        own = list(base)
        for at in random.Random(k).sample(range(len(own)), k % 3):
            own[at] = f"x{k}"
        texts.append(" ".join(own))
    texts += [prose(7, 80) + " " + prose(100 + k, 60) for k in range(30)]  # a shared passage, but no near copies
    texts += [prose(50, 90)] * 3 + ["été " * 80, prose(50, 90) + " tail"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in corpus()] + [(None, "no id here at all, five words", None, None, 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(rows, numerator):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


@pytest.mark.parametrize("bits", [18, 1])
def test_near_duplicates(docs, monkeypatch, bits):
    """Also where the counters tell next to nothing of how common a shingle is."""
    monkeypatch.setattr(near_dedup, "COUNTER_BITS", bits)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs.withColumn("node", F.lit(1)), 85, 100).collect()}
    assert found.pop(None) == (3, None, True)
    assert found == brute_components(corpus(), 85)


def test_stars_linked_by_members_only(spark, monkeypatch):
    """One bucket of four texts in a row, each within the threshold of the next; the two ends are its first centres."""
    monkeypatch.setattr(near_dedup, "BAND", 0)
    for seed in range(1000):
        line = [f"v{seed}x{k}" for k in range(130)]
        texts = [" ".join(line[at : at + 100]) for at in (0, 10, 20, 30)]
        nodes = [near_dedup._node(near_dedup.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for t in texts]
        if max(nodes[1:3]) < min(nodes[0], nodes[3]):
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs, 80, 100).collect()} == {0}


@pytest.mark.parametrize("numerator", [80, 85])
def test_exact_pairs(spark, numerator):
    """All pairs within the threshold, and no more than meet, in one bucket of sets of many sizes around a common text."""
    draw = np.random.default_rng(numerator)
    base = draw.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = []
    for k in range(150):
        own = np.concatenate([draw.permutation(base)[: 60 - k % 14], draw.integers(1, 1 << 62, k % 9, dtype=np.uint64)])
        sets.append(np.sort(own))
    rows = [(k, k if k % 10 else 0, x.tobytes()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, comp long, elements binary")
    found = {tuple(sorted((r["a"], r["b"]))) for r in near_dedup._exact_pairs(df, numerator, 100).collect()}
    within = set()
    for a in range(150):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if rows[a][1] != rows[b][1] and 100 * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
                within.add((b, a))
    assert within and found >= within


def test_near_duplicates_with_equal_ids(spark):
    """Rows that share a null id are linked by their texts alone, each pair of texts once."""
    say = lambda k: " ".join(f"n{k}w{i}" for i in range(60))
    texts = [say(k % 20) + (" end" if k >= 20 else "") for k in range(40)] + [say(0)] * 5
    docs = spark.createDataFrame([(None, x) for x in texts], "doc_id long, text string")
    linked, _ = near_dedup._grouped(docs.withColumn("same", F.col("text")), 80, 100)
    rows = linked.collect()
    assert len(rows) == 45
    assert len({r["comp"] for r in rows}) == 20
    assert {r["same"].split()[0] for r in rows if r["comp"] == rows[0]["comp"]} == {rows[0]["same"].split()[0]}


def test_near_duplicates_of_nothing(empty):
    assert not near_dedup.near_duplicates(empty).collect()


def brute_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for b in data:
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append((len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_repeated_spans(docs, empty):
    rows = [(i, t) for i, t in corpus()] + [(None, "no id here at all, five words")]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.repeated_spans(docs.withColumn("chunk", F.lit(0))).collect()}
    assert found == dict(zip([i for i, _ in rows], brute_repeats([t for _, t in rows], 200), strict=True))
    assert any(x[1] for x in found.values())
    assert not suffix_dedup.repeated_spans(empty).collect()


def test_shards(docs, empty):
    limit = 3000
    twice = docs.union(docs.where("doc_id in (3, 50)")).withColumn("shard_page", F.lit("mine"))
    rows = sharding.shard(twice, limit).collect()
    assert len(rows) == docs.count() + 2
    held = defaultdict(list)
    for r in rows:
        held[(r["shard_bits"], r["shard_prefix"], r["shard_page"])].append(r["n_bytes"])
    assert all(sum(x) <= limit or len(x) == 1 for x in held.values())
    prefixes = {(b, p) for b, p, _ in held}
    assert not any((b, p >> (c - b)) == (b, q) and (c, p) != (b, q) for c, p in prefixes for b, q in prefixes if b < c)
    assert not sharding.shard(empty, limit).collect()


def test_sharding_query_splits(spark):
    """Dozens of shards, and the same ones as DuckDB finds."""
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    columns = ["doc_id", "n_bytes", "shard_bits", "shard_prefix", "shard_page"]
    rows = [tuple(r) for r in queries.op1_sharding(spark, sf).select(columns).collect()]
    assert len({r[2:] for r in rows}) > 12
    assert sorted(rows) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op1_sharding']})").fetchall())


def test_crowded_prefix_takes_more_passes(spark, monkeypatch):
    """A directory of one bit a pass, on keys that share long prefixes."""
    monkeypatch.setattr(sharding, "SPARE_BITS", 0)
    monkeypatch.setattr(sharding, "MORE_BITS", 1)
    df = spark.createDataFrame([(k, "y" * 50) for k in range(64)], "doc_id long, text string")
    held = defaultdict(int)
    for r in sharding.shard(df, 100).collect():
        held[(r["shard_bits"], r["shard_prefix"], r["shard_page"])] += r["n_bytes"]
    assert sum(held.values()) == 64 * 50
    assert max(held.values()) <= 100


def test_equal_rows_fill_pages(spark):
    df = spark.createDataFrame([(1, "x" * 40)] * 10, "doc_id long, text string")
    pages = [r["shard_page"] for r in sharding.shard(df, 100).collect()]
    assert sorted(pages) == sorted(k // 2 for k in range(10))


def test_urls(spark):
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [
        (1, "http://A.Example.org/es/1", ""), (2, "http://example.org/en/12", ""), (3, "http://example.org/fr/?q", ""), (4, "https://shop.com/de/x", ""), (5, "https://good.com/fr/", link("friend.net")),
        (6, "http://friend.net/x#y", ""), (7, "http://spam.net/x", link("shop.com")), (8, "http://alone.net", None), (9, None, None), (10, "no scheme", ""), (10, "no scheme", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("score", F.lit(1)).withColumn("trust", F.lit("t"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert found[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[3] == ("example.org", "/fr/", "org/", "allow")
    assert found[4][2:] == ("com/de/", "block")
    assert found[5][2:] == ("com/fr/", "allow")
    assert [found[k][3] for k in (6, 7, 8)] == ["allow", "block", "allow"]
    assert found[9] == found[10] == ("", "", None, "allow")
    assert not url_filter.judge_urls(pages.limit(0), queries.URL_RULES).collect()


def test_urls_free_of_scale(spark):
    """A host far from a weak seed is judged as in a small table, and a long chain to its end."""
    rules = [("block", "bad.test", "/"), ("allow", "good.test", "/")]
    chain = [(k, f"http://h{k}.net/", f'<a href="http://{f"h{k - 1}.net" if k else "bad.test"}/">x</a>' + "".join(f'<a href="http://o{j}.net/">x</a>' for j in range(30 * (k < 4)))) for k in range(20)]
    pages = spark.createDataFrame([*chain, (90, "http://bad.test/", ""), (91, "http://good.test/", '<a href="http://friend.net/">x</a>'), (92, "http://friend.net/", "")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert [found[k]["verdict"] for k in range(20)] == ["block"] * 20
    assert found[92]["verdict"] == "allow"
    more = spark.createDataFrame([(1000 + k, f"http://n{k}.bad.test/", "") for k in range(40)], "page_id long, url string, html string")
    alike = url_filter.judge_urls(pages.where("page_id >= 91").union(more), rules).where("page_id = 92").first()
    assert alike["trust"] == pytest.approx(found[92]["trust"])


def test_urls_against_power_iteration(spark):
    """Scores of a random host graph with a hub, by a plain iteration over dictionaries."""
    draw = random.Random(5)
    hosts = ["good.test", "bad.test", *[f"h{k}.net" for k in range(30)], *[f"s{k}.hub.io" for k in range(10)]]
    pages = [(k, f"http://{draw.choice(hosts)}/", "".join(f'<a href="http://{draw.choice(hosts)}/">x</a>' for _ in range(draw.randint(0, 4)))) for k in range(120)]
    rules = [("block", "bad.test", "/"), ("allow", "good.test", "/")]
    found = {r["host"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    weight = defaultdict(float)
    seen = {p[1][7:-1] for p in pages}
    for _, url, html in pages:
        for target in re.findall(r"http://([^/]+)/", html):
            if target != url[7:-1]:
                weight[(url[7:-1], target)] += 1
    for h in seen | {b for _, b in weight}:
        parent = h.partition(".")[2]
        if "." in parent:
            weight[(h, parent)] += 1
            weight[(parent, h)] += 1
    for column, seed, edges in (("trust", "good.test", dict(weight)), ("distrust", "bad.test", {(b, a): n for (a, b), n in weight.items()})):
        out = defaultdict(float)
        for (a, _), n in edges.items():
            out[a] += n
        start = {seed: 0.4} if seed in seen else {}
        score = dict(start)
        for _ in range(60):
            new = defaultdict(float, start)
            for (a, b), n in edges.items():
                new[b] += score.get(a, 0.0) * n / out[a] * url_filter.DAMPING
            score = new
        assert {h: r[column] for h, r in found.items()} == pytest.approx({h: score.get(h, 0.0) for h in found}, rel=1e-3, abs=1e-12)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b \\l <turn>"), (1, 0, "user", "a</turn>"), (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "ü" * 3000), (None, 0, "assistant", queries.SAMPLE_TURN), (None, 0, "assistant", queries.SAMPLE_TURN)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    found = {r["conv_id"]: r for r in chat.format_conversations(turns, queries.TOKENIZER).collect()}
    assert chat.read_back(found[1]["formatted"]) == [("user", "a</turn>"), ("assistant", "b \\l <turn>")]
    assert chat.read_back(found[2]["formatted"]) == [("", ""), ("assistant", ""), ("assistant", "ü" * 3000)]
    for conv_id, trained in ((1, "b \\l <turn>"), (2, "ü" * 3000), (None, queries.SAMPLE_TURN * 2)):
        x = found[conv_id]
        assert chat.masked_texts(x["formatted"], np.array(x["token_starts"]), np.array(x["token_ends"]), np.array(x["loss_mask"], bool)) == trained
    assert not chat.format_conversations(turns.limit(0), queries.TOKENIZER).collect()


def test_decontamination(spark):
    item = "A train with 12 wagons leaves Paris at 9 h and drives 300 km to Lyon, how long does the journey take if it stops 3 times?"
    again = "a train with 15 wagons leaves Berlin at 7 h and drives 420 km to Hamburg, how long does the journey take if it stops 5 times?"
    broken = "A train with 12 wagons leaves Paris"
    rows = [(1, "Intro words. " + item + " More."), (2, prose(3, 50) + " " + again), (3, broken), (4, None), (5, ""), (6, prose(4, 5000)), (6, prose(4, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, "short item of six words here")], "item_id long, text string")
    found = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in decontam.mark_contaminated(docs, benchmark).collect()}
    assert found == {1: (True, 7), 2: (True, 7), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None)}
    assert not decontam.mark_contaminated(docs.limit(0), benchmark).collect()
    assert not any(r["contaminated"] for r in decontam.mark_contaminated(docs, benchmark.limit(0)).collect())


def test_dense_slots(spark):
    """Runs of few ordinary words, short items of slots, names in lower case and slots that stop to agree."""
    item = "Alice paid 12 dollars for 3 kg of rice. How much does 1 kg cost?"
    rows = [
        (1, "Bob paid 20 dollars for 5 kg of rice. How much does 1 kg cost?"), (2, "Bob paid 20 dollars for 5 kg of rice. how much does 1 kg cost?"), (3, "Bob paid 20 dollars for 5 kg of rye. How much does 1 kg cost?"),
        (4, "so Carol ate 9 of 11 figs"), (5, "so Carol ate 9 of 9 figs"), (6, "Bob met Carl in 1999 with 30 kg"), (7, "so Alice met Dan in 2024 with 12 kg"),
        (8, "ALICE PAID 12 DOLLARS FOR 3 KG OF RICE. HOW MUCH DOES 1 KG COST?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "Dave ate 7 of 8 figs"), (3, "Alice 2024 Dan 12 kg")], "item_id long, text string")
    found = {r["doc_id"]: (r["item_id"], r["run_words"]) for r in decontam.mark_contaminated(docs, benchmark).collect()}
    assert found == {1: (1, 15), 2: (1, 15), 3: (None, 0), 4: (2, 6), 5: (None, 0), 6: (None, 0), 7: (None, 0), 8: (1, 15)}


PROBLEM = "Last spring Karim planted 14 rows of beans in the garden behind Oslo station, and each row needed 3 kg of compost."


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title, lambda x: x.replace("Karim", "Wanda").replace("14", "25").replace("Oslo", "Bergen"), lambda x: x.lower().replace("14", "8").replace("3 kg", "6 kg"), lambda x: "Élan: «" + x + "» ütf"])
def test_rewritten_copies(spark, change):
    docs = spark.createDataFrame([(1, prose(8, 40) + ". " + change(PROBLEM) + " " + prose(9, 40)), (2, prose(10, 90)), (3, change(PROBLEM.replace("in the garden", "on a wall")))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(4, PROBLEM), (3, "Wholly other words stand here, in a line as long as the one above it, but they tell of nothing.")], "item_id long, text string")
    found = {r["doc_id"]: r["item_id"] for r in decontam.mark_contaminated(docs, benchmark).collect()}
    assert (found[1], found[2], found[3]) == (4, None, None)


def test_item_ties_and_a_full_filter(spark, monkeypatch):
    """The smallest id among equal runs, however the filter is sized and whatever it lets through."""
    docs = spark.createDataFrame([(1, PROBLEM), (2, PROBLEM), (None, PROBLEM), (3, prose(11, 300))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, PROBLEM), (5, PROBLEM + " More."), (None, PROBLEM + " End."), (7, "w1 w2")], "item_id long, text string")
    plain = sorted(decontam.mark_contaminated(docs, benchmark).collect(), key=str)
    assert [(r["doc_id"], r["item_id"]) for r in plain] == [(1, 5), (2, 5), (3, None), (None, 5)]
    monkeypatch.setattr(decontam, "_passes", lambda found, bits, hashes: np.arange(len(hashes)))
    assert sorted(decontam.mark_contaminated(docs, benchmark).collect(), key=str) == plain


def brute_contaminated(text, items):
    """Whether 13 words in a row of an item, or all words of a shorter one, stand in the text, numbers aside."""
    plain = lambda x: [re.sub(r"^\W+|\W+$", "", w) for w in (x or "").lower().split()]
    same = lambda a, b: len(a) == len(b) and all(x == y or (x[:1].isdigit() and y[:1].isdigit()) for x, y in zip(a, b, strict=True))
    own = [w for w in plain(text) if w]
    for item in items:
        theirs = [w for w in plain(item) if w]
        n = min(13, len(theirs))
        if n and any(same(own[k : k + n], theirs[j : j + n]) for j in range(len(theirs) - n + 1) for k in range(len(own) - n + 1)):
            return True
    return False


def test_contaminated_like_brute_force(spark):
    """Copies of whole and partial items among prose, in words without names, against a plain search."""
    draw = random.Random(3)
    items = [" ".join(draw.choices(WORDS, k=draw.choice([4, 9, 13, 20, 40]))) for _ in range(30)]
    texts = []
    for k in range(120):
        own, item = prose(500 + k, 60).split(), draw.choice(items).split()
        cut = draw.randint(1, len(item))
        start = draw.randint(0, len(item) - cut)
        at = draw.randint(0, 60)
        texts.append(" ".join(own[:at] + item[start : start + cut] + own[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["contaminated"] for r in decontam.mark_contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    expected = {k: brute_contaminated(t, items) for k, t in enumerate(texts)}
    assert found == expected
    assert 10 < sum(expected.values()) < 110


def test_mix(spark):
    rows = [(i, "abc"[0 if i % 2 else i % 3], "t") for i in range(400)] + [(400, None, None), (401, "other", "t"), (None, "a", "t"), (5, "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"a": 5, "b": 2, "c": 1}
    found = mixing.mix_sources(docs, weights).collect()
    assert len(found) == len(rows)
    order = [r for r in sorted((r for r in found if r["mix_slot"] is not None), key=lambda r: r["mix_slot"]) if r["in_mix"]]
    assert [r["mix_slot"] for r in order] == list(range(len(order)))
    seen = dict.fromkeys(weights, 0)
    for n, r in enumerate(order, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * w / 8) < 1 for s, w in weights.items())
    assert sum(r["mix_slot"] is None for r in found) == 2
    assert not mixing.mix_sources(docs.limit(0), weights).collect()


def test_mix_in_many_runs_and_blocks(spark, monkeypatch):
    """The same order with one run and with many; blocks of several rows keep their rows together."""
    rows = [(k // 2, "ab"[k % 3 == 0], f"t{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = lambda size: sorted((r["mix_slot"], r["mix_place"], r["text"]) for r in mixing.mix_sources(docs, {"a": 2, "b": 1}, size).collect())
    plain, blocks = order(1), order(4)
    monkeypatch.setattr(mixing, "RUN_ROWS", 20)
    assert (order(1), order(4)) == (plain, blocks)
    places = defaultdict(list)
    for slot, place, _ in blocks:
        places[slot].append(place)
    assert all(x == list(range(len(x))) and len(x) <= 4 for x in places.values())


def dice(a, b):
    """Share of 16-character spans in common."""
    if a == b:
        return 1.0
    a, b = ({t[k : k + 16] for k in range(max(1, len(t) - 15))} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("size", [1024, 4096])
def test_hashes_of_adverse_texts(spark, size):
    """Thue-Morse texts, which collide modulo powers of two at any point."""
    plain = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
    other = plain.translate(str.maketrans("ab", "ba"))
    a, b = fingerprint.PrefixHashes.of(plain), fingerprint.PrefixHashes.of(other)
    assert not a.same(0, b, 0, size)
    assert a.fingerprint()[0] != b.fingerprint()[0]
    assert a.same(0, b, size // 2, size // 2) == (plain[: size // 2] == other[size // 2 :])
    docs = spark.createDataFrame([(1, plain), (2, other), (3, " ".join(plain)), (4, " ".join(other))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(docs).collect()}
    assert {k: (r["n_removed"], bytes(r["kept"])) for k, r in found.items()} == {k: (x[1], x[2]) for k, x in zip((1, 2, 3, 4), brute_repeats([plain, other, " ".join(plain), " ".join(other)], 200), strict=True)}


def test_fingerprints(docs, empty, spark):
    rows = sorted(((i, t or "") for i, t in corpus()), reverse=True) + [(None, "no id here at all, five words")]
    found = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs.withColumn("owner", F.lit(1))).collect()}
    assert len(found) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        changed = t[: len(t) - third] + following[:third]
        assert found[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(found[i]["near_next"] - dice(t, following)) < 0.3 and abs(found[i]["near_edited"] - dice(t, changed)) < 0.3
        same = next((j for j, (x, y) in enumerate(zip(t, changed, strict=False)) if x != y), min(len(t), len(changed)))
        assert found[i]["same_start"] == same
    texts = dict(corpus())
    for i in texts:
        for j in texts:
            assert ((texts[i] or "") == (texts[j] or "")) == (found[i]["fingerprint"] == found[j]["fingerprint"])
    assert not fingerprint.compare_with_next(empty).collect()


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    rows = [(k // 3 if k % 5 else k, prose(k, 20 + k % 40)) for k in range(150)] + [(None, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    expected = sorted((i or -1, len(t), hashlib.sha256(fingerprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in fingerprint.compare_with_next(docs).collect()) == expected


def test_fingerprints_without_ids_and_with_the_least_ones(spark, monkeypatch):
    """Half the rows have no id, others the two least ids there are; ids are sampled, and a boundary id sends one row a task."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    monkeypatch.setattr(fingerprint, "IDS_A_RANGE", 1)
    least = -(1 << 63)
    rows = [([None, k, None, least + 1, None, least][k % 6], prose(k, 10 + k % 30)) for k in range(120)]
    ordered = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    expected = sorted(((i, hashlib.sha256(fingerprint.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered)), key=key)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in fingerprint.compare_with_next(docs).collect()), key=key) == expected


def test_languages(spark, empty):
    voice = {"en": "the and with from there which of is", "de": "der und mit von ich nicht ist eine", "fr": "le et avec dans une est pour que"}
    rows = [(i, " ".join(random.Random(i).choices(voice[lang].split(), k=30)), lang) for i, lang in enumerate(list(voice) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !", "en"), (902, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    found = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_quality(spark, empty):
    good = lambda k: ". ".join(prose(1000 + k * 9 + j, 12).capitalize() for j in range(6)) + "."
    bad = lambda k: "BUY NOW!!! $$$ " * (10 + k % 7)
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("statistics", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(300, None, None), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert all((found[i] >= 0.5) == (i % 2 == 1) for i in range(200))
    assert all(0 <= x <= 1 for x in found.values())
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert not quality.score_documents(empty, labels).collect()
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept >= {i for i in range(200) if i % 2}
    assert not kept & {i for i in range(0, 200, 2)}
    odd = spark.createDataFrame([(None, None, "x"), (None, None, "x"), (7, "", "y")], "doc_id long, text string, statistics string")
    assert quality.keep_good(odd, labels.limit(0)).collect() == odd.collect()


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    """Predictions stay when held-out labels, lang of held-out rows and sources change."""
    voice = {"en": "the and with from there which of is", "de": "der und mit von ich nicht ist eine"}
    texts = [" ".join(random.Random(k).choices(voice["en" if k % 2 else "de"].split(), k=12)) + "." * (k % 4) for k in range(120)]
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "de", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    held = lambda n, rest: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest
    languages = lambda df: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("?")), langid.fit(df.where(~held(5, 0)))).collect()}
    assert languages(docs) == languages(docs.withColumn("lang", F.when(held(5, 0), "xx").otherwise(F.col("lang"))))
    labels = docs.select("doc_id", (F.length("text") % 2).cast("int").alias("quality"))
    scores = lambda marks: {r["doc_id"]: r["score"] for r in quality.score_documents(docs, marks).collect()}
    flipped = labels.withColumn("quality", F.when(held(3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert scores(labels) == scores(flipped)


def test_decontamination_of_tables_and_titles(spark, monkeypatch):
    """Slots only: joined by value, so tables of numbers don't meet; title case with other names; slots between anchors."""
    numbers = lambda start, n: " ".join(str(start + 7 * k) for k in range(n))
    items = [(1, numbers(1, 800)), (2, "last spring Wanda planted 25 rows of beans in the garden behind her house and sold them at the market"), (3, "the scores of the match were 1 2 3 4 5 6 7 8 9 10 11 and the crowd of the town went home after the final whistle")]
    docs = [
        (1, numbers(2, 800)), (2, "x " + numbers(1, 800) + " y"), (3, "Last Spring Edgar Planted 31 Rows of Beans in the Garden Behind Her House and Sold Them at the Market"),
        (4, "the scores of the match were 21 22 23 24 25 26 27 28 29 30 31 and the crowd of the town went home after the final whistle"), (5, "Last Spring Edgar Planted 31 Trees of Apples on the Hill Above the River and Gave Them to a Friend"),
    ]
    joined = []
    longest = decontam._longest
    monkeypatch.setattr(decontam, "_longest", lambda stretches: joined.append(stretches) or longest(stretches))
    found = {r["doc_id"]: r["item_id"] for r in decontam.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {1: None, 2: 1, 3: 2, 4: 3, 5: None}
    assert joined[0].select(F.sum(F.size("windows"))).first()[0] < 1000  # 800 * 800 / 2 by templates


def test_urls_under_a_public_suffix(spark):
    """A blocked site says nothing of strangers under the same suffix, nor of those that link to them; its subdomains share its fate."""
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [(1, "http://bad.co.uk/", ""), (2, "http://honest.co.uk/", ""), (3, "http://library.co.uk/", link("honest.co.uk")), (4, "http://faraway.net/", link("honest.co.uk")), (5, "http://friend.net/", link("www.bad.co.uk")), (6, "http://www.shop.bad.co.uk/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [("block", "bad.co.uk", "/")]).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block"}


def test_languages_of_many_short_texts(spark):
    """Blocks of few rows give what one block gives."""
    rows = [(i, random.Random(i).choice(("the and with", "der und mit", "le et avec", "")), None) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.withColumn("lang", F.substring("text", 1, 2)))
    plain = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(docs, model).collect()}
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(docs.coalesce(1), model, 7).collect()} == plain and len(plain) == 90


def test_rows_without_ids_are_dealt_evenly(spark):
    """With half the ids null no chunk or run gets over one and a half times an even share."""
    docs = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    for part in (suffix_dedup.chunk_of(F.col("doc_id"), F.xxhash64("text"), 16), F.shiftright(mixing.order_key(docs), mixing.KEY_BITS - 4)):
        sizes = [r["count"] for r in docs.groupBy(part.alias("part")).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 1.5 * 40_000 / 16


def test_mix_of_rows_without_ids(spark, monkeypatch):
    rows = [(None if k % 2 else k, "ab"[k % 3 == 0], f"t{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = lambda: sorted((r["mix_slot"], r["mix_place"], r["text"]) for r in mixing.mix_sources(docs, {"a": 2, "b": 1}, 4).collect())
    plain = order()
    monkeypatch.setattr(mixing, "RUN_ROWS", 20)
    assert order() == plain and sorted(x[2] for x in plain) == sorted(r[2] for r in rows)


def test_spans_of_rows_without_ids(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=500))
    texts = [long, long, long[:300] + "x", "short", None, *[f"{k} {long[k:]}" for k in range(1, 40)]]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    found = sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.repeated_spans(docs).collect())
    assert found == sorted(brute_repeats(texts, 200))
