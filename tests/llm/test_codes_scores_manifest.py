"""Vector codes, language-model scores and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import lm_score, merkle, queries, vector_codes
from pacegrid.llm.common import cut, discard

SF = "/root/testdata/sf0.001"
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
LOWER = lambda text: re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_codes(rows):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = np.floor(np.array([r[1] for r in rows], float) * 4096).astype(np.int64)
    x = x.reshape(len(x), 8, -1).transpose(1, 0, 2)
    books = x[:, :16].copy()
    for k in range(7):
        apart = ((x[:, :, None, :] - books[:, None, :, :]) ** 2).sum(3)
        best = apart.argmin(2)
        for part in range(8 * (k < 6)):
            for e in range(books.shape[1]):
                if (own := best[part] == e).any():
                    books[part, e] = x[part][own].sum(0) // own.sum()
    errors, sums = apart.min(2).sum(0), Counter()
    for r, e in zip(rows, errors, strict=True):
        sums[r[2]] += int(e)
    sha = SHA(",".join(map(str, books.ravel())))
    return sorted([(r[0], r[2], "".join(f"{b:02x}" for b in best[:, i]), int(errors[i]), sums[r[2]], sha) for i, r in enumerate(rows)], key=str)


VECTORS = "vec_id long, embedding array<double>, label int, error string"


def vectors():
    """Ties, null and repeated ids, null labels, one vector in a third of the rows, and all that is left out."""
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(300)]), [rng.choice([0.0, 1.0, -0.5, rng.random()]) for _ in range(16)], rng.choice([None, 1, 2])) for _ in range(700)]
    rows += [(1, None, 1), (2, [math.nan] * 16, 1), (3, [None] * 16, 1), (4, [math.inf] * 16, 1), (5, [1.0, None] * 8, 1), (-5, [], 2)]
    return rows + [(7, [0.25] * 16, 2)] * 400


@pytest.mark.parametrize("some", [lambda r: True, lambda r: r[0] is not None and r[0] < 5, lambda r: r[0] == 7])
def test_codes(spark, monkeypatch, some):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 1 << 11)
    rows = [r for r in vectors() if some(r)]
    found = vector_codes.compress(spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows)


def test_codes_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, vector_codes.compress(table).collect()), key=str) == brute_codes(rows)
    assert [r["code"] for r in queries.op11_vector_codes(spark, SF).orderBy("vec_id").limit(9).collect()] == [r[2] for r in sorted(brute_codes(rows))[:9]]


def test_heaps_spare_rescans(spark):
    """Once entries move little, only parts of small slack are popped, and the codes are those of a full scan."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-9, 9, (16, 16)) / 2
    rows = [(i, [float(v) for v in centres[i % 16] + rng.normal(0, 0.01, 16)], i % 3) for i in range(1600)]
    usable = vector_codes.usable(spark.createDataFrame([(*r, "") for r in rows], VECTORS))
    now, blocks, _ = vector_codes.fit(usable)
    assert blocks.agg(F.sum("rescanned")).first()[0] < 0.2 * 8 * len(rows)
    assert brute_codes(rows)[0][-1] == now.digest()


def test_codes_of_odd_tables(spark):
    table = spark.createDataFrame([(1, [1e30, -1e30, 0.5, 0.25, 0.0, 0.0, 0.0, 1.0, 2.0], 1, ""), (2, [0.0] * 9, 1, ""), (3, [0.0] * 4, 1, "")], VECTORS)
    found = {r["vec_id"]: r for r in vector_codes.compress(table).collect()}
    assert set(found) == {1, 2} and all(r["error"] == 0 for r in found.values())  # clamped; another dimension is left out
    empty = vector_codes.compress(table.limit(0))
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and not empty.count()


def test_discard(spark):
    table = cut(spark.range(3))
    discard(table)
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such file"):
        table.collect()


HELD_OUT = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def brute_scores(rows):
    tokens = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", LOWER(text or "")), "\0end"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts, pairs, firsts, follow = Counter(), Counter(), Counter(), defaultdict(set)
    for i, text in rows:
        before = "\0begin"
        for word in [] if held(i) else tokens(text):
            counts[word], pairs[before, word], firsts[before] = counts[word] + 1, pairs[before, word] + 1, firsts[before] + 1
            follow[before].add(word)
            before = word
    total, out = sum(counts.values()), []
    for i, text in rows:
        base = score = 0.0
        before = "\0begin"
        for word in tokens(text):
            single = (counts[word] + 0.5) / (total + 0.5 * (len(counts) + 1))
            level = int(np.searchsorted(lm_score.LEAST, pairs[before, word], side="right"))
            spread = len(follow[before])
            both = min(lm_score.MEANS[level], counts[word], firsts[before])
            base += math.log10(single)
            score += math.log10((both + spread * single) / (firsts[before] + spread)) if spread else math.log10(single)
            before = word
        own = tokens(text)
        out.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), total, base, score))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 28, 0])
def test_scores(spark, monkeypatch, broadcast_bytes):
    """Both ways; the filter may take an absent pair for a present one, so only sums over many texts are held to 1 %."""
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 1 << 10)
    monkeypatch.setattr(lm_score, "HOT_SHARE", 8)
    monkeypatch.setattr(lm_score, "PART_BYTES", 1 << 9)
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (None, "a B c"), (3, " \n"), (3, " \n"), (4, "The cat sat on the mat " * 50), (6, "x" * 100_000)]
    rows += [(i, " ".join(rng.choices("the dog Sat on a mat and Élan".split(), k=30))) for i in range(10, 90)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    order = lambda r: (str(r[:4]), r[5])
    found, wanted = sorted(map(tuple, lm_score.score_documents(docs, HELD_OUT(), broadcast_bytes).collect()), key=order), sorted(brute_scores(rows), key=order)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted])
    assert np.isclose(sum(r[6] for r in found), sum(r[6] for r in wanted), rtol=0.01)
    assert not lm_score.score_documents(docs.limit(0), HELD_OUT(), broadcast_bytes).count()
    alone = lm_score.score_documents(docs.where("doc_id = 3"), F.lit(True), broadcast_bytes).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(1, 0, 0, 0.0, 0.0)] * 2


def test_scores_of_the_table(spark):
    """Held-out texts are likelier by pairs than by single words, and both ways agree text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, other = ({r["doc_id"]: r for r in lm_score.score_documents(docs, HELD_OUT(), most).collect()} for most in (1 << 28, 0))
    wanted = {r[0]: r for r in brute_scores([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert all(tuple(r)[:5] == wanted[i][:5] and np.isclose(r["base_score"], wanted[i][5]) for i, r in found.items())
    assert all(np.isclose(found[i]["score"], r["score"]) for i, r in other.items()) and len(other) == len(found)
    assert np.isclose(sum(r["score"] for r in found.values()), sum(r[6] for r in wanted.values()), rtol=0.01)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("n_passes", "part_bytes"), [(5, 1 << 14), (3, 1 << 24)])
def test_scores_in_passes(spark, monkeypatch, n_passes, part_bytes):
    """A filter above the broadcasts' limit: passes over the texts, with repeated rows and ids, give the scores of one pass."""
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 1 << 15)
    monkeypatch.setattr(lm_score, "PART_BYTES", part_bytes)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    odd = spark.createDataFrame([(1, None), (1, None), (1, ""), (None, "of the"), (None, "of the"), (None, "THE of"), (3, "unheard of"), (4, "of " * 30_000)], "doc_id long, text string")
    docs = table.union(odd).union(table.where("doc_id < 9")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = lm_score.fit(docs.where("doc_id % 3 > 0 or doc_id is null"))
    tokens = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", LOWER(text)), "\0end"]
    learned = [r["text"] for r in docs.collect() if r["doc_id"] is None or r["doc_id"] % 3]
    assert (model.tokens, model.words.agg(F.max("count")).first()[0]) == (sum(len(tokens(x)) for x in learned), max(Counter(w for x in learned for w in tokens(x)).values()))
    one, more = (sorted(map(tuple, lm_score._broadcast_scores(docs, model, n).collect()), key=str) for n in (1, n_passes))
    assert [r[:3] for r in one] == [r[:3] for r in more] and len(one) == docs.count()
    assert np.allclose([r[3:] for r in one], [r[3:] for r in more], rtol=1e-12)
    seen, room = [], -(-model.filter_bytes // n_passes)
    monkeypatch.setattr(lm_score, "_broadcast_scores", lambda docs, model, n: seen.append(n) or spark.createDataFrame([], lm_score._schema()))
    monkeypatch.setattr(lm_score, "fit", lambda docs: model)
    assert model.passes(model.word_bytes + model.filter_bytes) in (0, 1) and not model.passes(model.word_bytes)
    model.word_bytes = 3 * room
    lm_score.score_documents(docs, HELD_OUT(), 4 * room)
    assert seen == [n_passes]


def brute_manifest(rows):
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: SHA("".join(map(say, r)))
    trees = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], LOWER(r[4]))) if changed else None))

    def build(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                start = place // 8 * 8
                paths[k].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])))
                at[k] = place // 8
            nodes = [SHA("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = [build([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in order]
    root, tops = build([subroot for subroot, _ in built])
    out = []
    for lang, (subroot, paths), top in zip(order, built, tops, strict=True):
        for (has, i, own, changed), path in zip(sorted(trees[lang], key=lambda x: x[:3]), paths, strict=True):
            at = changed or own
            for before, behind in path + top:
                at = SHA(before + at + behind)
            out.append((i if has else None, own, subroot, root, SHA("".join(a + b for a, b in path + top)), at, at == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf int"


@pytest.mark.parametrize("bucket_rows", [1024, 20])
def test_manifest(spark, monkeypatch, bucket_rows):
    """Null, extreme and repeated ids, one row in two thirds of all rows, many languages, and long texts."""
    monkeypatch.setattr(merkle, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(1)
    ids = [None, None, 5, 7, -3, 2**62, -(2**63), 2**63 - 1, *range(100)]
    rows = [(rng.choice(ids), None, rng.choice([None, "en", "en", "é", "a", "", "z"]), rng.choice([None, 3]), rng.choice([None, "", "A", "b", "C" * 100, "É X" * 30_000])) for _ in range(600)]
    rows += [(9, "s", "en", 1, "Same")] * 1200 + [(4, "s", f"l{k}", 1, "t") for k in range(20)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(3)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    docs = spark.createDataFrame([(3, "s", "en", 1, "Same", 1), (3, "s", None, 1, None, 1)], DOCS)
    for some in (docs, docs.limit(1), docs.where("lang is null")):
        rows = [tuple(r)[:5] for r in some.collect()]
        assert sorted(map(tuple, merkle.manifest(some).collect()), key=str) == brute_manifest(rows)
    assert not merkle.manifest(docs.limit(0)).count()


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op13_merkle(spark, SF).collect()), key=str) == brute_manifest(rows)
