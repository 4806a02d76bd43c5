"""The pipeline's stages on awkward rows, and as a whole on the smallest tables."""

import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(2).union(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string"), "lang", F.lit(None).cast("string"), "n_chars"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (odd, docs.limit(0)):
            out = stage(spark, frame, SF)
            assert out.columns[: len(columns)] == columns
            assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
            assert out.count() <= frame.count()


def test_one_of_each_group_goes_by_content(spark):
    """Null and repeated ids with different texts stay; only copies and exact ties go."""
    import corpus_pipeline

    say = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(3, say("a")), (9, say("a") + " end"), (9, say("z")), (None, None), (None, say("b")), (None, say("c")), (None, say("c")), (7, say("d")), (7, say("e")), (7, say("e")), (8, " \n"), (8, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    expected = [rows[k] for k in (0, 2, 3, 4, 5, 7, 8, 10, 11)]
    assert sorted(out, key=str) == sorted(expected, key=str)


def test_shards_follow_the_mix(spark, tmp_path):
    """Slots against a slot-by-slot schedule, and the rows of each shard in that order, also when read back."""
    import corpus_pipeline
    from pacegrid.llm.queries import MIX_WEIGHTS

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.limit(300).union(docs.limit(1).select(F.lit(-1).cast("long"), "text", "lang", F.lit(None).cast("string"), "n_chars"))
    waiting = defaultdict(list)
    for r in docs.select("doc_id", "source").collect():
        waiting[r["source"] if r["source"] in MIX_WEIGHTS else None].append((int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r["doc_id"]))
    total, slot, turn, done = sum(MIX_WEIGHTS.values()), {-1: None}, 0, dict.fromkeys(MIX_WEIGHTS, 0)
    while any(done[s] < len(waiting[s]) for s in MIX_WEIGHTS):
        ready = [s for s, w in MIX_WEIGHTS.items() if done[s] * total // w <= turn]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // MIX_WEIGHTS[s]), s))
        if done[s] < len(waiting[s]):
            slot[sorted(waiting[s])[done[s]][1]] = turn
        done[s], turn = done[s] + 1, turn + 1
    corpus_pipeline.sharded(spark, corpus_pipeline.mixed(spark, docs, SF), SF).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["doc_id"]: r["mix_slot"] for r in rows} == slot
    shards = defaultdict(list)
    for r in rows:
        shards[(r["shard_bits"], r["shard_prefix"], r["shard_page"])].append(r)
    for own in shards.values():
        assert [r["shard_place"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["mix_slot"] is None, r["mix_slot"], r["mix_place"]))


def test_run(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 50
    texts = [r["text"] for r in rows]
    assert len(set(texts)) == len(texts)


def test_each_stage_works_once(spark, monkeypatch):
    """What a stage returns is computed once, however often later stages read it."""
    import corpus_pipeline

    seen = spark.sparkContext.accumulator(0)

    def watched(stage):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda spark, docs, sf_dir: (out := stage(spark, docs, sf_dir)).mapInArrow(count, out.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage) if k == 0 else stage) for k, (name, stage) in enumerate(corpus_pipeline.STAGES)])
    corpus_pipeline.run(spark, SF).collect()
    kept = corpus_pipeline.good_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    assert seen.value == kept
