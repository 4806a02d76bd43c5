"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.llm import chat, decontam, fingerprint, langid, lm_score, merkle, mixing, near_dedup, quality, sharding, suffix_dedup, url_filter, vector_codes
from pacegrid.llm.common import table

SHARD_BYTES = 8 << 20
#: Limit of the sharding query: small enough for buckets to split on tables of any size.
SMALL_SHARD_BYTES = 128 << 10
#: Shares of the sources in the mix, of a sum of 24.
MIX_WEIGHTS = {"src0": 5} | {f"src{k}": 1 for k in range(1, 20)}
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SAMPLE_TURN = "\\### Assistant: </turn> ok"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document, of at most SMALL_SHARD_BYTES of text; see sharding.shard() for nulls, ties and repeated rows."""
    return sharding.shard(table(spark, sf_dir, "documents"), SMALL_SHARD_BYTES).select("doc_id", "n_bytes", "shard_bits", "shard_prefix", "shard_page")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document under repeated 200-byte strings; see suffix_dedup.repeated_spans()."""
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document at a similarity of 0.85; see near_dedup.near_duplicates()."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page; see url_filter.judge_urls()."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Digests of each formatted conversation, read back from the output, with one of awkward texts added; see chat.format_conversations()."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(SAMPLE_TURN).alias("text")) for k, r in enumerate(("user", "assistant"))])))
    formatted = chat.format_conversations(turns.unionByName(sample), tokenizer_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            lists = [batch.column(c) for c in ("token_starts", "token_ends", "loss_mask")]
            edges = lists[0].offsets.to_numpy()
            starts, ends, mask = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            out = []
            for conv_id, text, a, b in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), edges[:-1], edges[1:], strict=True):
                said, trained = chat.read_back(text), chat.masked_texts(text, starts[a:b], ends[a:b], mask[a:b])
                out.append({"conv_id": conv_id, "n_turns": len(said), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in said)), "loss_chars": len(trained), "loss_sha256": sha(trained), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark item, if any, that each document holds; see decontam.mark_contaminated()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark_contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_id", "run_words")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document in a mix by MIX_WEIGHTS; see mixing.mix_sources()."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likenesses; see fingerprint.compare_with_next()."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def _crc(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from four fifths of those with lang; see langid.predict()."""
    docs = table(spark, sf_dir, "documents")
    held_out = _crc(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from the labels of two thirds; see quality.score_documents()."""
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of each vector under codebooks fitted to all; see vector_codes.compress()."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document under a model of four fifths of them; see lm_score.score_documents()."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"), _crc(F.col("doc_id"), 5) == 1)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of each document; see merkle.manifest()."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_chat_format": op5_chat_format,
    "op6_decontam": op6_decontam,
    "op7_mixing": op7_mixing,
    "op8_fingerprint": op8_fingerprint,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_lm_score": op12_lm_score,
    "op13_merkle": op13_merkle,
}
def _codes_sql() -> str:
    """SQL of op11: the six rounds, each a table of entries, written one after the other."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    nearest = """near{k} AS MATERIALIZED (
  SELECT row_no, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT x.row_no, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM cells x JOIN book{k} c USING (part, place) GROUP BY x.row_no, x.part, c.entry) GROUP BY row_no, part)"""
    moved = """book{n} AS MATERIALIZED (
  SELECT c.part, c.entry, c.place, coalesce(s.v, c.v) AS v FROM book{k} c LEFT JOIN (
    SELECT x.part, n.best.entry AS entry, x.place, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM cells x JOIN near{k} n USING (row_no, part) GROUP BY x.part, n.best.entry, x.place) s USING (part, entry, place))"""
    steps = ",\n".join([text.format(k=k, n=k + 1) for k in range(rounds) for text in (nearest, moved)] + [nearest.format(k=rounds)])
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label NULLS FIRST) - 1 AS row_no FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT row_no, g // (len(embedding) // {parts}) AS part, g % (len(embedding) // {parts}) AS place, CAST(floor(4096 * CAST(embedding[g + 1] AS DOUBLE)) AS BIGINT) AS v
  FROM kept, unnest(range(0, len(embedding))) AS t(g)),
book0 AS MATERIALIZED (SELECT part, row_no AS entry, place, v FROM cells WHERE row_no < {entries}),
{steps},
coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(n.best.entry)), 2, '0'), '' ORDER BY n.part) AS code, CAST(sum(n.best.d) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n USING (row_no) GROUP BY k.row_no, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


def _merkle_sql() -> str:
    """SQL of op13. crc32 is worked out byte by byte; 3988292384 is its reversed polynomial, a fixed value."""
    said = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS steps FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(n))),
leaves AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295) % 3 = 0 THEN {leaf(lower)} END AS changed FROM documents, crc),
own AS MATERIALIZED (
  SELECT *, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS k, i, leaf AS h, n FROM own
  UNION ALL SELECT lang, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, k, i // 8, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS k, i, h, n FROM subroots
  UNION ALL SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY k, i // 8, n),
runs AS (
  SELECT o.row_no, t.k, t.i, t.h, o.i >> CAST(3 * t.k AS BIGINT) AS mine FROM own o JOIN nodes t ON t.lang IS NOT DISTINCT FROM o.lang AND t.n > 1 AND t.i // 8 = (o.i >> CAST(3 * t.k AS BIGINT)) // 8
  UNION ALL SELECT o.row_no, 100 + t.k, t.i, t.h, s.i >> CAST(3 * t.k AS BIGINT) FROM own o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang JOIN tops t ON t.n > 1 AND t.i // 8 = (s.i >> CAST(3 * t.k AS BIGINT)) // 8),
paths AS (
  SELECT row_no, list(sides ORDER BY k) AS path, string_agg(siblings, '' ORDER BY k) AS siblings FROM (
    SELECT row_no, k, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < mine), '') || '|' || coalesce(string_agg(h, '' ORDER BY i) FILTER (i > mine), '') AS sides,
      coalesce(string_agg(h, '' ORDER BY i) FILTER (i <> mine), '') AS siblings FROM runs GROUP BY row_no, k) GROUP BY row_no),
folded AS (
  SELECT o.doc_id, o.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(o.changed, o.leaf), coalesce(p.path, [])), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root
  FROM own o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang LEFT JOIN paths p USING (row_no))
SELECT *, folded_root = root AS verified FROM folded"""


ORACLE_SQL: dict[str, str] = {
    "op1_sharding": f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS k
  FROM documents),
levels AS (SELECT doc_id, n_bytes, k, d, k >> (60 - d) AS p FROM keyed, range(0, 61) AS t(d)),
sums AS (SELECT d, p FROM levels GROUP BY d, p HAVING sum(n_bytes) <= {SMALL_SHARD_BYTES} OR min(k) = max(k)),
found AS (SELECT doc_id, n_bytes, k, min(d) AS d FROM levels JOIN sums USING (d, p) GROUP BY doc_id, n_bytes, k)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(d AS INTEGER) AS shard_bits, k >> (60 - d) AS shard_prefix, CAST(0 AS BIGINT) AS shard_page FROM found""",
    "op3_near_dedup": r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op5_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r)),
safe AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\lturn>'), '<says>', '\lsays>'), '</turn>', '\l/turn>'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '<says>', '\lsays>'), '</turn>', '\l/turn>')) + 19 AS chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id""",
    "op7_mixing": f"""
WITH turns(source, step, turn) AS (VALUES {", ".join(f"('{s}', {i}, {t})" for s, i, t in mixing.pattern(MIX_WEIGHTS))}),
shares AS (SELECT source, count(*) AS share FROM turns GROUP BY source),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id) - 1 AS mix_block FROM documents),
gap AS (
  SELECT min(n // share * (SELECT count(*) FROM turns) + turn) AS first_gap
  FROM (SELECT s.source, s.share, count(d.source) AS n FROM shares s LEFT JOIN documents d ON d.source = s.source GROUP BY s.source, s.share) x
  JOIN turns t ON t.source = x.source AND t.step = x.n % x.share),
placed AS (
  SELECT r.doc_id, r.source, r.mix_block, r.mix_block // share * (SELECT count(*) FROM turns) + turn AS mix_slot
  FROM ranked r LEFT JOIN shares s ON s.source = r.source LEFT JOIN turns t ON t.source = r.source AND t.step = r.mix_block % s.share)
SELECT doc_id, source, mix_block, mix_slot, CAST(0 AS BIGINT) AS mix_place, coalesce(mix_slot < first_gap, false) AS in_mix FROM placed, gap""",
    "op11_vector_codes": _codes_sql(),
    "op13_merkle": _merkle_sql(),
}
