"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import (bpe, compression_quality, divergence, language_filters, license_scan, minhash_forest, mixing, periodic_runs, pii,
                           projection_passes, repetition, suffix_trees, token_store)

BYTE_TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count_of(k) for k in pii.KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_store(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", repetition.repetition(F.col("text")).alias("r")).select("doc_id", "r.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_filters.identify(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    text = periodic_runs.plant_runs(F.col("text"), F.when(h % 10 == 0, F.floor(h / 10)))
    best = F.col("r.strongest")
    written = F.array_join(F.transform("r.runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    listed = F.when(F.size("r.runs") > 0, F.concat(written, F.lit("\n"))).otherwise(F.lit(""))
    return docs.select("doc_id", periodic_runs.periodic_runs(text).alias("r")).select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * r.strongest.length) div r.strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_source_mix": op1, "op2_minhash_forest": op2, "op3_contextual_pii": op3, "op4_compression_quality": op4, "op5_token_store": op5,
    "op6_projection_passes": op6, "op7_bpe_automaton": op7, "op8_repetition_rules": op8, "op9_license_scan": op9,
    "op10_language_filters": op10, "op11_suffix_trees": op11, "op12_divergence_quadtree": op12, "op13_periodic_runs": op13,
    "pipeline": pipeline,
}

_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(n, r) AS (SELECT {id}, {id} FROM nodes UNION SELECT reach.n, b FROM reach JOIN both_ways ON reach.r = a),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n)"""

ORACLE = {
    # brute force: every quotient of every party is ranked
    "op1_source_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
  [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(lim) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM r
  WINDOW o AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, docs, least(lim, max(level) OVER () * w) AS target FROM l),
b AS (SELECT *, greatest(1, least(256, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 200)))::BIGINT AS bt,
  greatest(1, ceil(docs / 4096), ceil(source_size / 8000000))::BIGINT AS shards FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.bt, md5('mix:' || doc_id) AS digest,
  ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT % b.shards AS shard FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
h AS (SELECT source, shard, bt, sum(size)::BIGINT AS shard_size, any_value(target) AS target,
  ceil(sum(size) / bt)::BIGINT AS blocks FROM p GROUP BY source, shard, bt),
c AS (SELECT source, any_value(target) AS target, sum(blocks)::BIGINT AS blocks FROM h GROUP BY source),
n AS (SELECT round(sum(target) / (SELECT any_value(bt) FROM h))::BIGINT AS seats FROM c),
q1 AS (SELECT source, target / (2 * k + 1) AS quotient, k FROM c, unnest(range(0, 2 * blocks)) AS u(k)),
w1 AS (SELECT source, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS place FROM q1), n
  WHERE place <= n.seats GROUP BY source),
q2 AS (SELECT h.source, shard, shard_size / (2 * k + 1) AS quotient, k FROM h, unnest(range(0, 2 * blocks)) AS u(k)),
w2 AS (SELECT source, shard, count(*) AS quota FROM (
    SELECT q2.*, w1.seats, row_number() OVER (PARTITION BY q2.source ORDER BY quotient DESC, shard, k) AS place
    FROM q2 JOIN w1 ON q2.source IS NOT DISTINCT FROM w1.source) WHERE place <= seats GROUP BY source, shard),
m AS (SELECT h.*, coalesce(quota, 0) AS quota, coalesce(quota, 0) // greatest(blocks, 1) AS fully, coalesce(quota, 0) % greatest(blocks, 1) AS extra,
  ('0x' || substr(md5('mix:' || coalesce(h.source, '') || ':' || h.shard), 1, 8))::BIGINT % greatest(blocks, 1) AS start
  FROM h LEFT JOIN w2 ON h.source IS NOT DISTINCT FROM w2.source AND h.shard = w2.shard),
x AS (SELECT p.*, m.blocks, m.fully, m.extra, m.start,
  coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source AND p.shard = m.shard),
y AS (SELECT *, lo + size AS hi FROM x)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE fully * size
  + (((hi // bt) * extra + start) // blocks) * bt + (hi % bt) * (((hi // bt + 1) * extra + start) // blocks - ((hi // bt) * extra + start) // blocks)
  - (((lo // bt) * extra + start) // blocks) * bt - (lo % bt) * (((lo // bt + 1) * extra + start) // blocks - ((lo // bt) * extra + start) // blocks)
  END::BIGINT AS taken FROM y""",
    "op2_minhash_forest": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0),
nodes AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id) p JOIN nodes na ON na.doc_id = p.a JOIN nodes nb ON nb.doc_id = p.b
  WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
""" + _COMPONENTS.format(id="doc_id") + """
SELECT doc_id, nodes.n AS n_shingles, c AS component_id, doc_id = c AS kept FROM nodes JOIN comp ON comp.n = doc_id""",
    "op6_projection_passes": r"""
WITH RECURSIVE nodes AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id
  AND x.norm > 0 AND y.norm > 0 AND list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.98),
""" + _COMPONENTS.format(id="vec_id") + """,
degree AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM nodes JOIN comp ON comp.n = vec_id LEFT JOIN degree ON a = vec_id""",
    # every window of every text
    "op11_suffix_trees": r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, i, words[i:i + 34] AS win FROM w, unnest(range(1, len(words) - 33)) AS u(i)),
c AS (SELECT md5(array_to_string(win, ' ')) AS h, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT s.r, s.i FROM s JOIN c ON md5(array_to_string(win, ' ')) = c.h),
cov AS (SELECT DISTINCT r, i + j AS p FROM x, unnest(range(0, 35)) AS u(j)),
k AS (SELECT w.r, w.doc_id, len(words) AS n_words, p.i AS p, words[p.i] AS word FROM w, unnest(range(1, len(words) + 1)) AS p(i)),
kept AS (SELECT k.r, string_agg(word, ' ' ORDER BY k.p) AS t, count(*) AS n FROM k ANTI JOIN cov ON k.r = cov.r AND k.p = cov.p GROUP BY k.r)
SELECT w.doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r""",
    # every kept term of every pair of sources
    "op12_divergence_quadtree": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(*) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM t JOIN l ON t.lang = l.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y
    ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 50""",
}
