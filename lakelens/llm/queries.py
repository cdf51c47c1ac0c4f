"""The thin ``opN_<name>`` queries over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm import linecrf, lm, minhash, mixing, packing, rindex, secrets, sharding, tokenfile, topk
from lakelens.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(spark, table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = linecrf.train(docs, table(spark, sf_dir, "labels"))
    return linecrf.score(docs, field)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Its SQL has no count of passages in words, so none is made here.
    found = rindex.remove_repeats(spark, table(spark, sf_dir, "documents"), rindex.Params(words=0))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(spark, table(spark, sf_dir, "documents"))
    return tokenfile.read_digests(spark, manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scans,
        op2_minhash_near_dedup,
        op3_karmarkar_karp_sharding,
        op4_lm_scoring,
        op5_best_fit_packing,
        op6_exact_top_k,
        op7_quality_rules,
        op8_suffix_array_dedup,
        op9_source_mixing,
        op10_token_files,
    )
    return {q.__name__: q for q in every}


_OP6 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), part AS (
  SELECT vec_id, unnest(c) AS x, unnest(range(len(c))) AS i FROM v
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM part q JOIN part d ON q.i = d.i AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p, q FROM common JOIN sizes sp ON sp.doc_id = p JOIN sizes sq ON sq.doc_id = q WHERE 100 * c >= 85 * (sp.n + sq.n - c)
), edges AS (
  SELECT p AS a, q AS b FROM links UNION ALL SELECT q, p FROM links
), reach(node, seen) AS (
  SELECT DISTINCT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen
), comp AS (
  SELECT node, min(seen) AS c FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id
"""

# Bytes as hexadecimal text: two characters a byte.
_OP8 = """
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), w AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 399))) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), step AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step) GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM runs
  UNION ALL SELECT doc_id, max(z), 1000000000 FROM runs GROUP BY doc_id
), kept AS (
  SELECT cuts.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM cuts JOIN d ON d.doc_id = cuts.doc_id GROUP BY cuts.doc_id
), gone AS (
  SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.c, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _OP2, "op6_exact_top_k": _OP6, "op8_suffix_array_dedup": _OP8}
