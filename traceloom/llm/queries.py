"""The corpus operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import langid, lm, mixing, pieces, pipeline, simhash, substring, topk, toxicity, warc, winnow


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents"), window=35)
    return out.select(out["id"].alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_read(spark, sf_dir, "documents"), ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, bits=4).select("doc_id", "fingerprint", "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), folds=5)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"), folds=7, fold=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_toxicity, op2_substring_dedup, op3_sentencepiece, op4_simhash, op5_topk, op6_warc, op7_winnowing, op8_mixing, op9_langid, op10_lm]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


#: DuckDB form of op2: every window of 35 words by its text, then the words that no repeated window covers.
SUBSTRING_ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
pos AS (SELECT k, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
win AS (SELECT k, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM pos),
rep AS (SELECT k, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT k, list(DISTINCT i) AS g FROM (SELECT k, unnest(range(p, p + 35)) AS i FROM rep) GROUP BY k),
words AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
cut AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS t FROM words
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT k AS gk, unnest(g) AS gi FROM gone) AS z WHERE gk = words.k AND gi = words.i) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.k = gone.k LEFT JOIN cut ON d.k = cut.k
"""

#: DuckDB form of op5.
TOPK_ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok AS q JOIN ok AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_ORACLE, "op5_topk": TOPK_ORACLE, "op6_warc": warc.ORACLE, "op8_mixing": mixing.ORACLE}
