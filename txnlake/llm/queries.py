"""One query for each operator, over the whole of its table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.llm import align, dedup, html_text, mixing, packing, planes, quality, quotes, runs, secrets, sharding, topk, toxicity
from txnlake.llm.common import read
from txnlake.llm.sql_secrets import SECRET_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: In SQL, a word of the query contract.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


MIX_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}')) AS size,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{mixing.NOISE}', '')) AS noise
  FROM documents),
weighed AS (
  SELECT doc_id, source, size,
    CASE WHEN size > 0 THEN greatest(size::DOUBLE / (size + noise), {mixing.LEAST_WEIGHT}::DOUBLE) ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {2**52}::DOUBLE AS u
  FROM docs),
keyed AS (SELECT doc_id, source, size, -ln(u) / weight AS k FROM weighed),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM keyed GROUP BY source),
-- Sources fill in order of 3 * s / w; the first k of them are full for the smallest k that leaves none above.
steps AS (
  SELECT *, row_number() OVER o AS k, 3.0::DOUBLE * s / w AS r,
    sum(s) OVER () - 3 * (sum(s) OVER o - s) AS left_over, sum(w) OVER () - (sum(w) OVER o - w) AS left_weight
  FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT min(k) AS first_free, min_by(left_over, k) AS left_over, min_by(left_weight, k) AS left_weight
  FROM steps WHERE left_over::DOUBLE * w / left_weight <= 3 * s),
goal AS (
  SELECT source, s, CASE WHEN first_free IS NULL OR k < first_free THEN 3.0::DOUBLE * s
    ELSE level.left_over::DOUBLE * w / level.left_weight END AS target
  FROM steps, level),
epochs AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(3, floor(target / s))::BIGINT END AS e FROM goal),
ranked AS (
  SELECT d.doc_id, d.size, g.s, g.target, g.e, g.target - g.s * g.e AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id RANGE UNBOUNDED PRECEDING) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.k, d.doc_id) AS tied
  FROM keyed d JOIN epochs g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (size * (e + CASE WHEN e < 3 AND upto - tied / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked"""


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents")).drop("mark")


@query("op2_quality_mcd")
def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(256 * x) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding::DOUBLE[] IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op3_top_inner_products", TOPK_SQL)
def op3_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read(spark, sf_dir, "documents"))


@query("op5_secret_scan", SECRET_SQL)
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_table(read(spark, sf_dir, "documents"))


@query("op6_pack_best_fit")
def op6_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(read(spark, sf_dir, "documents"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_table(read(spark, sf_dir, "pages"))


@query("op8_shard_ring")
def op8_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op9_id_planes")
def op9_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.id_table(read(spark, sf_dir, "documents"))


@query("op10_quotation_links")
def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(read(spark, sf_dir, "conversations"))


@query("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_table(read(spark, sf_dir, "documents"))


@query("op12_word_runs")
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_table(read(spark, sf_dir, "documents"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
