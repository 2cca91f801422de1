"""The registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, bt_quality, chat_hmm, content_dedup, cws, kn_toxicity, mixing, packing, sharding, simhash_bk, warc_merkle, wavelet_search
from .common import table


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bt_quality.classify(docs, bt_quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).drop("copies")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_hmm.format_conversations(table(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_exact_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op8_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica in which every 97th record by crc32 is damaged."""
    pages = table(spark, sf_dir, "pages")
    bad = F.crc32(F.col("page_id").cast("string").cast("binary")) % 97 == 0
    replica = pages.withColumn("html", F.when(bad, F.concat(F.substring("html", 2, 2**31 - 1), F.lit("?"))).otherwise(F.col("html")))
    return warc_merkle.fixity(pages, replica)


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kn_toxicity.classify(docs, kn_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


def op12_dual_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bradley_terry_quality, op2_weighted_fingerprints, op3_source_mixing, op4_chat_formatting, op5_harmonic_packing, op6_exact_content_sort, op7_permutation_sharding, op8_warc_merkle_audit, op9_simhash_bk_trees, op10_kneser_ney_toxicity, op11_dominance_packing, op12_dual_sorted_search)}


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS n FROM d),
u AS (SELECT *, CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || n), 1, 8) AS BIGINT) AS u, length(bin(size)) * 4 + ((size * 4) >> (length(bin(size)) - 1)) - 4 AS bits FROM e),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
             CAST(3 * source_size AS DOUBLE) AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(lim, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('42:start:' || coalesce(source, '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS start FROM t),
g AS (SELECT *, count(*) OVER (PARTITION BY source, bits) > 4096 AS many FROM u),
v AS (SELECT *, CASE WHEN many THEN u // 4194304 ELSE u END AS cell FROM g),
h AS (SELECT source, bits, cell, CAST(count(*) FILTER (WHERE size > 0) AS BIGINT) AS n FROM v GROUP BY 1, 2, 3),
p AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY bits DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM h),
x AS (SELECT v.doc_id, v.size, r.source_size, r.target, floor(r.rate) AS base, r.rate - floor(r.rate) AS f,
             (p.ahead + CASE WHEN v.many THEN CAST(v.u % 4194304 AS DOUBLE) / CAST(4194304 AS DOUBLE) * p.n ELSE 0.0 END) * (r.rate - floor(r.rate)) + r.start AS turn
      FROM v JOIN r ON v.source IS NOT DISTINCT FROM r.source JOIN p ON v.source IS NOT DISTINCT FROM p.source AND v.bits = p.bits AND v.cell = p.cell)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN size > 0 AND turn - floor(turn) < f THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER o = 1 AS kept, sha256(norm) AS text_sha256
      FROM d WINDOW o AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT * FROM w
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS len FROM d WHERE len(terms) > 0),
p AS (SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
i AS (SELECT row_number() OVER () AS query_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
q AS (SELECT query_id, item_id, unnest(terms) AS term FROM i),
s AS (SELECT query_id, item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), size GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": OP3_SQL, "op6_exact_content_sort": OP6_SQL, "op12_dual_sorted_search": OP12_SQL}
