"""The jobs as registered queries: each runs its job twice into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemesh.plans.base import PAIRS, query, rounded
from tidemesh.sources import scratch

from . import rolling_correlations, vocabulary_network


@query(f"""WITH {PAIRS} SELECT p.window_id, window_start, window_end, asset_1, asset_2, observations, round(rho, 6) + 0.0 AS rho, round(distance, 6) AS distance
FROM pairs p JOIN windows USING (window_id)""")
def job1_rolling_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.folder(spark)
    for _ in range(2):  # a glob, as a stream takes a single file by no other path
        out = rolling_correlations.run(spark, f"{sf_dir}/lineitem.parquet*", f"{sf_dir}/part.parquet", f"{folder}/out", f"{folder}/stream")
    return rounded(out)


@query("""WITH w AS (SELECT lang AS window_id, source AS asset, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
c AS (SELECT window_id, asset, word, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT *, ln(1e6 * n / words) AS v FROM (SELECT *, sum(n) OVER (PARTITION BY window_id, asset) AS words FROM c) WHERE n >= 2),
pairs AS (SELECT *, sqrt(greatest(2 * (1 - rho), 0)) AS distance FROM (
  SELECT a.window_id, a.asset AS u, b.asset AS v, count(*) AS shared_words, round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 12) AS rho
  FROM s a JOIN s b ON a.window_id = b.window_id AND a.word = b.word AND a.asset < b.asset GROUP BY 1, 2, 3) WHERE rho IS NOT NULL AND sqrt(greatest(2 * (1 - rho), 0)) > 0),
mir AS (SELECT window_id, u AS node, v AS other, distance FROM pairs UNION ALL SELECT window_id, v, u, distance FROM pairs),
near AS (SELECT DISTINCT window_id, least(node, other) AS u, greatest(node, other) AS v
         FROM (SELECT *, row_number() OVER (PARTITION BY window_id, node ORDER BY round(distance, 9), other) AS rn FROM mir) WHERE rn <= 3),
edges AS (SELECT pairs.* FROM pairs JOIN near USING (window_id, u, v)),
inv AS (SELECT window_id, node, sum(1 / sqrt(distance)) AS s FROM (SELECT window_id, u AS node, distance FROM edges UNION ALL SELECT window_id, v, distance FROM edges) GROUP BY ALL),
rc AS (SELECT e.*, 4 - sqrt(distance) * (a.s + b.s) AS ricci FROM edges e JOIN inv a ON e.window_id = a.window_id AND e.u = a.node JOIN inv b ON e.window_id = b.window_id AND e.v = b.node),
ends AS (SELECT window_id, u AS node, v AS neighbour, shared_words, rho, distance, ricci FROM rc UNION ALL SELECT window_id, v, u, shared_words, rho, distance, ricci FROM rc),
m AS (SELECT window_id, node, count(*) AS degree, avg(distance) AS mean_distance, avg(ricci) AS mean_curvature FROM ends GROUP BY ALL),
o AS (SELECT window_id, asset AS node, count(*) AS vocabulary, CAST(sum(n) AS BIGINT) AS words FROM s GROUP BY ALL),
d AS (SELECT lang AS window_id, source AS node, count(*) AS documents FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
SELECT d.window_id AS lang, d.node, documents, coalesce(vocabulary, 0) AS vocabulary, coalesce(words, 0) AS words, coalesce(degree, 0) AS degree, round(mean_distance, 6) AS mean_distance, round(mean_curvature, 6) + 0.0 AS mean_curvature,
       neighbour, shared_words, round(rho, 6) + 0.0 AS rho, round(distance, 6) AS distance, round(ricci, 6) + 0.0 AS ricci
FROM d LEFT JOIN o ON d.window_id = o.window_id AND d.node = o.node LEFT JOIN m ON d.window_id = m.window_id AND d.node = m.node LEFT JOIN ends e ON d.window_id = e.window_id AND d.node = e.node""")
def job2_vocabulary_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.folder(spark)
    for _ in range(2):
        out = vocabulary_network.run(spark, f"{sf_dir}/documents.parquet", folder)
    return rounded(out)
