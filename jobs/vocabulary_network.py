"""Builds the network of text sources whose vocabularies move together.

    python -m jobs.vocabulary_network --documents DIR --output DIR [--config FILE]

The same way from a panel to a filtered network as for returns, with sources
for assets and words for dates: how often a source uses a word, in logarithms,
is correlated over the words that two sources of a language both use; the
correlations become distances, each source keeps its nearest neighbours, and
edges and nodes get their metrics. Under the output folder:

- ``nodes/lang=``: documents, words, vocabulary, degree, mean distance, mean curvature by source
- ``words/lang=``: uses and logarithm of the share by source and word; made once, the other tables are made of it
- ``edges/lang=``: shared words, correlation, distance, curvature by pair of neighbours
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemesh.operators import correlation, graphs

logger = logging.getLogger("vocabulary_network")


def word_shares(documents: DataFrame, least_count: int) -> DataFrame:
    """(window_id, asset, word, n, log_share) of each language's sources: the logarithm of a word's uses in a million words.

    Words are runs of letters, in lower case. Words that a source uses less
    than ``least_count`` times count in its total only.
    """
    words = documents.select(F.col("lang").alias("window_id"), F.col("source").alias("asset"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counts = words.groupBy("window_id", "asset", "word").agg(F.count(F.lit(1)).alias("n"))
    # A sum beside the rows: a join with the totals would count the words of all texts a second time.
    total = counts.withColumn("_words", F.sum("n").over(Window.partitionBy("window_id", "asset")))
    return total.filter(F.col("n") >= least_count).withColumn("log_share", F.ln(1e6 * F.col("n") / F.col("_words"))).drop("_words")


def network(shares: DataFrame, neighbours: int) -> DataFrame:
    """Edges (window_id, u, v, shared_words, rho, distance, ricci) between each source and its nearest."""
    pairs = correlation.distances(correlation.pair_correlations(shares, ["window_id"], date_col="word", value="log_share"))
    near = graphs.forman_ricci(graphs.nearest_neighbours(graphs.complete(pairs), neighbours)).drop("weight", "distance")
    found = pairs.select("window_id", F.col("asset_1").alias("u"), F.col("asset_2").alias("v"), F.col("observations").alias("shared_words"), "rho", "distance")
    return near.join(found, ["window_id", "u", "v"])


def node_metrics(documents: DataFrame, shares: DataFrame, edges: DataFrame) -> DataFrame:
    """Every source that has a document, also without words or neighbours: its sizes, and degree, mean distance and mean curvature of its edges."""
    size = documents.groupBy(F.col("lang").alias("window_id"), F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("documents"))
    own = shares.groupBy("window_id", F.col("asset").alias("node")).agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("words"))
    ends = edges.select("window_id", F.explode(F.array("u", "v")).alias("node"), "distance", "ricci")
    near = ends.groupBy("window_id", "node").agg(F.count(F.lit(1)).alias("degree"), F.avg("distance").alias("mean_distance"), F.avg("ricci").alias("mean_curvature"))
    return size.join(own, ["window_id", "node"], "left").join(near, ["window_id", "node"], "left").fillna(0, ["vocabulary", "words", "degree"])


def write(df: DataFrame, path: str, *by: str) -> None:
    """One table, partitioned by language, in a file for each (of the columns ``by``); it replaces what is there."""
    df.withColumnRenamed("window_id", "lang").repartition("lang", *by).write.mode("overwrite").partitionBy("lang").parquet(path)


WORDS = "asset string, word string, n long, log_share double, lang string"
EDGES = "u string, v string, ricci double, shared_words long, rho double, distance double, lang string"
NODES = "node string, documents long, vocabulary long, words long, degree long, mean_distance double, mean_curvature double, lang string"


def run(spark: SparkSession, documents: str, output: str, neighbours: int = 3, least_count: int = 2) -> DataFrame:
    """Write all tables and return nodes and edges read back, a row for each source and neighbour (null where it has none).

    Documents without language or source are left out, and counted in the
    log; a null text has no words. A rerun replaces all tables with the same.
    """
    texts = spark.read.parquet(documents).select("lang", "source", "text")
    placed = F.col("lang").isNotNull() & F.col("source").isNotNull()
    logger.info("reading %d documents, %d of them without language or source", *texts.agg(F.count(F.lit(1)), F.count(F.when(~placed, 1))).first())
    texts = texts.filter(placed)
    write(word_shares(texts, least_count), f"{output}/words", "asset")
    shares = spark.read.schema(WORDS).parquet(f"{output}/words").withColumnRenamed("lang", "window_id")
    write(network(shares, neighbours), f"{output}/edges")
    edges = spark.read.schema(EDGES).parquet(f"{output}/edges")
    write(node_metrics(texts, shares, edges.withColumnRenamed("lang", "window_id")), f"{output}/nodes")
    nodes = spark.read.schema(NODES).parquet(f"{output}/nodes")
    logger.info("wrote %d sources and %d edges", nodes.count(), edges.count())
    ends = edges.select("lang", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("neighbour")), F.struct(F.col("v").alias("node"), F.col("u").alias("neighbour")))).alias("e"), "shared_words", "rho", "distance", "ricci")
    return nodes.join(ends.select("lang", "e.*", "shared_words", "rho", "distance", "ricci"), ["lang", "node"], "left")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = parser.parse_args()
    spark = SparkSession.builder.appName("vocabulary network").getOrCreate()
    try:
        config = spark.read.option("multiLine", True).json(args.config).first().asDict()
        logging.basicConfig(level=config.pop("log_level", "INFO"), format="%(asctime)s %(name)s %(message)s")
        run(spark, args.documents, args.output, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
