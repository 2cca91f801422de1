"""Ranked search: trees against a plain scan, the query against DuckDB, odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import queries, wavelet_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """All scores, from the definition."""
    bags = [(d, Counter(fold(t)), len(fold(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for d, bag, n in bags:
            score = 0
            for t in fold(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * n * n_docs // length)))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.mark.parametrize("seed", range(25))
def test_tree_finds_the_best(seed):
    rnd = np.random.default_rng(seed)
    docs, n_terms, k = int(rnd.integers(1, 300)), int(rnd.integers(1, 12)), int(rnd.integers(1, 8))
    held = rnd.random((docs, n_terms)) < rnd.random(n_terms)
    doc, term = np.nonzero(held)
    impact = rnd.integers(0, 5, len(doc))
    tree = wavelet_search.Tree(term, doc, impact, [(0, 7 * d) for d in range(docs)], n_terms)
    own = np.flatnonzero(rnd.random(n_terms) < 0.7)
    weights = rnd.integers(0, 4, len(own))
    top = [(-6, 0, 5)]
    tree.search(own, weights, top, k)
    table = np.zeros((docs, n_terms), int)
    table[doc, term] = impact
    scores = table[:, own] @ weights
    assert top == sorted([(-6, 0, 5), *[(-int(s), 0, 7 * d) for d, s in enumerate(scores) if s > 0]])[:k]


def test_ranges_are_found_by_ranks():
    rnd = np.random.default_rng(3)
    term, doc = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4)
    impact = rnd.integers(1, 1000, 200)
    tree = wavelet_search.Tree(term, doc, impact, [(0, d) for d in range(50)], 4)
    for t in range(4):
        a, b, prefix = int(tree.starts[t]), int(tree.starts[t + 1]), 0
        for level in range(tree.bits):
            node = impact[(term == t) & (doc >> (tree.bits - level) == prefix)]
            assert tree.impact[level][a] == node.max() and b - a == len(node)
            assert (np.diff(tree.impact[level][a:b]) <= 0).all()
            one = (doc[term == t].max() >> (tree.bits - 1 - level)) & 1
            x, y = tree.ones[level][a], tree.ones[level][b]
            a, b = (int(tree.zeros[level] + x), int(tree.zeros[level] + y)) if one else (a - int(x), b - int(y))
            prefix = 2 * prefix + int(one)


def test_bounds_leave_most_nodes_closed():
    rnd = np.random.default_rng(1)
    docs = 4096
    common, rare = np.arange(docs), np.sort(rnd.choice(docs, 20, replace=False))
    doc, term = np.concatenate([common, rare]), np.repeat([0, 1], [docs, 20])
    tree = wavelet_search.Tree(term, doc, rnd.integers(100_000, 200_000, len(doc)), [(0, d) for d in range(docs)], 2)
    top = []
    opened = tree.search(np.array([0, 1]), np.array([1, 9000]), top, 10)
    assert len(top) == 10 and {d for _, _, d in top} <= set(rare.tolist())
    assert opened < docs // 8


ODD_DOCS = [
    (1, "Alpha beta BETA gamma-delta"), (2, None), (3, ""), (None, "alpha beta"), (None, "alpha beta"), (4, "ÀLPHA àlpha ß é_é 42"), (5, "beta " * 5000), (5, "beta gamma"), (6, "alpha beta"),
    (7, "!!! ..."), (8, "x y × İ"), (9, "the the alpha"), (-3, "alpha beta"), (10, "\x7fzeta\x00eta"),
]
ODD_ITEMS = [(1, "alpha BETA beta"), (2, None), (3, "nothing here"), (None, "42 é àlpha"), (1, "gamma"), (4, "x y zeta ETA"), (5, "")]


@pytest.mark.parametrize("settings", [(1 << 19, 1 << 19, 16 << 20), (3, 10, 100)])
def test_odd_rows(spark, monkeypatch, settings):
    postings, chunk, block = settings
    monkeypatch.setattr(wavelet_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(wavelet_search, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(wavelet_search, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(ODD_DOCS, "doc_id int, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").withColumn("_t", F.lit(0))
    assert got(wavelet_search.search(docs, items, k=4)) == brute(ODD_DOCS, ODD_ITEMS, 4)
    assert wavelet_search.search(docs.limit(0), items).count() == 0
    assert wavelet_search.search(docs, items.limit(0)).count() == 0


def test_small_shards_give_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{int(rnd.expovariate(0.05))}" for _ in range(3000)]
    docs = [(d, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for d in range(300)] + [(1000 + d, "w1 w2 w3 w3") for d in range(150)]
    items = [(i, " ".join(rnd.choices(words, k=8))) for i in range(20)] + [(99, "w1 w2 w3")]
    monkeypatch.setattr(wavelet_search, "SHARD_POSTINGS", 500)
    monkeypatch.setattr(wavelet_search, "CHUNK_BYTES", 1000)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(wavelet_search.search(frame, spark.createDataFrame(items, "item_id int, text string"))) == brute(docs, items)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, scale):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '/root/testdata/{scale}/{t}.parquet'")
    want = c.sql(queries.OP12_SQL).fetchall()
    rows = queries.op12_dual_sorted_search(spark, f"/root/testdata/{scale}")
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(rows) == sorted(want, key=repr) and len(want) > 300
