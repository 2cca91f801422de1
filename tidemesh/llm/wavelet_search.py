"""Ranked lexical search by dual-sorted wavelet trees, exact for every document."""

from __future__ import annotations

import functools
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, text_or_empty

TOP = 10
#: Postings of one shard's tree, and texts tokenised at a time. They bound a task's memory, not results.
SHARD_POSTINGS = 1 << 19
CHUNK_BYTES = 1 << 19
#: Bytes of the queries that are broadcast together; more queries are answered block by block.
BLOCK_BYTES = 16 << 20
#: Nodes of a tree that are opened together.
WIDTH = 32
#: Tasks whose candidates are ranked together before all are.
FAN_IN = 64
#: Bytes outside of terms, as spaces; of letters only A-Z change case. Bytes of longer code points stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to the score of a document of ``n`` terms, but for its weight; all 64-bit integers."""
    m = 25 + 75 * n.astype(np.int64) * documents // length
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


class Tree:
    """A shard's posting lists as one sequence of documents, sorted twice.

    Lists follow each other by term, each by falling impact. A wavelet tree
    over the documents' numbers splits the sequence bit by bit and keeps its
    order within every node, so a term's postings among a node's documents are
    a range, found by two ranks a level, whose first posting has the greatest
    impact. Impacts are kept with every level: a range's first one bounds what
    the term can add there, and at a leaf is what it adds.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, keys: list[tuple], n_terms: int):
        """``keys`` orders the documents: number d has the d-th smallest."""
        self.keys = keys
        self.bits = max(1, (len(keys) - 1).bit_length())
        order = np.lexsort((doc, -impact, term))
        sequence, impact = doc[order], impact[order].astype(np.int32)
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.size = n = len(sequence)
        self.ones = np.zeros((self.bits, n + 1), np.int32)
        self.zeros = np.zeros(self.bits, np.int64)
        self.impact = np.empty((self.bits + 1, n), np.int32)
        self.impact[0] = impact
        for level in range(self.bits):
            bit = (sequence >> (self.bits - 1 - level)) & 1
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = n - self.ones[level, -1]
            order = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
            sequence = sequence[order]
            self.impact[level + 1] = impact = impact[order]
        self._ones, self._impact = self.ones.ravel(), self.impact.ravel()

    def search(self, own: np.ndarray, weights: np.ndarray, top: list[tuple], k: int) -> int:
        """Merge the shard's documents into ``top``, the best so far as (-score, *key); the number of nodes opened.

        Nodes are opened best bound first and, among equal bounds, smallest
        document first; the search ends when no node can change the k best.
        """
        a, b = self.starts[own], self.starts[own + 1]
        held = b > a
        a, b, w = a[held], b[held], weights[held]
        bound = int((w * self.impact[0][a]).sum()) if len(a) else 0
        if bound <= 0:
            return 0
        number = count()
        heap = [(-bound, *self.keys[0], next(number), 0, 0, a, b, w)]
        opened = 0
        while heap:
            nodes = []
            while heap and len(nodes) < WIDTH and (len(top) < k or heap[0][:3] < top[-1]):
                nodes.append(heappop(heap))
            if not nodes:
                break
            opened += len(nodes)
            levels, prefixes = [x[4] for x in nodes], [x[5] for x in nodes]
            node = np.repeat(np.arange(len(nodes)), [len(x[6]) for x in nodes])
            level = np.array(levels)[node]
            a, b, w = (np.concatenate([x[c] for x in nodes]) for c in (6, 7, 8))
            before, within = self._ones[level * (self.size + 1) + a], self._ones[level * (self.size + 1) + b]
            child = np.concatenate([2 * node, 2 * node + 1])
            ends = np.concatenate([b - within, self.zeros[level] + within])
            begins = np.concatenate([a - before, self.zeros[level] + before])
            held = np.flatnonzero(ends > begins)
            held = held[np.argsort(child[held], kind="stable")]
            child, a, b, w = child[held], begins[held], ends[held], np.concatenate([w, w])[held]
            below = np.concatenate([level, level])[held] + 1
            value = w * self._impact[below * self.size + a]
            cuts = np.flatnonzero(np.diff(child, prepend=-1))
            bounds = np.add.reduceat(value, cuts)
            for x, bound, c, d in zip(child[cuts].tolist(), bounds.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(child)], strict=True):
                deep, prefix = levels[x >> 1] + 1, 2 * prefixes[x >> 1] + (x & 1)
                key = (-bound, *self.keys[prefix << (self.bits - deep)])
                if bound <= 0 or (len(top) >= k and key >= top[-1]):
                    continue
                if deep < self.bits:
                    heappush(heap, (*key, next(number), deep, prefix, a[c:d], b[c:d], w[c:d]))
                else:
                    insort(top, key)
                    del top[k:]
        return opened


class Block:
    """Queries that are answered together: their distinct terms, numbered, and each query's terms with how often it has them."""

    def __init__(self, rows: list[Row]):
        self.numbers: dict[bytes, int] = {}
        self.queries: list[tuple] = []
        for r in rows:
            own = Counter(terms(bytes(r["_t"])))
            at = [self.numbers.setdefault(t, len(self.numbers)) for t in own]
            self.queries.append((r["_q"], r["_item"], np.array(at, np.int64), np.array(list(own.values()), np.int64)))

    def weighted(self, documents: int, df: dict[int, int]) -> list[tuple]:
        """Queries as (number, item, terms, weight times repeats), without terms that add nothing."""
        each = np.array([weight(documents, df[t]) if df.get(t) else 0 for t in range(len(self.numbers))], np.int64)
        out = []
        for q, item, own, times in self.queries:
            held = each[own] > 0
            if held.any():
                out.append((q, item, own[held], (each[own] * times)[held]))
        return out


def chunks(batches: Iterable[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' keys and numbers of terms, and postings (document, term, tf) of the wanted terms."""
    size = max(len(numbers), 1)

    def counted(keys: list, words: list[list[bytes]]) -> tuple:
        n = np.array([len(x) for x in words], np.int64)
        found = np.fromiter(map(numbers.get, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(n)), n)
        held = found >= 0
        pair, tf = np.unique(doc[held] * size + found[held], return_counts=True)
        return keys, n, pair // size, pair % size, tf

    keys, words, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            key, text = key.as_py(), text.as_py()
            keys.append((1, 0) if key is None else (0, key))
            words.append(terms(text))
            held += len(text)
            if held >= CHUNK_BYTES:
                yield counted(keys, words)
                keys, words, held = [], [], 0
    if keys:
        yield counted(keys, words)


def statistics_of(batches: Iterable[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """A partition's document frequencies by term; its documents with terms under -1, their terms under -2."""
    df = np.zeros(len(numbers), np.int64)
    documents = length = 0
    for _, n, _, term, _ in chunks(batches, numbers):
        documents += int((n > 0).sum())
        length += int(n.sum())
        df += np.bincount(term, minlength=len(df))[: len(df)]
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([documents, length, *df[held].tolist()], pa.int64())], names=["term", "n"])


def shards(batches: Iterable[pa.RecordBatch], numbers: dict[bytes, int], documents: int, length: int) -> Iterator[Tree]:
    """Trees over a partition's documents, each of a bounded number of postings (a document's own stay together)."""
    parts: list[tuple] = []
    size = 0

    def tree() -> Tree:
        keys = list(chain.from_iterable(x[0] for x in parts))
        firsts = np.cumsum([0, *[len(x[0]) for x in parts[:-1]]])
        n, doc, term, tf = (np.concatenate([x[c] + (first if c == 2 else 0) for x, first in zip(parts, firsts, strict=True)]) for c in (1, 2, 3, 4))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return Tree(term, place[doc], impacts(tf, n[doc], documents, length), [keys[i] for i in order], len(numbers))

    for part in chunks(batches, numbers):
        parts.append(part)
        size += len(part[2])
        if size >= SHARD_POSTINGS:
            yield tree()
            parts, size = [], 0
    if size:
        yield tree()


def candidates(batches: Iterable[pa.RecordBatch], block: tuple, k: int, id_type: pa.DataType, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A partition's k best documents of each query."""
    numbers, queries, documents, length = block
    tops: list[list[tuple]] = [[] for _ in queries]
    for tree in shards(batches, numbers, documents, length):
        for (_, _, own, weights), top in zip(queries, tops, strict=True):
            tree.search(own, weights, top, k)
    context = TaskContext.get()
    group = (context.partitionId() if context else 0) // FAN_IN
    rows = [(q, item, group, None if null else key, -score) for (q, item, _, _), top in zip(queries, tops, strict=True) for score, null, key in top]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    kinds = (pa.int64(), item_type, pa.int64(), id_type, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["_q", "_item", "_group", "_id", "score"])


def ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each query: (item id, rank, document id, score).

    The first pass counts the corpus and the documents that hold the queries'
    terms. In the second, each task builds trees over its documents' postings
    of those terms, shard after shard, and searches all queries in each, with
    the k best so far as the bound to beat; only a task's k best a query are
    exchanged. Texts are never shuffled or stored. Queries of more than
    ``BLOCK_BYTES`` are answered block by block, each over all documents.

    Defined cases: a null text has no terms; a document that matches nothing,
    or only terms of weight 0, is not returned, so a query may have fewer than
    k rows or none; equal scores are ranked by document id, nulls last; each
    row is a document of its own and each query row a query of its own, also
    under a repeated or null id; no documents or no queries give no rows; other
    columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    sc = spark.sparkContext
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).cast("binary").alias("_t"))
    asked = checkpointed(queries.select(F.monotonically_increasing_id().alias("_q"), F.col(f"`{item_col}`").alias("_item"), text_or_empty(item_text).cast("binary").alias("_t")))
    id_kind, item_kind = rows.schema["_id"].dataType, asked.schema["_item"].dataType
    id_type, item_type = to_arrow_type(id_kind), to_arrow_type(item_kind)
    long = T.LongType()
    out = T.StructType([T.StructField("_q", long), T.StructField("_item", item_kind), T.StructField("_group", long), T.StructField("_id", id_kind), T.StructField("score", long)])

    def answer(block: Block) -> DataFrame:
        numbers = sc.broadcast(block.numbers)

        def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return statistics_of(batches, numbers.value)

        counts = rows.select("_id", "_t").mapInArrow(count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r["term"]: r["n"] for r in counts.collect()}
        documents, length = df.get(-1, 0), df.get(-2, 0)
        shared = sc.broadcast((block.weighted(documents, df), documents, length))

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return candidates(batches, (numbers.value, *shared.value), k, id_type, item_type)

        return rows.mapInArrow(best, out)

    size = asked.agg(F.sum(F.octet_length("_t") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    mine = [asked.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == n) for n in range(blocks)]
    found = functools.reduce(DataFrame.union, [answer(Block(x.collect())) for x in mine]) if mine else spark.createDataFrame([], out)
    best = ranked(ranked(found, ["_q", "_group"], k), ["_q"], k)
    return best.select(F.col("_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
