"""Near-duplicate detection by SimHash fingerprints and BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import bounded_batches, checkpointed, id_hash, row_struct, salt_of, text_or_empty
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SALTS = 64
#: Mean number of fingerprints in a shard above which shards are cut finer; any cutting gives the same links.
SHARD = 256
#: A shard of more fingerprints is searched by broadcast trees; the components are the same.
HOT_SHARD = 50_000
#: Fingerprints that the trees of one broadcast hold at most, eight bytes each on the way.
ROUND = 200_000
_CHUNK = 1 << 15


def simhash(text: bytes, width: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, 0 without words; memory is bounded whatever its length.

    Bytes A-Z are lower-cased and words split at ASCII white space, so the
    UTF-8 bytes need no decoding. A bit is set if it is set in over half of
    the shingles' hashes.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = words[k : k + _CHUNK + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width))))
        ones += _ones(np.fromiter(map(digest, grams), np.uint64))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles hashed before, 0 without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        ones += _ones(hashes[k : k + _CHUNK])
    return _majority(ones, len(hashes))


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint as a signed long, for use in any projection."""

    @pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text.cast("binary"))


class BKTree:
    """A BK-tree over 64-bit words that also tracks which of them are linked.

    A child hangs on its parent by their Hamming distance. A search follows
    only edges within the radius of the distance to the parent, and skips a
    subtree all of whose words are known to be linked with the one searched
    for: links there could not join anything new, so a dense cluster costs no
    square of its size.
    """

    def __init__(self, radius: int = RADIUS):
        self.radius = radius
        self.words: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.uniform: list[bool] = []

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def add(self, word: int) -> list[tuple[int, int]]:
        """Insert a word; the links, as index pairs, that joined components."""
        me, radius, found = len(self.words), self.radius, []
        self.words.append(word)
        self.children.append({})
        self.parent.append(me)
        self.uniform.append(True)
        if not me:
            return found
        todo = [0]
        while todo:
            k = todo.pop()
            if self.uniform[k] and self.find(k) == self.find(me):
                continue
            d = (self.words[k] ^ word).bit_count()
            if d <= radius and (a := self.find(k)) != (b := self.find(me)):
                self.parent[max(a, b)] = min(a, b)
                found.append((k, me))
            # Nearest edge last, so that it is followed first.
            todo += [c for e, c in sorted(self.children[k].items(), key=lambda x: -abs(x[0] - d)) if abs(e - d) <= radius]
        k = 0
        while True:
            if self.uniform[k] and self.find(k) != self.find(me):
                self.uniform[k] = False
            d = (self.words[k] ^ word).bit_count()
            if d not in self.children[k]:
                self.children[k][d] = me
                return found
            k = self.children[k][d]

    def near(self, word: int) -> list[int]:
        """One word of each component that has a word within the radius of ``word``, which need not be in the tree."""
        radius, found, todo = self.radius, {}, [0] if self.words else []
        while todo:
            k = todo.pop()
            if self.uniform[k] and self.find(k) in found:
                continue
            d = (self.words[k] ^ word).bit_count()
            if d <= radius:
                found.setdefault(self.find(k), k)
            todo += [c for e, c in self.children[k].items() if abs(e - d) <= radius]
        return list(found.values())


class CheckedTree:
    """A BK-tree over the fingerprints of items 0, 1, ..., whose links a check confirms.

    Leaves hold up to LEAF items and are compared at once; items of one
    fingerprint share a leaf. ``component`` names what is linked. As in
    ``BKTree`` a subtree that is known to be in the item's component is skipped.
    """

    LEAF = 1024

    def __init__(self, words: np.ndarray, component: np.ndarray, radius: int):
        self.words, self.component, self.radius = words, component, radius
        self.items: list[np.ndarray] = [np.empty(self.LEAF, np.int64)]
        self.count = [0]
        #: Of an inner node the fingerprint that its children are dealt by, by their distance from it.
        self.pivot: list[int | None] = [None]
        self.children: list[dict[int, int]] = [{}]
        #: Whether all items below were in one component when the last one came, and one of them.
        self.uniform, self.one = [True], [-1]

    def add(self, me: int, check: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
        """Insert the next item; the links, as pairs of items, that joined components. ``check`` tells which of several items link with one."""
        component, found, word = self.component, [], self.words[me]
        todo = [0] if self.one[0] >= 0 else []
        while todo:
            k = todo.pop()
            if self.uniform[k] and component[self.one[k]] == component[me]:
                continue
            if self.pivot[k] is not None:
                d = (self.pivot[k] ^ int(word)).bit_count()
                # Nearest child last, so that it is followed first.
                todo += [c for e, c in sorted(self.children[k].items(), key=lambda x: -abs(x[0] - d)) if abs(e - d) <= self.radius]
                continue
            items = self.items[k][: self.count[k]]
            far = np.bitwise_count(self.words[items] ^ word)
            near = np.flatnonzero((far <= self.radius) & (component[items] != component[me]))
            rest, step = items[near[np.argsort(far[near], kind="stable")]], 1
            while len(rest):
                part, rest = rest[:step], rest[step:]
                before = len(found)
                for a in part[check(part, me)].tolist():
                    if component[a] != component[me]:
                        component[component == component[a]] = component[me]
                        found.append((a, me))
                if len(found) > before:
                    rest = rest[component[rest] != component[me]]
                step *= 4
        self._insert(me)
        return found

    def _insert(self, me: int) -> None:
        k, word = 0, int(self.words[me])
        while True:
            if self.one[k] < 0:
                self.one[k] = me
            elif self.uniform[k] and self.component[self.one[k]] != self.component[me]:
                self.uniform[k] = False
            if self.pivot[k] is None:
                n = self.count[k]
                if n and n % self.LEAF == 0:
                    items = self.items[k]
                    if (self.words[items[:n]] != word).any():
                        self._split(k)
                        continue
                    if n == len(items):
                        self.items[k] = np.r_[items, np.empty(n, np.int64)]
                self.items[k][n] = me
                self.count[k] = n + 1
                return
            d = (self.pivot[k] ^ word).bit_count()
            if d not in self.children[k]:
                self.children[k][d] = self._leaf()
            k = self.children[k][d]

    def _leaf(self) -> int:
        self.items.append(np.empty(self.LEAF, np.int64))
        self.count.append(0)
        self.pivot.append(None)
        self.children.append({})
        self.uniform.append(True)
        self.one.append(-1)
        return len(self.items) - 1

    def _split(self, k: int) -> None:
        """Make a full leaf of several fingerprints an inner node."""
        items = self.items[k][: self.count[k]]
        pivot = self.words[items[0]]
        far = np.bitwise_count(self.words[items] ^ pivot)
        self.pivot[k], self.items[k], self.count[k] = int(pivot), items[:0], 0
        for d in np.unique(far).tolist():
            c = self.children[k][d] = self._leaf()
            part = items[far == d]
            self.items[c] = np.r_[part, np.empty(-len(part) % self.LEAF, np.int64)]
            self.count[c], self.one[c] = len(part), int(part[0])
            self.uniform[c] = bool((self.component[part] == self.component[part[0]]).all())


def shard_links(words: list[int], nodes: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links of one shard that connect all its pairs within the radius: no more than its words."""
    if len(words) == 2:
        if (words[0] ^ words[1]).bit_count() <= radius:
            yield nodes[0], nodes[1]
    elif len(words) > 2:
        tree = BKTree(radius)
        for word in words:
            for a, b in tree.add(word):
                yield nodes[a], nodes[b]


def _link_batches(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by shard in, links out; a shard may span batches."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    us: list[int] = []
    vs: list[int] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        us.clear()
        vs.clear()
        return out

    def take(shard: np.ndarray, word: np.ndarray, node: np.ndarray, last: bool) -> int:
        """Treats the shards that are whole; returns where the last, maybe unfinished one begins."""
        edges = np.flatnonzero(np.diff(shard)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(shard)]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        several = ends - starts > 1
        for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            for u, v in shard_links(word[a:b].view(np.uint64).tolist(), node[a:b].tolist(), radius):
                us.append(u)
                vs.append(v)
        return int(edges[-1]) if len(edges) else 0

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if len(held[0]):
            at = take(*held, last=False)
            held = [h[at:] for h in held]
        if us:
            yield flush()
    if len(held[0]):
        take(*held, last=True)
    if us:
        yield flush()


def shard_keys(count: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """Blocks into which the 64 bits are cut, so that shards of ``count`` random fingerprints stay small.

    Words within the radius agree in all but ``radius`` blocks, so each is sent
    to one shard for every choice of the agreeing blocks. More blocks mean
    longer keys and more copies; any number finds every link.
    """
    blocks = radius + 1
    while blocks < radius + 4 and count / 2 ** (64 * (blocks - radius) // blocks) > shard:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (u, v) between the rows (node long, _fp long, distinct) that connect all pairs within the radius.

    Each fingerprint goes to its shards by a shuffle; a shard's BK-tree is
    built and searched in the task that receives it. All trees together hold
    every fingerprint, which has no bound, so they aren't broadcast. Those of
    a hot shard, which no task should hold whole, are: cut by hash into pieces
    of bounded size, each a shard for the links within it and a broadcast for
    those to the shard's other fingerprints, which search its tree wherever
    they lie.
    """
    blocks = blocks or shard_keys(nodes.count(), radius)
    edge = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edge[k + 1]) - (1 << edge[k])) for k in range(blocks)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[k] for k in kept)
        keys.append(F.xxhash64(F.lit(n), F.col("_fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    dealt = nodes.select(F.explode(F.array(*keys)).alias("_shard"), "_fp", "node")
    hot = checkpointed(dealt.groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_SHARD))
    total = hot.agg(F.sum("_n")).first()[0]
    if total:
        # Pieces hold half a round on average, so none exceeds it but by a chance too small to meet.
        rounds = -(-2 * total // ROUND)
        piece = F.pmod(F.xxhash64("_fp", F.lit(1)), F.lit(rounds))
        marks = F.broadcast(hot.select("_shard"))
        held = checkpointed(dealt.join(marks, "_shard").withColumn("_piece", piece))
        dealt = dealt.join(marks, "_shard", "left_anti").unionByName(held.select(F.xxhash64("_shard", "_piece").alias("_shard"), "_fp", "node"))
    cool = dealt.repartition("_shard").sortWithinPartitions("_shard", "_fp")
    found = cool.mapInArrow(lambda batches: _link_batches(batches, radius), "u bigint, v bigint")
    if total:
        for k in range(rounds):
            found = found.union(_broadcast_links(held, F.col("_piece") == k, radius))
    return found


def _broadcast_links(held: DataFrame, piece: Column, radius: int) -> DataFrame:
    """Links of rows (_shard, _fp, node) with those of them in ``piece``, whose shards' trees are broadcast and then let go."""
    rows = held.filter(piece).select("_shard", "_fp", "node").toArrow()
    shared = held.sparkSession.sparkContext.broadcast([c.to_numpy() for c in rows.columns])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, word, node = shared.value
        order = np.lexsort((word, shard))
        edges = np.flatnonzero(np.diff(shard[order])) + 1
        trees = {}
        for part in np.split(order, edges) if len(order) else []:
            trees[int(shard[part[0]])] = (tree := BKTree(radius)), node[part]
            for w in word[part].view(np.uint64).tolist():
                tree.add(w)
        for batch in batches:
            us, vs = [], []
            for s, w, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s in trees:
                    tree, nodes = trees[s]
                    for k in tree.near(w & (1 << 64) - 1):
                        us.append(u)
                        vs.append(int(nodes[k]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    found = checkpointed(held.select("_shard", "_fp", "node").mapInArrow(search, "u bigint, v bigint"))
    shared.destroy()
    return found


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each row's component: the columns of ``prints`` (_id, _fp and others), _root and _component.

    A node is a fingerprint, so rows that share an id, or have none, are told
    apart. ``_root`` is the smallest fingerprint of the component and names it;
    ``_component`` is its smallest id, null where no row of it has one. Equal
    fingerprints meet first, in up to SALTS parts each, so copies are one node
    afterwards and no task gathers a hot group. Ids are of any ordered type.
    """
    rows = checkpointed(prints.withColumn("_salt", salt_of("_id", SALTS)))
    parts = rows.groupBy("_fp", "_salt").agg(F.min("_id").alias("_least"))
    nodes = checkpointed(parts.groupBy("_fp").agg(F.min("_least").alias("_least"), F.collect_list("_salt").alias("_salts")))
    found = connected_components(links(nodes.select(F.col("_fp").alias("node"), "_fp"), radius)).select(F.col("node").alias("_fp"), F.col("component").alias("_root"))
    rooted = nodes.join(found, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = rooted.join(least, "_root").select("_fp", "_root", "_component", F.explode("_salts").alias("_salt"))
    return rows.join(named, ["_fp", "_salt"]).select(*prints.columns, "_root", "_component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of each document: id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``radius`` bits.
    Defined cases: null or empty text has fingerprint zero and links like any
    other; rows that repeat an id link through their fingerprints alone; null
    ids link like any other and get the smallest id of their component, or
    null where no row of it has one; an empty table gives no rows; other
    columns are ignored.
    """
    bounded_batches(df.sparkSession)
    prints = df.select(F.col(id_col).alias("_id"), fingerprint(text_or_empty(text_col), width).alias("_fp"))
    return components(prints, radius).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stay, one of each component: the one with the smallest id, null ids last.

    A row is recognised by its id and its text's hash; of texts that share the
    smallest id the one with the least hash stays, of wholly repeated rows one.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    of = components(rows.select("_id", fingerprint(F.col("_t"), width).alias("_fp"), F.xxhash64("_t").alias("_h")), radius)
    best = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_h").alias("h"))).alias("_best")
    kept = of.groupBy("_root").agg(best).select(F.col("_best.id").alias("_id"), F.col("_best.h").alias("_tm_h"))
    return matched(df, kept, id_col, text_col)


def matched(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text hash are those of a row (_id, _tm_h) of ``kept``, each pair once."""
    packed, unpacked = row_struct(df)
    kept = kept.select(id_hash("_id").alias("_g"), F.col("_tm_h").alias("_h"))
    keyed = df.select(packed.alias("_row"), id_hash(id_col).alias("_g"), F.xxhash64(text_or_empty(text_col)).alias("_h"))
    first = Window.partitionBy("_g", "_h").orderBy("_h")
    found = keyed.join(kept, ["_g", "_h"], "left_semi").withColumn("_rank", F.row_number().over(first))
    return found.filter("_rank = 1").select(*unpacked)
