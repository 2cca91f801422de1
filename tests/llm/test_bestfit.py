"""Best-fit packing: dominance reduction against exhaustive search, ids against the tokenizer, places against the contract."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import bestfit

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(None)
def fewest(items: tuple, capacity: int) -> int:
    """Fewest bins, by trying every set that holds the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    seen = set()

    def sets(k: int, room: int, left: list, chosen: tuple) -> None:
        nonlocal best
        if k == len(rest):
            if chosen not in seen:
                seen.add(chosen)
                best = min(best, 1 + fewest(tuple(left), capacity))
            return
        if rest[k] <= room:
            sets(k + 1, room - rest[k], left, (*chosen, rest[k]))
        sets(k + 1, room, [*left, rest[k]], chosen)

    sets(0, capacity - first, [], ())
    return best


def histogram(items, capacity):
    counts = [0] * (capacity + 1)
    for x in items:
        counts[x] += 1
    return counts


@pytest.mark.parametrize("seed", range(150))
def test_reduction_keeps_an_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 20, 30])
    low = rnd.choice([1, 2, capacity // 4])
    items = sorted((rnd.randint(low, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
    counts = histogram(items, capacity)
    fixed = bestfit.reduce_by_dominance(counts, capacity)
    rest = tuple(h for h in range(capacity, 0, -1) for _ in range(counts[h]))
    assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(tuple(items), capacity)
    again = sorted([h for p, n in fixed for h, q in p for _ in range(q * n)] + list(rest), reverse=True)
    assert again == items
    assert all(sum(h * q for h, q in p) <= capacity for p, _ in fixed)


def test_reduction_finds_each_kind():
    # Alone, filling pair, longest partner, pair of partners.
    assert bestfit.dominating(histogram([9, 5], 10), 9, 10) == (9,)
    assert bestfit.dominating(histogram([6, 4, 1, 1], 10), 6, 10) == (6, 4)
    assert bestfit.dominating(histogram([6, 3, 2], 10), 6, 10) == (6, 3)
    assert bestfit.dominating(histogram([10, 5, 4, 4], 20), 10, 20) == (10, 5, 4)
    assert bestfit.dominating(histogram([5, 1, 1, 1, 1, 2], 10), 5, 10) is None


def one_by_one(items, capacity):
    """Best-fit decreasing, an item at a time: the rooms left."""
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_treats_groups_as_single_items(seed):
    rnd = random.Random(seed)
    items = [rnd.choice([1, 2, 3, 7, 11, 25, 40, 64]) for _ in range(rnd.randint(0, 300))]
    bins = bestfit.best_fit(histogram(items, 64), 64)
    assert sorted(64 - sum(h * q for h, q in p) for p, n in bins for _ in range(n)) == one_by_one(items, 64)


def least_bins(counts, capacity):
    """Martello and Toth's bound: pieces that can't share a bin, and what the rest needs beyond the room these leave."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(counts[capacity - a + 1 :])
        halves = range(capacity // 2 + 1, capacity - a + 1)
        over = sum(counts[h] for h in halves)
        small = sum(h * counts[h] for h in range(max(a, 1), capacity // 2 + 1))
        room = sum((capacity - h) * counts[h] for h in halves)
        best = max(best, alone + over + max(0, -(-(small - room) // capacity)))
    return best


def test_plan_is_close_to_the_bound_and_independent_of_size():
    rnd = random.Random(5)
    counts = histogram([rnd.randint(1, 1024) for _ in range(20_000)], 1024)
    for times in (1, 1000):
        bins = bestfit.plan({n: c * times for n, c in enumerate(counts)})
        least = least_bins([c * times for c in counts], 1024)
        assert least <= sum(n for _, n in bins) <= 1.001 * least
        assert len(bins) < 6000


def check(rows, texts, capacity):
    """Pieces cover each document's ids once and sequences from offset 0 without a gap."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, bestfit.END]
        first = len(ids) % capacity or capacity
        for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[start : first if piece == 0 else start + capacity]
            wanted.append((doc, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(wanted, key=key)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


ODD = [
    (1, "Hello  world , it's  a\n\n test   x\u0085 y\x1c z  "), (2, None), (None, "a b"), (None, "a b"), (3, ""), (4, "<|endoftext|> b <|endoftext|>c"), (5, " lead"), (5, "x" * 5000),
    (6, "один два　три 世界 " * 900), (7, "\t"), (8, "tail "), (9, "퟿\U0001f600 é é"), (10, "w " * 40_000),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id int, text string").withColumn("length", F.lit("clash")).withColumn("_part", F.lit(1)).repartition(3)
    got = bestfit.pack(docs, TOKENIZER)
    assert [f.name for f in got.schema] == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.collect()
    check(rows, ODD, 1024)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert bestfit.pack(docs.limit(0), TOKENIZER).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    from tokenizers import Tokenizer

    with open(TOKENIZER, encoding="utf-8") as f:
        known = bestfit.SegmentIds(f.read())
    tokenizer = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(bestfit, "REMEMBERED", 40)
    texts = [t or "" for _, t in ODD[:8]] + [" ".join(f"w{k % 23} {'y' * (k % 120)}" for k in range(n, n + 30)) for n in range(0, 300, 7)]
    for at in range(0, len(texts), 3):
        got = known.ids(texts[at : at + 3])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 3]]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    for parts in (1, 5):
        rows = bestfit.pack(docs.repartition(parts), TOKENIZER, keep_ids=False).collect()
        sequences = check(rows, texts, 1024)
        assert sequences <= 1.01 * sum(r.length for r in rows) / 1024 + 1
    rows = bestfit.pack(docs, TOKENIZER, capacity=64).collect()
    check(rows, texts, 64)
