"""Best-fit packing of whole documents after Martello and Toth's dominance reduction."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, checkpointed, text_or_empty

CAPACITY = 1024
END = 2
#: Segments a Python worker remembers the ids of, and how long they may be; beyond either they are tokenised anew. It bounds memory, not results.
REMEMBERED = 2_000_000
LONGEST = 80
FLUSH_BYTES = 4 << 20
#: A single space between two visible characters: the tokenizer's pieces never reach across it, so what follows has the same ids in any text.
BREAK = re.compile(r" (?=\S)(?<=\S )")

Pattern = tuple[tuple[int, int], ...]


class SegmentIds:
    """Ids of texts under a byte-level tokenizer, as little-endian unsigned 32-bit bytes.

    A text is cut at single spaces, each of which goes with the segment behind
    it. Segments seen before are looked up; new ones are tokenised together,
    as one run of text, and their ids are parted by the bytes that each id
    stands for.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, n in vocabulary.items():
            self.bytes_of[n] = len(token)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments, each with the space before it."""
        out: dict[str, bytes] = {}
        runs = [segments[k : k + 2048] for k in range(0, len(segments), 2048)]
        for run, ids in zip(runs, self._encode([" " + " ".join(run) for run in runs]), strict=True):
            ends = np.cumsum([1 + len(s.encode()) for s in run])
            cuts = 4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "right")
            raw, at = ids.tobytes(), 0
            for s, cut in zip(run, cuts.tolist(), strict=True):
                out[s] = raw[at:cut]
                at = cut
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids: a lookup a segment, and those not found are learnt together."""
        parted = [BREAK.split(t) for t in texts]
        made = [list(map(self.known.get, islice(segments, 1, None))) for segments in parted]
        gaps: dict[str, list[tuple[list, int]]] = {}
        for segments, own in zip(parted, made, strict=True):
            at = -1
            while True:
                try:
                    at = own.index(None, at + 1)
                except ValueError:
                    break
                gaps.setdefault(segments[at + 1], []).append((own, at))
        again = {s: self.older[s] for s in gaps if s in self.older}
        learnt = again | self._learn([s for s in gaps if s not in again])
        for s, i in learnt.items():
            for own, at in gaps[s]:
                own[at] = i
        if len(self.known) + len(learnt) > REMEMBERED // 2:  # what is still in use comes back from the older half
            self.older, self.known = self.known, {}
        self.known.update((s, i) for s, i in learnt.items() if len(s) <= LONGEST)
        heads = self._encode([segments[0] for segments in parted])
        return [head.tobytes() + b"".join(own) for head, own in zip(heads, made, strict=True)]


_segments: dict[int, SegmentIds] = {}


def segment_ids(tokenizer_json: str) -> SegmentIds:
    """This worker's ids for a tokenizer; kept from task to task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _segments:
        _segments.clear()
        _segments[key] = SegmentIds(tokenizer_json)
    return _segments[key]


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Pieces (start, length) of a document of n ids: one if it fits, else full ones behind a shorter first."""
    first = n % capacity or capacity
    yield 0, first
    for at in range(first, n, capacity):
        yield at, capacity


def _largest(counts: list[int], most: int) -> int:
    """The largest length of at most ``most`` that is left; 0 if none."""
    return next((h for h in range(most, 0, -1) if counts[h]), 0)


def _fitting_smallest(counts: list[int], room: int, most: int = 3) -> int:
    """How many of the smallest pieces fit together, counted up to ``most``."""
    k = 0
    for length in range(1, room + 1):
        for _ in range(min(counts[length], most - k)):
            if length > room:
                return k
            room, k = room - length, k + 1
        if k == most or length > room:
            return k
    return k


def _best_pair(counts: list[int], room: int) -> tuple[int, int]:
    """Two pieces a >= b of the largest sum within ``room``; among such the largest a. (0, 0) if no two fit."""
    best = (0, 0)
    b, lengths = 0, [h for h in range(1, room) if counts[h]]
    for a in reversed(lengths):
        if 2 * a <= sum(best):
            break
        while b < len(lengths) and lengths[b] <= room - a:
            b += 1
        partner = next((lengths[i] for i in range(b - 1, -1, -1) if lengths[i] <= a and (lengths[i] != a or counts[a] > 1)), 0)
        if partner and a + partner > sum(best):
            best = (a, partner)
    return best


def _smallest_above(counts: list[int], b: int, number: int) -> list[int]:
    out: list[int] = []
    for h in range(b + 1, len(counts)):
        out += [h] * min(counts[h], number - len(out))
        if len(out) == number:
            break
    return out


def dominating(counts: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length j that dominates every other feasible set with it, or None where the criterion finds none.

    One set dominates another if each piece of the other can be matched with,
    or split between, pieces of the first that are at least as long; some best
    packing then has the dominating set as a bin. If at most k others fit with
    j: none, j is alone; a partner that fills the bin, or the longest partner
    if k is 1, makes the set; for k = 2 that partner also dominates if it is
    as long as the best pair together, and the best pair does if it holds that
    partner and no two pieces longer than its other one fit.
    """
    counts[j] -= 1
    try:
        room = capacity - j
        k = _fitting_smallest(counts, room)
        if k == 0:
            return (j,)
        partner = _largest(counts, room)
        if k == 1 or partner == room:
            return j, partner
        if k == 2:
            a, b = _best_pair(counts, room)
            if partner >= a + b:
                return j, partner
            if partner == a:
                longer = _smallest_above(counts, b, 2)
                if len(longer) < 2 or sum(longer) > room:
                    return j, a, b
        return None
    finally:
        counts[j] += 1


def reduce_by_dominance(counts: list[int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Fix dominating sets until none is found; ``counts`` (pieces by length) keeps the rest. Bins as (pattern, how many).

    A set found for one piece stays dominating while pieces of its lengths
    last, as fewer pieces leave fewer alternatives; so it is fixed as often as
    that at once, and the work depends on the number of lengths alone.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                found = dominating(counts, j, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(counts[h] // q for h, q in need.items())
                for h, q in need.items():
                    counts[h] -= times * q
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over pieces by length, bins of one pattern treated together; ``counts`` ends empty."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # by the room that is left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, number: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, number))

    for length in range(capacity, 0, -1):
        left, counts[length] = counts[length], 0
        while left:
            at = bisect_right(rooms, length - 1)
            room = rooms[at] if at < len(rooms) else capacity
            pattern, number = ((), left) if at == len(rooms) else bins[room].pop()
            each = min(room // length, left)  # a bin that took one is the best fit for the next
            filled = min(number, left // each)
            left -= filled * each
            if at < len(rooms):
                if number > filled:
                    bins[room].append((pattern, number - filled))
                if not bins[room]:
                    del bins[room], rooms[at]
            put(room - each * length, (*pattern, (length, each)), filled)
    return [x for room in rooms for x in bins[room]]


def merged(bins: list[tuple[Pattern, int]]) -> list[tuple[Pattern, int]]:
    total: Counter[Pattern] = Counter()
    for pattern, number in bins:
        total[pattern] += number
    return sorted(total.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """All bins, as (pattern, how many), for numbers of pieces by length."""
    left = [counts.get(n, 0) for n in range(capacity + 1)]
    return merged(reduce_by_dominance(left, capacity) + best_fit(left, capacity))


def runs(bins: list[tuple[Pattern, int]]) -> np.ndarray:
    """Where the pieces of a length go, by rank: rows (length, first rank, first sequence, pieces a bin, first offset), sorted."""
    rank: Counter[int] = Counter()
    out, sequence = [], 0
    for pattern, number in bins:
        offset = 0
        for length, each in pattern:
            out.append((length, rank[length], sequence, each, offset))
            rank[length] += number * each
            offset += length * each
        sequence += number
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def placed(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences and offsets of pieces with these lengths and ranks."""
    first = np.searchsorted(table[:, 0], length, "left")
    last = np.searchsorted(table[:, 0], length, "right")
    at = np.empty(len(length), np.int64)
    for n in np.unique(length):
        mine = length == n
        a, b = first[mine][0], last[mine][0]
        at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], "right") - 1
    i = rank - table[at, 1]
    return table[at, 2] + i // table[at, 3], table[at, 4] + i % table[at, 3] * length


def tokenised(batches: Iterable[pa.RecordBatch], id_type: pa.DataType, tokenizer_json: str, end: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of a partition's documents; _nth counts those of a length."""
    segments = segment_ids(tokenizer_json)
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    end_bytes, seen = end.to_bytes(4, "little"), Counter()
    names = ["_id", "piece", "start", "length", "ids_crc32", "_part", "_nth", *(["ids"] if keep_ids else [])]
    kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if keep_ids else [])]
    columns: list[list] = [[] for _ in names]
    held = 0

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        for c in columns:
            c.clear()
        return out

    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes, at = np.cumsum([len(x.as_buffer()) for x in texts]), 0
        while at < len(docs):  # about 512 KB of text at a time
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 19), "right")))
            for doc, ids in zip(docs[at:to], segments.ids(texts.slice(at, to - at).to_pylist()), strict=True):
                ids += end_bytes
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, piece, start, length, zlib.crc32(own), part, seen[length], own)
                    seen[length] += 1
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
                    held += 64 + len(own) * keep_ids
                if held >= FLUSH_BYTES:
                    yield emit()
                    held = 0
            at = to
    if columns[0]:
        yield emit()


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenise and pack into few sequences: one row per piece with its place, and on demand its ids (binary, little-endian unsigned 32-bit).

    Only documents of over ``capacity`` ids are cut, into full pieces behind a
    shorter first. Bins depend on the pieces' lengths alone, so the packing is
    planned for the whole table from its counts by length, at most ``capacity``
    numbers: dominating sets first (``dominating``), then best-fit decreasing.
    Pieces of a length are numbered across partitions and take the plan's
    places in that order; no text or piece passes the driver or one task.
    The pieces are materialised once, in the shared folder.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    Defined cases: null text is empty and consists of the end id; repeated rows
    and null ids are packed like any other; an empty table gives no rows; other
    columns are ignored. ``tokenizer_path`` is read on the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = sc.broadcast(f.read())
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType
    arrow = to_arrow_type(kind)
    long, ids = T.LongType(), [T.StructField("ids", T.BinaryType())] * keep_ids
    fields = [("_id", kind), ("piece", T.IntegerType()), ("start", long), ("length", long), ("ids_crc32", long), ("_part", T.IntegerType()), ("_nth", long)]

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tokenised(batches, arrow, shared.value, end, capacity, keep_ids)

    pieces = checkpointed(rows.mapInArrow(tokenise, T.StructType([T.StructField(n, k) for n, k in fields] + ids)))
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = sc.broadcast(runs(plan(by_length, capacity)))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = pieces.join(firsts, ["length", "_part"]).withColumn("_rank", F.col("_first") + F.col("_nth"))
    kept = [F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = ranked.select(*kept, "_rank")
    out = T.StructType([ranked.schema[n] for n in ranked.columns[:-1]] + [T.StructField("sequence_id", long), T.StructField("offset", long)])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, rank = batch.columns
            sequence, offset = placed(batch.column("length").to_numpy(), rank.to_numpy(), table.value)
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, out)
