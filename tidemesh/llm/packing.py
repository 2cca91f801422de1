"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_or_empty

CAPACITY = 4096
END = 2
#: A piece fills its class's slot to at least 1 - 1/SLACK; a longer gap is closed by cutting.
SLACK = 64
#: Words a Python worker remembers the ids of; beyond it starts anew. It bounds memory, not results.
REMEMBERED = 1_000_000
FLUSH_BYTES = 4 << 20
#: Put between words that are tokenised together.
MARK = b"\x1e"

PIECE_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


class WordIds:
    """Ids of words, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins words across it, so a
    text's ids are its words' ids in turn. Words are split at ASCII white space
    only; any other stays inside a word, for the tokenizer to treat.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def learn(self, words: set[bytes]) -> None:
        """Tokenise words not known yet: in lines, with a mark between words at which their ids are parted."""
        odd = [w for w in words if self.mark is None or MARK in w]
        plain = [w for w in words if self.mark is not None and MARK not in w]
        lines = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        between = b" " + MARK + b" "
        for line, made in zip(lines, self._encode([between.join(x).decode() for x in lines]), strict=True):
            ids = np.array(made.ids, "<u4")
            raw, cuts = ids.tobytes(), 4 * np.flatnonzero(ids == self.mark)
            starts, ends = [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]
            self.known.update(zip(line, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        self.known.update(zip(odd, [np.array(e.ids, "<u4").tobytes() for e in self._encode([w.decode() for w in odd])], strict=True))

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; words not known yet are tokenised together for all of them."""
        found, gaps = [], []
        for text in texts:
            words = text.split()
            made = list(map(self.known.get, words))
            at = -1
            while True:
                try:
                    at = made.index(None, at + 1)
                except ValueError:
                    break
                gaps.append((made, at, words[at]))
            found.append(made)
            if len(gaps) > REMEMBERED // 4:
                self._fill(gaps)
        self._fill(gaps)
        return [b"".join(made) for made in found]

    def _fill(self, gaps: list[tuple[list, int, bytes]]) -> None:
        for k in range(0, len(gaps), REMEMBERED // 4):
            part = gaps[k : k + REMEMBERED // 4]
            words = {w for _, _, w in part}
            new = {w for w in words if w not in self.known}
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = words
            self.learn(new)
            for made, at, w in part:
                made[at] = self.known[w]
        gaps.clear()


_words: dict[int, WordIds] = {}


def word_ids(tokenizer_json: str) -> WordIds:
    """This worker's word ids for a tokenizer; kept from task to task."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _words:
        _words.clear()
        _words[key] = WordIds(tokenizer_json)
    return _words[key]


def cuts(rest: int, capacity: int = CAPACITY, slack: int = SLACK) -> Iterator[tuple[int, int]]:
    """Pieces (class, length) of a rest shorter than the capacity.

    Class m holds pieces of at most capacity // m, m to a bin. A rest that
    nearly fills its class's slot goes there whole; else the next class's slot
    is cut off, which it fills exactly, and the remainder is treated alike.
    """
    while rest:
        m = capacity // rest
        if capacity // m - rest <= capacity // m // slack:
            yield m, rest
            return
        yield m + 1, capacity // (m + 1)
        rest -= capacity // (m + 1)


class Packer:
    """One worker's bins. Each closed sequence is a list of pieces (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK):
        self.capacity, self.slack = capacity, slack
        self.open: dict[int, list] = {}

    def add(self, doc, ids: bytes) -> Iterator[list]:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            yield [(doc, at, ids[4 * at : 4 * (at + self.capacity)], n)]
        at = whole
        for m, length in cuts(n - whole, self.capacity, self.slack):
            pieces = self.open.setdefault(m, [])
            pieces.append((doc, at, ids[4 * at : 4 * (at + length)], n))
            at += length
            if len(pieces) == m:
                yield self.open.pop(m)

    def rest(self) -> Iterator[list]:
        """Bins still open at the end: their pieces, class by class, as one stream cut at the capacity.

        What remains after the last full sequence is cut into sequences of
        lengths that are powers of two, which need no padding.
        """
        room, now = self.capacity, []
        left = sum(len(p[2]) // 4 for m in self.open for p in self.open[m])
        room = self._room(left)
        for m in sorted(self.open):
            for doc, start, ids, n in self.open[m]:
                while ids:
                    take = min(room, len(ids) // 4)
                    now.append((doc, start, ids[: 4 * take], n))
                    start, ids, room, left = start + take, ids[4 * take :], room - take, left - take
                    if not room:
                        yield now
                        now, room = [], self._room(left)
        self.open.clear()

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


def _chunks(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
    """A batch's ids and texts, about ``size`` bytes at a time."""
    docs, texts, held = [], [], 0
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        docs.append(doc.as_py())
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= size:
            yield docs, texts
            docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def pack_batches(batches: Iterable[pa.RecordBatch], id_type: pa.DataType, id_col: str, tokenizer_json: str, end: int, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    words, packer = word_ids(tokenizer_json), Packer(capacity, slack)
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    end_bytes = end.to_bytes(4, "little")
    columns: list[list] = [[] for _ in range(len(PIECE_FIELDS) + 1)]
    held = 0
    names = [id_col, *[n for n, _ in PIECE_FIELDS]]
    kinds = [id_type, *[k for _, k in PIECE_FIELDS]]

    def emit() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        for c in columns:
            c.clear()
        held = 0
        return out

    def close(pieces: list) -> None:
        nonlocal held, sequence
        offset = 0
        for doc, start, ids, n in pieces:
            length = len(ids) // 4
            for c, v in zip(columns, (doc, start, length, n, sequence, offset, ids), strict=True):
                c.append(v)
            offset += length
            held += len(ids) + 64
        sequence += 1

    for batch in batches:
        for docs, texts in _chunks(batch):
            for doc, ids in zip(docs, words.ids(texts), strict=True):
                for pieces in packer.add(doc, ids + end_bytes):
                    close(pieces)
                    if held >= FLUSH_BYTES:
                        yield emit()
    for pieces in packer.rest():
        close(pieces)
        if held >= FLUSH_BYTES:
            yield emit()
    if held:
        yield emit()


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Tokenise and pack: one row per piece with its ids (binary, little-endian unsigned 32-bit).

    Each worker fills its own bins from the rows of its partition, so nothing
    is shuffled; it holds at most one open bin a class. A sequence's id holds
    the partition's number, so a task that runs again gives the same rows.

    Returns id, start, length, doc_tokens, sequence_id, offset, ids. Defined
    cases: null text is empty and consists of the end id; repeated rows and
    null ids are packed like any other; an empty table gives no rows; other
    columns are ignored. ``tokenizer_path`` is read on the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).cast("binary").alias("_t"))
    kind = rows.schema["_id"].dataType
    arrow = to_arrow_type(kind)
    out = T.StructType([T.StructField(id_col, kind), *[T.StructField(n, T.LongType()) for n, _ in PIECE_FIELDS[:-1]], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_batches(batches, arrow, id_col, shared.value, end, capacity, slack)

    return rows.mapInArrow(run, out)


def padding(used: int, capacity: int = CAPACITY) -> int:
    """Ids of padding that a sequence needs: none at a power of two, else up to the capacity."""
    return 0 if used & (used - 1) == 0 else capacity - used
