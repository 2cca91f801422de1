"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice
from math import exp, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .bt_quality import calibrate, labelled_sample
from .common import bounded_batches, checkpointed, id_remainder, text_or_empty

#: The map from likelihoods to scores is fitted on at most this many labelled documents of each class, the first by a hash of their ids.
SAMPLE_PER_CLASS = 4000
#: What one broadcast part of the models holds: n-grams and word pairs. More of them make more parts (``Parts``), none is left out.
MODEL_GRAMS = 400_000
MODEL_PAIRS = 100_000
#: N-grams are dealt to parts by this many hash buckets of the two letters before their last one.
BUCKETS = 4096
#: Letters of text for which a worker takes the parts through once, and letters of new words that it looks up at a time.
FILL, LETTERS = 16_000_000, 400_000
#: Names that a task counts before it hands them on. It bounds memory, not results.
NAMES = 100_000
#: Bitmaps of hashes: rows of 4 KB.
BITMAP_ROWS, _BITS = 2048, 32768
#: Letters of context in the class-conditional models.
ORDER = 6
DISCOUNT = 0.75
#: The share of a toxic text's words that its model draws from the toxic expressions.
SHARE = 0.02
CUT = 0.5
FOLDS, HELD_OUT = 5, 0
#: Word pairs are kept that the toxic class has so often, and so many times as often, pair for pair, as the ordinary one.
PAIR_COUNT, PAIR_RATE = 3, 4
#: The ordinary texts are searched for pairs in so many rounds, each for the pairs that the rounds before leave possible.
ROUNDS = 4
#: One fitted document in so many is left out of the counts at first, to set the map to scores.
TUNE = 3
#: Words a task remembers the score of; beyond it starts anew. It bounds memory, not results.
REMEMBERED = 600_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, order: int = ORDER) -> Iterator[str]:
    """A word's n-grams: each letter, and the end, behind at most order - 1 letters of context within the word."""
    s = f"^{word}$"
    for k in range(1, len(s)):
        yield s[max(0, k - order + 1) : k + 1]


#: One count a word pair in each class: (of the ordinary, of the toxic), and of the words before.
Pairs = dict[tuple[str, str], tuple[int, int]]
Heads = dict[str, tuple[int, int]]


class Model:
    """Two Kneser-Ney models, one per class: words as letter sequences with a shared backoff, and above them word pairs.

    Letters: P_c(x | ctx) = max(n_c(ctx x) - D, 0) / n_c(ctx) + D t_c(ctx) / n_c(ctx) * P(x | shorter ctx)
    where P is the Kneser-Ney recursion over counts of both classes: at each
    lower order a sequence counts once for each longer one that it ends. An
    expression too rare for its own counts thus scores by those of its parts,
    and what neither class has seen scores alike in both. P_c(word) is the
    product over its letters and its end.

    Words: P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + g_c(v) P_c(w), over the
    pairs kept; g_c(v) is what they leave of 1. An expression of several words
    so scores by its own counts, whatever its words do alone.
    """

    def __init__(self, top: dict[int, dict[str, int]], pairs: Pairs | None = None, heads: Heads | None = None, order: int = ORDER, discount: float = DISCOUNT, core: dict[str, int] | None = None):
        """``top``: of each class, 0 and 1, the counts of its words' n-grams; ``heads``: how often the first words of ``pairs`` have a word behind them.

        ``core``: if ``top`` holds only some n-grams, all of those that agree in
        the two letters before the last, the shared counts of all sequences of
        one and two letters (``core_of``). What is said of these n-grams is then
        the same as by a model of all.
        """
        self.order, self.discount = order, discount
        # Shared continuation counts, from the longest sequences down.
        shared: Counter = Counter()
        kept: dict[int, set] = defaultdict(set)
        for g in top[0].keys() | top[1].keys():
            kept[len(g)].add(g)
        for length in range(order, 1 if core is None else 3, -1):
            for g in kept[length]:
                shared[g[1:]] += 1
                kept[length - 1].add(g[1:])
            del kept[length]
        shared.update(core or {})
        total, kinds = defaultdict(float), defaultdict(int)
        for g, n in shared.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        #: The share of a context's mass that its backoff gets, and of the sequences seen their shared probability.
        self.left = {ctx: discount * kinds[ctx] / n for ctx, n in total.items()}
        self.low: dict[str, float] = {"": 1.0 / (max(kinds[""], 1) + 1)}
        for g in sorted(shared, key=len):
            self.low[g] = max(shared[g] - discount, 0.0) / total[g[:-1]] + self.left[g[:-1]] * self.backoff(g[1:])
        # A model is large: what only led to these goes before the next tables are made.
        del kept, shared, total, kinds
        sums = {c: defaultdict(float) for c in (0, 1)}
        seen = {c: defaultdict(int) for c in (0, 1)}
        for c in (0, 1):
            for g, n in top[c].items():
                sums[c][g[:-1]] += n
                seen[c][g[:-1]] += 1

        def spread(c: int, ctx: str) -> float:
            return discount * seen[c][ctx] / sums[c][ctx] if ctx in sums[c] else 1.0

        #: Of a sequence or context, ln P under the ordinary model and what the toxic one has above it.
        self.plain: dict[str, float] = {}
        self.ratio: dict[str, float] = {}
        for ctx in sums[0].keys() | sums[1].keys():
            # A context's key has no letter after it: such a key can't be a sequence, as "\0" isn't a word's letter.
            a, b = spread(0, ctx), spread(1, ctx)
            self.plain[ctx + "\0"], self.ratio[ctx + "\0"] = log(a), log(b / a)
        for g in top[0].keys() | top[1].keys():
            ctx, low = g[:-1], self.backoff(g[1:])
            p = [(max(top[c].get(g, 0) - discount, 0.0) / sums[c][ctx] if ctx in sums[c] else 0.0) + spread(c, ctx) * low for c in (0, 1)]
            self.plain[g], self.ratio[g] = log(p[0]), log(p[1] / p[0])
        self.behind = behind(pairs or {}, heads or {}, discount)

    def backoff(self, g: str) -> float:
        """The shared probability of a sequence's last letter behind the others."""
        p = self.low.get(g)
        if p is None:
            p = self.low[""] if len(g) < 2 else self.left.get(g[:-1], 1.0) * self.backoff(g[1:])
            if len(g) < 2:
                p *= self.left.get("", 1.0)
        return p

    def word(self, word: str) -> float:
        """ln P(word | toxic) - ln P(word | ordinary)."""
        return self.both(word)[1]

    def both(self, word: str) -> tuple[float, float]:
        """ln P(word | ordinary), and what the toxic model has above it."""
        plain = total = 0.0
        for g in grams(word, self.order):
            p, r = self.letter(g)
            plain += p
            total += r
        return plain, total

    def letter(self, g: str) -> tuple[float, float]:
        """The same of an n-gram's last letter behind the others."""
        r = self.ratio.get(g)
        if r is not None:
            return self.plain[g], r
        ctx = g[:-1] + "\0"
        return self.plain.get(ctx, 0.0) + log(self.backoff(g[1:])), self.ratio.get(ctx, 0.0)

    def after(self, head: str, word: str, plain: float, ratio: float) -> tuple[float, float]:
        """What ``word`` gives, behind a first word of pairs that were kept."""
        return after(self.behind[head], word, plain, ratio)


#: Of a first word of pairs: what the pairs leave of 1 in each class, and each second word's own share.
Behind = tuple[float, float, dict[str, tuple[float, float]]]


def behind(pairs: Pairs, heads: Heads, discount: float = DISCOUNT) -> dict[str, Behind]:
    by_head: dict[str, dict[str, tuple[float, float]]] = defaultdict(dict)
    for (v, w), n in pairs.items():
        by_head[v][w] = tuple(max(n[c] - discount, 0.0) / heads[v][c] if heads[v][c] else 0.0 for c in (0, 1))
    return {v: (1.0 - sum(p[0] for p in tails.values()), 1.0 - sum(p[1] for p in tails.values()), tails) for v, tails in by_head.items()}


def after(held: Behind, word: str, plain: float, ratio: float) -> tuple[float, float]:
    a, b, tails = held
    x, y = tails.get(word, (0.0, 0.0))
    p = max(exp(plain), 1e-300)
    p0 = max(x + a * p, 1e-300)
    return log(p0), log(max(y + b * p * exp(min(ratio, 30.0)), 1e-300) / p0)


#: Up to six letters are two integers of three code points each; letters that are not there are zeros at the end.
_LETTER, _TWO = (1 << 21) - 1, (1 << 42) - 1
Packed = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, e, f = letters
    return a << 42 | b << 21 | c, d << 42 | e << 21 | f


def without_last(high: np.ndarray, low: np.ndarray, length: np.ndarray) -> Packed:
    others = ~(_LETTER << 21 * (2 - (length - 1) % 3))
    return np.where(length > 3, high, high & others), np.where(length > 3, low & others, low), length - 1


def without_first(high: np.ndarray, low: np.ndarray, length: np.ndarray) -> Packed:
    return (high & _TWO) << 21 | low >> 42, (low & _TWO) << 21, length - 1


def packed_grams(words: list[str]) -> tuple[Packed, np.ndarray, np.ndarray]:
    """``grams`` of all the words in turn, with the two letters before each one's last and the number of its word."""
    s = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    word, last = np.repeat(np.arange(len(words)), sizes - 1), np.delete(np.arange(len(s)), starts)
    first = np.maximum(starts[word], last - ORDER + 1)
    length = last - first + 1
    high, low = packed([np.where(length > j, s[np.minimum(first + j, len(s) - 1)], 0) for j in range(6)])
    return (high, low, length), np.where(length > 2, s[last - 2], 0) << 21 | s[last - 1], word


class Table:
    """Numbers by letter sequence in sorted arrays, exact: they load fast, and many are looked up at once."""

    def __init__(self, sequences: list[str], default: float, *numbers: dict[str, float], end: str = ""):
        """``numbers``: by sequence with ``end`` behind it."""
        letters = np.array(sequences, dtype="U6").view(np.uint32).reshape(-1, 6).astype(np.int64)
        high, low = packed(list(letters.T))
        (self.high, a), (self.low, b) = np.unique(high, return_inverse=True), np.unique(low, return_inverse=True)
        key = a.astype(np.int64) << 32 | b
        order = np.argsort(key)
        #: What isn't there is found at -1, where the defaults are.
        self.key, self.columns = key[order], np.array([np.append(np.fromiter((of[g + end] for g in sequences), float, len(sequences))[order], default) for of in numbers])

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(high), -1)
        a, b = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1), np.minimum(np.searchsorted(self.low, low), len(self.low) - 1)
        key = a << 32 | b
        n = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.high[a] == high) & (self.low[b] == low) & (self.key[n] == key), n, -1)


class Letters:
    """What ``Model.letter`` says, of many n-grams at once."""

    def __init__(self, model: Model):
        self.grams = Table([g for g in model.ratio if g[-1] != "\0"], 0.0, model.plain, model.ratio)
        self.contexts = Table([g[:-1] for g in model.ratio if g[-1] == "\0"], 0.0, model.plain, model.ratio, end="\0")
        self.low = Table([g for g in model.low if g], 1.0, model.low)
        self.left = Table(list(model.left), 1.0, model.left)
        self.unseen = model.low[""] * model.left.get("", 1.0)

    def __call__(self, high: np.ndarray, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.grams.find(high, low)
        plain, ratio = self.grams.columns[:, n]
        rest = np.flatnonzero(n < 0)
        g = high[rest], low[rest], length[rest]
        a, ratio[rest] = self.contexts.columns[:, self.contexts.find(*without_last(*g)[:2])]
        plain[rest] = a + np.log(self.backoff(*without_first(*g)))
        return plain, ratio

    def backoff(self, high: np.ndarray, low: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, rest = np.ones(len(high)), np.arange(len(high))
        while len(rest):
            n = self.low.find(high, low)
            out[rest] *= np.where((n < 0) & (length < 2), self.unseen, self.low.columns[0, n])
            on = (n < 0) & (length > 1)
            rest, high, low, length = rest[on], high[on], low[on], length[on]
            out[rest] *= self.left.columns[0, self.left.find(*without_last(high, low, length)[:2])]
            high, low, length = without_first(high, low, length)
        return out


class Tails:
    """What ``after`` says, of many words at once."""

    def __init__(self, held: dict[str, Behind]):
        self.heads, self.left = list(held), np.array([h[:2] for h in held.values()], dtype=float).reshape(-1, 2)
        rows = [(n, w, *own) for n, (_, _, tails) in enumerate(held.values()) for w, own in tails.items()]
        self.head, self.words, self.own = np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows], np.array([r[2:] for r in rows], dtype=float).reshape(-1, 2)

    def known(self, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words by ``ids``: each as first word, and the pairs and their shares, sorted."""
        head_of, word = np.full(len(ids), -1), np.array([ids.get(w, -1) for w in self.words], dtype=np.int64)
        for n, v in enumerate(self.heads):
            if v in ids:
                head_of[ids[v]] = n
        found = np.flatnonzero(word >= 0)
        keys = self.head[found] << 32 | word[found]
        order = np.argsort(keys)
        return head_of, np.append(keys[order], -1), np.vstack([self.own[found][order], [(0.0, 0.0)]])

    def __call__(self, known: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray, starts: np.ndarray, plain: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``words``, those behind a first word of pairs: their places, and ``after`` of each. None is at ``starts``, where a text begins."""
        head_of, keys, own = known
        head = np.append(-1, head_of[words[:-1]])[: len(words)]
        head[starts] = -1
        at = np.flatnonzero(head >= 0)
        head, word = head[at], words[at]
        key = head << 32 | word
        n = np.searchsorted(keys[:-1], key)
        x, y = own[np.where(keys[n] == key, n, -1)].T
        a, b = self.left[head].T
        p = np.maximum(np.exp(plain[word]), 1e-300)
        p0 = np.maximum(x + a * p, 1e-300)
        return at, np.log(p0), np.log(np.maximum(y + b * p * np.exp(np.minimum(ratio[word], 30.0)), 1e-300) / p0)


class Parts:
    """The models in parts that are broadcast one by one, each of bounded size, for more n-grams or pairs than one holds.

    All n-grams that agree in the two letters before the last lie in one part,
    and with them all that their probabilities are made of but the shared
    counts of one and two letters, which each part has. Pairs lie with their
    first word. A worker has one part in memory at a time.
    """

    def __init__(self, part_of: list[int], models: list[Broadcast], pairs: list[Broadcast]):
        self.part_of, self.models, self.pairs = part_of, models, pairs

    @classmethod
    def of(cls, model: Model, sc: SparkContext) -> Parts:
        """One model as the only part."""
        return cls([0] * BUCKETS, [sc.broadcast(Letters(model))], [sc.broadcast(Tails(model.behind))])

    @staticmethod
    def each(parts: list[Broadcast]) -> Iterator:
        for part in parts:
            yield part.value
            # This process's copy goes; the part's file stays.
            part.__dict__.pop("_value", None)

    def part(self, before: np.ndarray) -> np.ndarray:
        """The parts of n-grams by the two letters before their last ones."""
        kinds, of = np.unique(before, return_inverse=True)
        names = ["".join(chr(c) for c in (k >> 21, k & _LETTER) if c) for k in kinds.tolist()]
        return np.array([self.part_of[crc32(n.encode()) % BUCKETS] for n in names], dtype=np.int64)[of]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``Model.both`` of each word, the letters of a part at a time."""
        plain, ratio = np.zeros(len(words)), np.zeros(len(words))
        piece = np.cumsum([len(w) + 2 for w in words], dtype=np.int64) // LETTERS
        begins = [*np.flatnonzero(np.diff(piece, prepend=-1)), len(words)]
        for begin, end in zip(begins, begins[1:]):
            (high, low, length), before, word = packed_grams(words[begin:end])
            part = self.part(before)
            order = np.argsort(part, kind="stable")
            until = np.searchsorted(part[order], np.arange(len(self.models) + 1))
            for k, model in enumerate(self.each(self.models)):
                at = order[until[k] : until[k + 1]]
                p, r = model(high[at], low[at], length[at])
                plain[begin:end] += np.bincount(word[at], p, end - begin)
                ratio[begin:end] += np.bincount(word[at], r, end - begin)
        return plain, ratio

    def destroy(self) -> None:
        for part in self.models + self.pairs:
            part.destroy()


class Ids(dict):
    """A number for each word, from 0 in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts in turn, and how many each text has."""
        found = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in texts]
        return np.concatenate([np.zeros(0, dtype=np.int32), *found]), np.array([len(f) for f in found], dtype=np.int64)


@dataclass
class Classifier:
    """The models and the map from a document's likelihoods to a score."""

    model: Model | Parts
    threshold: float = 0.0
    slope: float = 1.0
    scale: float = 1.0

    def __post_init__(self):
        self.memo: dict[str, tuple[float, float, float]] = {}

    def likelihoods(self, text: str) -> tuple[float, float]:
        """ln P(text | ordinary) and ln P(text | toxic), each by the number of words; 0 without words.

        A toxic text is ordinary prose with toxic expressions in it, so its
        model draws a word from the toxic model with probability SHARE and
        from the ordinary one else.
        """
        words, memo, behind = words_of(text), self.memo, self.model.behind
        plain = total = 0.0
        head = None
        for w in words:
            m = memo.get(w)
            if m is None:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                p, r = self.model.both(w)
                m = memo[w] = (p, r, mixed(r))
            if head in behind:
                p, r = self.model.after(head, w, m[0], m[1])
                plain += p
                total += mixed(r)
            else:
                plain += m[0]
                total += m[2]
            head = w
        n = max(len(words), 1)
        return plain / n, (plain + total) / n

    def of_batches(self, batches: Iterable[pd.Series]) -> Iterator[np.ndarray]:
        """``likelihoods`` of each text of each batch, as rows; of ``Parts``, FILL letters of text at a time."""
        ids, known = Ids(), np.zeros((2, 0))
        held, letters = [], 0
        for texts in batches:
            held.append(ids.of(words_of(t) for t in texts))
            letters += sum(map(len, texts))
            if letters >= FILL:
                known = np.hstack([known, self.model.of_words(list(islice(ids, known.shape[1], None)))])
                yield from self._by_parts(held, ids, *known)
                held, letters = [], 0
                if len(ids) > REMEMBERED:
                    ids, known = Ids(), np.zeros((2, 0))
        known = np.hstack([known, self.model.of_words(list(islice(ids, known.shape[1], None)))])
        yield from self._by_parts(held, ids, *known)

    def _by_parts(self, batches: list[tuple[np.ndarray, np.ndarray]], ids: Ids, plain: np.ndarray, ratio: np.ndarray) -> list[np.ndarray]:
        """Of batches of words by ``ids`` and sizes of texts: by text, the sums of what its words give, over their number."""
        gain = mixed(ratio)
        texts = [np.repeat(np.arange(len(sizes), dtype=np.int32), sizes) for _, sizes in batches]
        out = [np.array([np.bincount(text, x[words], len(sizes)) for x in (plain, gain)]) for text, (words, sizes) in zip(texts, batches, strict=True)]
        for tails in self.model.each(self.model.pairs):
            known = tails.known(ids)
            for sums, text, (words, sizes) in zip(out, texts, batches, strict=True):
                at, p, r = tails(known, words, (np.cumsum(sizes) - sizes)[sizes > 0], plain, ratio)
                sums += [np.bincount(text[at], x, len(sizes)) for x in (p - plain[words[at]], mixed(r) - gain[words[at]])]
        return [(sums + [[0.0], [1.0]] * sums[0]).T / np.maximum(sizes, 1).reshape(-1, 1) for sums, (_, sizes) in zip(out, batches, strict=True)]

    def ratio(self, text: str) -> float:
        """By how much the toxic likelihood is the larger one, per word."""
        ordinary, toxic = self.likelihoods(text)
        return toxic - ordinary

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (ratios - self.threshold) / self.scale, -50, 50)))


def mixed(ratio: float | np.ndarray) -> float | np.ndarray:
    """ln of a word's probability in a toxic text over that in an ordinary one."""
    return np.log1p(SHARE * (np.exp(np.minimum(ratio, 30.0)) - 1.0))


#: Fold and label of each count that a row of counts has.
_COLUMNS = [(f, y) for f in (0, 1) for y in (0, 1)]
_NAMES = [f"n{f}{y}" for f, y in _COLUMNS]
_COUNTS = ", ".join(["gram string", *[f"{n} bigint" for n in _NAMES]])


def _table(counts: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
    names = list(set().union(*counts.values()))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([counts[k][g] for g in names], pa.int64()) for k in _COLUMNS]], names=["gram", *_NAMES])


def _full(counts: dict[tuple[int, int], Counter]) -> bool:
    return sum(map(len, counts.values())) >= NAMES


def _count_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (fold, label, text) to counts of their words ("w"), of their last words (" w"), of all their word pairs (" "), and of the toxic class's word pairs ("v w"); one row per name and NAMES of them."""
    found = {k: Counter() for k in _COLUMNS}
    for batch in batches:
        for fold, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            found[fold, label].update(words)
            found[fold, label][" "] += max(len(words) - 1, 0)
            if words:
                found[fold, label][" " + words[-1]] += 1
            if label:
                found[fold, label].update(map(" ".join, zip(words, words[1:])))
        if _full(found):
            yield _table(found)
            found = {k: Counter() for k in _COLUMNS}
    yield _table(found)


def _slot(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The bit that stands for a pair of words, by their CRC-32; ``_slot_of`` is the same of a name."""
    return (head * 1_000_003 + word) % (BITMAP_ROWS * _BITS)


def _slot_of(pair: Column) -> Column:
    head, word = (F.crc32(F.substring_index(pair, " ", n).cast("binary")) for n in (1, -1))
    return F.pmod(head * F.lit(1_000_003) + word, F.lit(BITMAP_ROWS * _BITS))


def _count_pairs(batches: Iterable[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts (fold, label, text) to counts of the word pairs ("v w") whose bit is set; one row per name and NAMES of them."""
    bits = wanted.value
    ids, crcs, found = Ids(), np.zeros(0, dtype=np.int64), {k: Counter() for k in _COLUMNS}

    def named() -> pa.RecordBatch:
        names = list(ids)
        return _table({k: Counter({f"{names[p >> 32]} {names[p & 0xFFFFFFFF]}": n for p, n in c.items()}) for k, c in found.items()})

    for batch in batches:
        fold, label, texts = (c.to_pylist() for c in batch.columns)
        words, sizes = ids.of(words_of(t) for t in texts)
        crcs = np.append(crcs, np.array([crc32(w.encode()) for w in islice(ids, len(crcs), None)], dtype=np.int64))
        text = np.repeat(np.arange(len(sizes)), sizes)
        slot = _slot(crcs[words[:-1]], crcs[words[1:]])
        at = np.flatnonzero((text[:-1] == text[1:]) & (bits[slot >> 3] >> (slot & 7) & 1 == 1))
        pairs, kind = words[at].astype(np.int64) << 32 | words[at + 1], (np.array(fold, dtype=np.int64) * 2 + np.array(label, dtype=np.int64))[text[at]]
        for n, k in enumerate(_COLUMNS):
            names, counts = np.unique(pairs[kind == n], return_counts=True)
            for p, c in zip(names.tolist(), counts.tolist(), strict=True):
                found[k][p] += c
        if _full(found) or len(ids) >= NAMES:
            yield named()
            ids, crcs, found = Ids(), crcs[:0], {k: Counter() for k in _COLUMNS}
    yield named()


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words to counts of their n-grams; one row per n-gram and NAMES of them."""
    found = {k: Counter() for k in _COLUMNS}
    for batch in batches:
        words, *columns = [c.to_pylist() for c in batch.columns]
        for word, *counts in zip(words, *columns, strict=True):
            split, columns_ = list(grams(word)), [(found[k], n) for k, n in zip(_COLUMNS, counts, strict=True) if n]
            for of, n in columns_:
                for g in split:
                    of[g] += n
        if _full(found):
            yield _table(found)
            found = {k: Counter() for k in _COLUMNS}
    yield _table(found)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gram").agg(*[F.sum(n).alias(n) for n in _NAMES])


def counted(labelled: DataFrame) -> DataFrame:
    """Counts of words, of last words, of all pairs and of the toxic class's word pairs, made where the texts are: gram and a column per fold and label."""
    return _summed(labelled.select("fold", "_label", "_text").mapInArrow(_count_texts, _COUNTS))


def letter_grams(counts: DataFrame) -> DataFrame:
    """The n-grams of the words counted: each word is taken apart once, whatever the number of texts."""
    return _summed(counts.filter(~F.col("gram").contains(" ")).select("gram", *_NAMES).mapInArrow(_count_grams, _COUNTS))


def _of_class(y: int) -> Column:
    return F.col(f"n0{y}") + F.col(f"n1{y}")


def buckets(grams_: DataFrame) -> list[int]:
    """The part of each bucket: buckets in order, as many to a part as hold at most MODEL_GRAMS n-grams together. The driver gets one row a bucket."""
    sizes = {r[0]: r[1] for r in grams_.groupBy(_bucket().alias("b")).count().collect()}
    part, room, out = 0, MODEL_GRAMS, []
    for k in range(BUCKETS):
        n = sizes.get(k, 0)
        if n > room and room < MODEL_GRAMS:
            part, room = part + 1, MODEL_GRAMS
        room -= n
        out.append(part)
    return out


def _bucket() -> Column:
    """``gram[-3:-1]``'s bucket."""
    return F.expr(f"pmod(crc32(cast(substring(gram, greatest(length(gram) - 2, 1), least(length(gram) - 1, 2)) as binary)), {BUCKETS})").cast("int")


def core_of(grams_: DataFrame) -> dict[str, int]:
    """The shared counts of sequences of one and two letters: their different longer ones. At most as many as pairs of letters."""
    out = {}
    for n in (2, 1):
        longer = grams_.filter(F.length("gram") > n).select(F.expr(f"right(gram, {n + 1})").alias("g")).distinct()
        out |= {r[0]: r[1] for r in longer.groupBy(F.expr(f"right(g, {n})")).count().collect()}
    return out


#: Of counted names, the toxic class's word pairs that it has often enough.
_FREQUENT = f"gram rlike '. .' and n01 + n11 >= {PAIR_COUNT}"


def telling_pairs(labelled: DataFrame, counts: DataFrame) -> list[tuple[pa.Table, pa.Table]]:
    """The word pairs that the models keep, and their first words; one or more parts by first word.

    A pair is kept if the toxic class has it PAIR_COUNT times and, by its
    number of pairs, PAIR_RATE times as often as the ordinary class; the others' mass
    goes to the words alone. The toxic class's counts are there; the ordinary
    texts are gone through in ROUNDS, a share of them each, and a pair that is
    already too frequent in some of them is sought no further, so few ordinary
    pairs are shuffled and all that are kept have been counted everywhere. A
    bitmap of 8 MB stands for the pairs sought, whatever their number. A
    first word is counted where a word follows: all it has but what ends a
    text. The driver gets about MODEL_PAIRS pairs at a time.
    """
    n0, n1 = _of_class(0), _of_class(1)
    all_ = counts.filter("gram = ' '").agg(F.sum(n0), F.sum(n1)).first()
    ordinary = labelled.filter("_label = 0").select("fold", "_label", "_text")
    kept = counts.filter(_FREQUENT).select("gram", *[F.when(F.lit(n[-1] == "1"), F.col(n)).otherwise(0).alias(n) for n in _NAMES])
    for k in range(ROUNDS):
        bits = np.zeros((BITMAP_ROWS, _BITS // 8), dtype=np.uint8)
        for r in _bitmaps(kept.select(*_placed(_slot_of(F.col("gram")))), _bits="true").collect():
            bits[r["_row"]] = np.frombuffer(r["_bits"], np.uint8)
        wanted = labelled.sparkSession.sparkContext.broadcast(bits.ravel())
        share = ordinary.filter(F.pmod(F.xxhash64("_text"), F.lit(ROUNDS)) == k)
        found = _summed(share.mapInArrow(lambda batches, w=wanted: _count_pairs(batches, w), _COUNTS)).select("gram", *[F.col(n).alias(f"_{n}") for n in _NAMES])
        # The join leaves out pairs that only share a bit with one that is sought.
        both = kept.join(found, "gram", "left").select("gram", *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in _NAMES])
        kept = checkpointed(both.filter(n1 * F.lit(all_[0] or 0) >= (n0 + 1) * F.lit(PAIR_RATE * (all_[1] or 0))))
        wanted.destroy()
    parts = max(1, -(-kept.count() // MODEL_PAIRS))
    head = F.substring_index("gram", " ", 1)
    out = []
    for k in range(parts):
        part = kept.filter(F.pmod(F.xxhash64(head), F.lit(parts)) == k)
        words = counts.filter("gram != ' ' and not gram rlike '. .'").withColumn("_head", F.ltrim("gram")).join(F.broadcast(part.select(head.alias("_head")).distinct()), "_head")
        heads = words.groupBy(F.concat("_head", F.lit(" ")).alias("gram")).agg(*[F.sum(F.when(F.col("gram").startswith(" "), -F.col(n)).otherwise(F.col(n))).alias(n) for n in _NAMES])
        out.append((part.toArrow(), heads.toArrow()))
    return out


def _placed(slot: Column) -> tuple[Column, Column]:
    """A bit's row in a bitmap and place in the row."""
    return F.floor(slot / _BITS).cast("int").alias("_row"), (slot % _BITS).cast("int").alias("_bit")


def _bitmaps(bits: DataFrame, **kinds: str) -> DataFrame:
    """Of bits (_row, _bit), a bitmap of each kind by row: BITMAP_ROWS rows whatever the number of bits. They are dealt by row, so a row is made once."""
    return bits.repartition("_row").groupBy("_row").agg(*[F.expr(f"bitmap_construct_agg(_bit) filter (where {kind})").alias(name) for name, kind in kinds.items()])


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, id_col: str, text_col: str) -> DataFrame:
    """Every labelled document that may be learnt from: (_id, _label, _text). An id's label is its least one; rows that share an id count each.

    Labels may be as many as documents, so the two are joined by a shuffle, of
    the documents' ids alone. What comes of it goes to the texts as bitmaps of
    the ids' hashes, 24 MB whatever their number: one of the ids of each label
    and one of those without. Where one bitmap alone has an id's bit, that says
    its label; the few texts whose ids share a bit with others are joined with
    the labels themselves.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    known = checkpointed(known.filter(allowed).groupBy("_id").agg(F.min("_label").alias("_label")))
    slot = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(BITMAP_ROWS * _BITS))
    row, bit = _placed(slot)
    ids = docs.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull())
    bitmaps = checkpointed(_bitmaps(ids.join(known, "_id", "left").select("_label", row, bit), _0="_label = 0", _1="_label = 1", _none="_label is null"))
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).filter(F.col("_id").isNotNull())

    def has(name: str) -> Column:
        byte = F.conv(F.hex(F.substring(name, F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, F.col("_bit") % 8), F.lit(0))

    marked = texts.select("_id", "_text", row, bit).join(F.broadcast(bitmaps), "_row").select("_id", "_text", has("_0").alias("_0"), has("_1").alias("_1"), has("_none").alias("_none"))
    sure = marked.filter("_0 + _1 = 1 and _none = 0").select("_id", F.col("_1").cast("int").alias("_label"), "_text")
    unsure = marked.filter("_0 + _1 + _none > 1").select("_id", "_text").join(known, "_id").select("_id", "_label", "_text")
    return sure.union(unsure)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Classifier | float:
    """A classifier, or the constant score: 0 without labels or where no labelled text differs from another, the one label if a class has no example.

    Words and word pairs are counted over all labelled documents that may be
    learnt from, n-grams over the words found, so the counts grow with the
    input. All of them enter the models: up to MODEL_GRAMS n-grams and
    MODEL_PAIRS word pairs in one broadcast model, more in ``Parts`` that pass
    the driver one by one. Only the map to scores is fitted on a sample,
    of at most ``per_class`` documents a class (``labelled_sample``).
    """
    bounded_batches(docs.sparkSession)
    allowed = id_remainder("_id", FOLDS) != HELD_OUT
    fold = (F.pmod(F.xxhash64(F.lit("tune"), F.col("_id").cast("string")), F.lit(TUNE)) == 0).cast("int").alias("fold")
    sample = checkpointed(labelled_sample(docs, labels, label_col, allowed, id_col, text_col, per_class).select("_id", fold, "_label", "_text"))
    kinds = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    if len(kinds) < 2:
        return float(next(iter(kinds), 0))
    labelled = labelled_texts(docs, labels, label_col, allowed, id_col, text_col).select(fold, "_label", "_text")
    counts = checkpointed(counted(labelled).filter(f"not gram rlike '. .' or {_FREQUENT}"))
    all_grams = checkpointed(letter_grams(counts))
    part_of, pairs = buckets(all_grams), telling_pairs(labelled, counts)
    one = part_of[-1] == 0 and len(pairs) == 1
    whole = all_grams.toArrow() if one else None

    def of_folds(folds: tuple[int, ...]) -> Model | Parts:
        def counts(table: pa.Table, y: int) -> list[int]:
            return sum(table[f"n{f}{y}"].to_numpy() for f in folds).tolist()

        def top(rows: pa.Table) -> dict[int, dict[str, int]]:
            names = rows["gram"].to_pylist()
            return {y: {g: n for g, n in zip(names, counts(rows, y), strict=True) if n} for y in (0, 1)}

        def two(part: tuple[pa.Table, pa.Table]) -> tuple[Pairs, Heads]:
            kept, heads = (dict(zip(t["gram"].to_pylist(), zip(counts(t, 0), counts(t, 1), strict=True), strict=True)) for t in part)
            return {tuple(g.split(" ")): n for g, n in kept.items()}, {g[:-1]: n for g, n in heads.items()}

        if one:
            return Model(top(whole), *two(pairs[0]))
        send = docs.sparkSession.sparkContext.broadcast
        core = core_of(all_grams.filter(" + ".join(f"n{f}{y}" for f in folds for y in (0, 1)) + " > 0"))
        models = []
        for k in range(part_of[-1] + 1):
            held = [b for b, part in enumerate(part_of) if part == k]
            models.append(send(Letters(Model(top(all_grams.filter(_bucket().between(held[0], held[-1])).toArrow()), core=core))))
        return Parts(part_of, models, [send(Tails(behind(*two(part)))) for part in pairs])

    tune = Classifier(of_folds((0,)))
    tuned = sample.filter("fold = 1").select("_label", _ratio(tune, F.col("_text")).alias("x")).toPandas().sort_values(["_label", "x"])
    if not one:
        tune.model.destroy()
    del tune
    out = Classifier(of_folds((0, 1)))
    if tuned["_label"].nunique() < 2:
        tuned = sample.select("_label", _ratio(out, F.col("_text")).alias("x")).toPandas().sort_values(["_label", "x"])
    x, y = tuned["x"].to_numpy(), tuned["_label"].to_numpy()
    if not np.ptp(x):
        return 0.0
    out.scale = float(x.std()) + 1e-9
    threshold, out.slope = calibrate(x / out.scale, y)
    out.threshold = threshold * out.scale
    return out


def _sent(model: Classifier, spark: SparkSession) -> Classifier:
    """A classifier as tasks get it: in parts that are broadcast."""
    return replace(model, model=Parts.of(model.model, spark.sparkContext)) if isinstance(model.model, Model) else model


def _ratio(model: Classifier, text: Column) -> Column:
    sent = _sent(model, SparkSession.active())

    @pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for both in sent.of_batches(texts):
            yield pd.Series(both[:, 1] - both[:, 0])

    return of(text)


def classify(df: DataFrame, model: Classifier | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text: id, held_out, score, predicted (1 at CUT or more), toxic_loglik and ordinary_loglik per word.

    The score compares the two: it is CUT where they differ by the fitted
    threshold. Defined cases: null text is scored as the empty one, whose
    likelihoods are 0; a null id isn't held out; repeated rows score alike; an
    empty table gives no rows; only the text enters a score.
    """
    rows = df.select(F.col(id_col), F.coalesce(id_remainder(id_col, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("_t"))
    if isinstance(model, float):
        out = rows.select(id_col, "held_out", F.lit(model).alias("score"), F.lit(0.0).alias("toxic_loglik"), F.lit(0.0).alias("ordinary_loglik"))
    else:
        sent = _sent(model, df.sparkSession)

        @pandas_udf("score double, toxic_loglik double, ordinary_loglik double")
        def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for both in sent.of_batches(texts):
                yield pd.DataFrame({"score": sent.scores(both[:, 1] - both[:, 0]), "toxic_loglik": both[:, 1], "ordinary_loglik": both[:, 0]})

        out = rows.select(id_col, "held_out", of("_t").alias("_r")).select(id_col, "held_out", "_r.score", "_r.toxic_loglik", "_r.ordinary_loglik")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int")).select(id_col, "held_out", "score", "predicted", "toxic_loglik", "ordinary_loglik")
