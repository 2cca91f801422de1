"""Chat transcripts: roles by a hidden Markov model, then canonical turns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_remainder

ROLES = ("system", "user", "assistant", "tool")
#: Hidden states: the first line of a turn of each role, then its later lines.
STATES = 2 * len(ROLES)
#: Turns, or lines of a plain transcript, that are decoded together.
TURNS_PER_BLOCK, LINES_PER_BLOCK = 64, 512
#: At most this many conversations are fitted on, the first by a hash of their ids.
SAMPLE = 4000
FOLDS, HELD_OUT = 5, 0
#: Names that open a turn, and the roles they stand for.
MARKERS = {"system": 0, "instruction": 0, "user": 1, "human": 1, "question": 1, "assistant": 2, "ai": 2, "answer": 2, "tool": 3, "function": 3}
_NAMES = "|".join(sorted(MARKERS, key=len, reverse=True))
MARKER = rf"^\s*(?:#{{1,3}} ?|\*\*|\[|<\|)?({_NAMES})(?:\|>|\]:?|:\*\*|:)\s*"
#: Values of a line's symbol: marker (none or a role), blank line before, question, length class, first line.
PARTS = (1 + len(ROLES), 2, 2, 3, 2)
SYMBOLS = (1 + len(ROLES)) * 2 * 2 * 3 * 2


def symbol(line: str, blank_before: str, first: str) -> Column:
    """What the model observes of a line, as one number."""
    name = F.lower(F.regexp_extract(line, "(?i)" + MARKER, 1))
    role = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])[name]
    n = F.length(line)
    out = F.coalesce(role + 1, F.lit(0))
    out = out * 2 + F.col(blank_before).cast("int")
    out = out * 2 + F.rtrim(line).endswith("?").cast("int")
    out = out * 3 + F.when(n < 40, 0).when(n < 200, 1).otherwise(2)
    return (out * 2 + F.col(first).cast("int")).cast("int")


def observed(lines: DataFrame) -> DataFrame:
    """The lines with text of rows (_conv, _block, _line, ..., ordered in their block by _a, _b, _c), with _pos, _gap and _symbol.

    _pos numbers all lines of a block; _gap counts the blank lines between a
    line and the last one with text, null for a block's first. Blank lines
    themselves stay outside the model. Whether a line opens its block's part
    of the transcript or follows a blank line shows in its neighbour, within
    the block; a block's first line counts as opening only in the first block.
    A carriage return at a line's end is part of the line, but not of what is
    observed of it.
    """
    order = Window.partitionBy("_conv", "_block").orderBy("_a", "_b", "_c")
    text = F.trim(F.regexp_replace("_line", r"\s", " ")) != ""
    seen = lines.withColumn("_pos", F.row_number().over(order).cast("long")).withColumn("_said", F.when(text, F.col("_pos")))
    seen = seen.withColumn("_gap", F.col("_pos") - F.max("_said").over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1)
    seen = seen.filter(F.col("_said").isNotNull()).withColumn("_blank", F.coalesce("_gap", F.col("_pos") - 1) > 0).withColumn("_first", F.col("_gap").isNull() & (F.col("_block") == 0))
    return seen.withColumn("_seen", F.regexp_replace("_line", "\r$", "")).withColumn("_symbol", symbol("_seen", "_blank", "_first")).drop("_blank", "_first", "_said", "_b", "_c", "_seen")


@dataclass(frozen=True)
class Model:
    """Log probabilities: of the first state, of the next state, and of each symbol."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        """Smoothed; a turn begins with a first line, and a later line follows a line of its turn.

        A state's symbols are smoothed by one line more: a first line with its
        role's own marker, or a later one without, and otherwise like those of
        all roles. A role that the counts don't have so needs its marker.
        """
        k = len(ROLES)
        s = np.log((start[:k] + 0.5) / (start[:k] + 0.5).sum())
        allowed = np.zeros((STATES, STATES), bool)
        allowed[:, :k] = True
        for r in range(k):
            allowed[r, k + r] = allowed[k + r, k + r] = True
        t = np.where(allowed, step + 0.5, 0.0)
        with np.errstate(divide="ignore"):
            t = np.log(t / t.sum(1, keepdims=True))
        # A symbol's parts are taken as independent given the state, so unseen combinations score by their parts.
        parts = emit.reshape(STATES, *PARTS)
        e = np.zeros(parts.shape)
        for axis in range(1, parts.ndim):
            one = parts.sum(tuple(a for a in range(1, parts.ndim) if a != axis), keepdims=True)
            like = np.concatenate([np.repeat(one[h * k : h * k + k].sum(0, keepdims=True), k, 0) for h in (0, 1)]) + 0.05
            if axis == 1:
                like = np.zeros(one.shape)
                like.reshape(STATES, -1)[np.arange(STATES), np.r_[1 : k + 1, [0] * k]] = 1.0
            one = one + like / like.sum(axis, keepdims=True) + 0.05
            e = e + np.log(one / one.sum(axis, keepdims=True))
        return Model(np.r_[s, np.full(k, -np.inf)], t, e.reshape(STATES, SYMBOLS))

    def through(self, symbols: np.ndarray, first: bool) -> np.ndarray:
        """Best log probability from each state before these lines to each state at their end."""
        m = np.tile(self.start, (STATES, 1)) if first else self.step.copy()
        m = m + self.emit[:, symbols[0]]
        for x in symbols[1:]:
            m = (m[:, :, None] + self.step[None]).max(1) + self.emit[:, x]
        return m

    def path(self, symbols: np.ndarray, first: bool, before: int, last: int) -> np.ndarray:
        """The best states of these lines, given the state before them and the one at their end."""
        score = (self.start if first else self.step[before]) + self.emit[:, symbols[0]]
        back = np.empty((len(symbols), STATES), np.int64)
        for n, x in enumerate(symbols[1:], 1):
            ways = score[:, None] + self.step
            back[n] = ways.argmax(0)
            score = ways.max(0) + self.emit[:, x]
        out = np.empty(len(symbols), np.int32)
        out[-1] = last
        for n in range(len(symbols) - 1, 0, -1):
            out[n - 1] = back[n, out[n]]
        return out


def _runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list[tuple[int, int]]]]:
    """Columns, and the bounds of the runs of equal keys in them, from batches sorted by the keys; a run may span batches."""
    held = None

    def cut(last: bool) -> tuple[dict[str, np.ndarray], list[tuple[int, int]], int]:
        change = np.zeros(len(held), bool)
        change[0] = True
        for k in keys:
            v = held[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = [*np.flatnonzero(change).tolist(), *([len(held)] if last else [])]
        return {c: held[c].to_numpy() for c in held.columns}, list(zip(at[:-1], at[1:], strict=True)), at[-1]

    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        if len(held):
            columns, bounds, end = cut(False)
            if bounds:
                yield columns, bounds
            held = held.iloc[end:].reset_index(drop=True)
    if held is not None and len(held):
        columns, bounds, _ = cut(True)
        yield columns, bounds


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def decode(seen: DataFrame, model: Model) -> DataFrame:
    """Viterbi states of rows (_conv, _block, _pos, _symbol): those rows with _state.

    Max-plus matrices of the blocks are made independently; a scan over a
    conversation's blocks (one small row per block) fixes the states at their
    borders; the blocks are then decoded independently. The result is the
    path that one pass over the whole conversation gives.
    """

    def matrices(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, bounds in _runs(batches, ["_conv", "_block"]):
            heads = [a for a, _ in bounds]
            made = [model.through(c["_symbol"][a:b], bool(c["_first"][a])).ravel().tolist() for a, b in bounds]
            yield pd.DataFrame({"_conv": c["_conv"][heads], "_block": c["_block"][heads], "_m": made})

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, bounds in _runs(batches, ["_conv"]):
            before, at = np.empty(bounds[-1][1], np.int32), np.empty(bounds[-1][1], np.int32)
            for a, b in bounds:
                score, back = np.zeros(STATES), []
                score[1:] = -np.inf  # the state before a conversation doesn't matter
                for m in c["_m"][a:b]:
                    ways = score[:, None] + np.asarray(m).reshape(STATES, STATES)
                    back.append(ways.argmax(0))
                    score = ways.max(0)
                last = int(score.argmax())
                for k in range(b - 1, a - 1, -1):
                    at[k] = last
                    before[k] = last = int(back[k - a][last])
            n = bounds[-1][1]
            yield pd.DataFrame({"_conv": c["_conv"][:n], "_block": c["_block"][:n], "_before": before, "_last": at})

    def paths(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, bounds in _runs(batches, ["_conv", "_block"]):
            states = np.concatenate([model.path(c["_symbol"][a:b], bool(c["_first"][a]), int(c["_before"][a]), int(c["_last"][a])) for a, b in bounds])
            n = bounds[-1][1]
            yield pd.DataFrame({"_conv": c["_conv"][:n], "_block": c["_block"][:n], "_pos": c["_pos"][:n], "_state": states})

    least = seen.groupBy("_conv").agg(F.min("_block").alias("_low"))
    rows = seen.select("_conv", "_block", "_pos", "_symbol").join(least, "_conv").withColumn("_first", F.col("_block") == F.col("_low")).drop("_low")
    keys = ["_conv", "_block"]
    made = _sorted(rows, keys, ["_pos"]).mapInPandas(matrices, "_conv string, _block bigint, _m array<double>")
    ends = _sorted(made, ["_conv"], ["_block"]).mapInPandas(scan, "_conv string, _block bigint, _before int, _last int")
    return _sorted(rows.join(ends, keys), keys, ["_pos"]).mapInPandas(paths, "_conv string, _block bigint, _pos bigint, _state int")


def turns(lines: DataFrame, model: Model, block_lines: int | None = None) -> DataFrame:
    """Turns found in lines (_conv, _block, _line, _a, _b, _c): _conv, _first (the least _a of a turn), role, text, rendered.

    A turn starts at a line in a first-line state. Turns that begin in an
    earlier block are found from one row per block. Blank lines inside a turn
    come back, empty: their number is the gap before a later line. Across
    blocks it follows from the lines that a block has, ``block_lines``; if
    that isn't fixed, blocks end with turns and one blank line stands between.
    """
    seen = checkpointed(observed(lines))
    states = decode(seen, model)
    upto = Window.partitionBy("_conv", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    got = checkpointed(states.withColumn("_own", F.max(F.when(F.col("_state") < len(ROLES), F.col("_pos"))).over(upto)))
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.struct("_block", F.col("_own").alias("_pos"))
    blocks = got.groupBy("_conv", "_block").agg(F.max("_own").alias("_own"), F.max("_pos").alias("_end"))
    number = lambda pos: F.col("_block") * (block_lines or 0) + F.col(pos)
    blocks = blocks.select("_conv", "_block", F.max(F.when(F.col("_own").isNotNull(), opened)).over(before).alias("_carried"), F.max(number("_end")).over(before).alias("_before"))
    starts = got.join(blocks, ["_conv", "_block"]).select("_conv", "_block", "_pos", "_state", "_before", F.coalesce(F.when(F.col("_own").isNotNull(), opened), F.col("_carried")).alias("_start"))
    # Up to here only numbers moved; each line now meets its turn's start, and turns are put together.
    named = seen.drop("_state").join(starts, ["_conv", "_block", "_pos"])
    gap = F.coalesce("_gap", number("_pos") - F.col("_before") - 1 if block_lines else F.lit(1)).cast("int")
    line = F.when(F.col("_state") < len(ROLES), F.regexp_replace("_line", "(?i)" + MARKER, "")).otherwise(F.concat(F.repeat(F.lit("\n"), gap), "_line"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.pmod(F.min("_state"), F.lit(len(ROLES))) + 1)
    parts = F.sort_array(F.collect_list(F.struct("_block", "_pos", line.alias("line"))))
    text = F.rtrim(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"))
    out = named.groupBy("_conv", "_start").agg(F.min("_a").alias("_first"), role.alias("role"), text.alias("text"))
    return out.withColumn("rendered", render(F.col("role"), F.col("text"))).drop("_start")


def render(role: Column, text: Column) -> Column:
    """A turn in canonical form. Control marks inside the text lose their bars."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(text, r"<\|(\w+)\|>", "<$1>"), F.lit("\n<|end|>\n"))


def transcript_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of plain transcripts, one transcript a row: (_conv, _block, _line), ordered by _a, their number."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("_conv"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_n", "_line"))
    n = F.col("_n").cast("long")
    return rows.select("_conv", F.floor(F.col("_n") / LINES_PER_BLOCK).alias("_block"), n.alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_c"), "_line")


def conversation_lines(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations as loosely marked transcripts, with the truth beside: (_conv, _block, _line, _state), ordered by _a (the turn), _b, _c.

    A conversation writes its markers in one of four styles, by its hash; one
    turn in eight, never the first and none whose text begins like a marker,
    has none. A blank line ends a turn. Rows that repeat conversation and turn
    follow each other by role and text. A row without an id is a conversation
    of its own, with a marker; its key has the input partition in it, so that
    equal ones don't gather. Roles other than ROLES are written as users.
    """
    turn, known = F.coalesce(F.col(turn_col).cast("long"), F.lit(0)), F.lower(role_col)
    role = F.when(known.isin(*ROLES), known).otherwise("user")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    alone = F.concat(F.lit("\0"), F.xxhash64(turn, role, text).cast("string"), F.lit(":"), F.spark_partition_id().cast("string"))
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), alone).alias("_conv"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))).alias("_seed"), turn.alias("_turn"), role.alias("_role"), text.alias("_text"))
    # One exchange serves this window and those over (_conv, _block) that follow.
    rows = rows.withColumn("_block", F.floor(F.col("_turn") / TURNS_PER_BLOCK)).repartition("_conv", "_block")
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_conv", "_block", "_turn").orderBy("_role", "_text")) - 1)
    name = F.initcap("_role")
    style = F.pmod(F.col("_seed"), F.lit(4))
    mark = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.when(F.col("_role") == "user", "Human").otherwise(name), F.lit(": ")))
    mark = mark.when(style == 2, F.concat(F.lit("["), "_role", F.lit("] "))).otherwise(F.concat(F.lit("**"), name, F.lit(":** ")))
    bare = (F.pmod(F.xxhash64("_conv", "_turn"), F.lit(8)) == 0) & (F.col("_turn") > 0) & ~F.col("_conv").startswith("\0") & ~F.col("_text").rlike("(?i)" + MARKER)
    written = F.concat(F.when(bare, "").otherwise(mark), "_text", F.lit("\n"))
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("_role")) - 1
    lines = rows.select("_conv", "_block", F.col("_turn").alias("_a"), F.col("_copy").alias("_b"), place.alias("_known"), F.posexplode(F.split(written, "\n")).alias("_c", "_line"))
    state = (F.col("_known") + F.when(F.col("_c") == 0, 0).otherwise(len(ROLES))).cast("int")
    return lines.select("_conv", "_block", "_a", "_b", "_c", "_line", state.alias("_state"))


def fit(df: DataFrame, sample: int = SAMPLE, **columns: str) -> Model:
    """Count states, steps and symbols over a sample of labelled conversations; the driver gets the counts."""
    id_col = columns.get("id_col", "conv_id")
    ids = df.select(F.col(id_col).alias("_i")).distinct().filter(id_remainder("_i", FOLDS) != HELD_OUT)
    ids = F.broadcast(checkpointed(ids.orderBy(F.xxhash64(F.col("_i").cast("string")), "_i").limit(sample)))
    seen = observed(conversation_lines(df.join(ids, df[id_col] == F.col("_i"), "left_semi"), **columns))
    order = Window.partitionBy("_conv", "_block").orderBy("_pos")
    pairs = seen.withColumn("_prev", F.lag("_state").over(order)).groupBy("_block", "_prev", "_state", "_symbol").count()
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    for r in pairs.groupBy((F.col("_block") == 0).alias("b"), "_prev", "_state", "_symbol").agg(F.sum("count").alias("n")).collect():
        emit[r["_state"], r["_symbol"]] += r["n"]
        if r["_prev"] is not None:
            step[r["_prev"], r["_state"]] += r["n"]
        elif r["b"]:
            start[r["_state"]] += r["n"]
    return Model.of_counts(start, step, emit)


def format_conversations(df: DataFrame, model: Model | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Write each conversation as a transcript, recover its turns without the roles, and render them.

    One row per recovered turn: id, first_turn (the number of the turn it
    starts in), role, text, rendered. Defined cases: a row with a null id is a
    conversation of its own, a null turn is 0, a null role or one outside
    ROLES a user's, a null text empty; turns without any text are dropped;
    blank lines inside a text stay, those at its ends go, and one of white
    space alone, a carriage return included, comes back empty; a carriage
    return before a line's end stays; a later line that begins like a marker may
    open a turn of its own; rows that repeat id and turn follow each other;
    any turn number is kept; an empty table gives no rows; other columns are
    ignored.
    """
    columns = {"id_col": id_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    model = model or fit(df, **columns)
    found = turns(conversation_lines(df, **columns).drop("_state"), model)
    ident = F.when(F.col("_conv").startswith("\0"), None).otherwise(F.col("_conv")).cast(df.schema[id_col].dataType)
    return found.select(ident.alias(id_col), F.col("_first").alias("first_turn"), "role", "text", "rendered")


def format_transcripts(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Plain transcripts, one a row, to rows (id as text, first_line, role, text, rendered)."""
    found = turns(transcript_lines(df, id_col, text_col), model, LINES_PER_BLOCK)
    return found.select(F.col("_conv").alias(id_col), F.col("_first").alias("first_line"), "role", "text", "rendered")
