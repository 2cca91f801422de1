"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, row_struct, text_or_empty

WEIGHTS = (5, 2, 1)
#: A mix repeats no document more often than this.
CAP = 3
SEED = 42
#: Documents of a source and size class are told apart by their draws; more than LISTED are counted in CELLS equal cells of these.
LISTED, CELLS = 4096, 1024
#: A plan of more cells than this isn't broadcast but joined by a shuffle; the rows that come out are the same.
BROADCAST_CELLS = 500_000
#: Repeated rows are numbered in runs of this many.
RUN = 4096
#: More repeated keys than this aren't broadcast; the rows that come out are the same.
BROADCAST_REPEATS = 200_000


def draw(id_: Column, digest: Column, ordinal: Column, seed: int = SEED) -> Column:
    """A row's hash-seeded draw, uniform on 0 .. 2^32 - 1, from its id, its text's digest and its number among equal rows."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":"), ordinal.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def digest(text_col: str) -> Column:
    return F.md5(text_or_empty(text_col).cast("binary"))


def size_class(size: Column) -> Column:
    """Four times the number of binary digits plus the two digits after the first: sizes of a class differ by less than a quarter."""
    digits = F.length(F.bin(size))
    return (digits * 4 + F.call_function("shiftright", size * 4, digits - 1) - 4).cast("int")


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The distinct (_id, _source, _digest, _size) with the number _m of their rows, summed before the shuffle."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), digest(text_col).alias("_digest"), words(text_col).alias("_size"))
    return rows.groupBy("_id", "_source", "_digest", "_size").agg(F.count(F.lit(1)).alias("_m"))


def drawn(groups: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row counted, with its draw _u: equal rows are numbered from 0, run by run, so no array grows with them."""
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {RUN}"))))
    last = F.least(F.col("_m") - 1, F.col("_run") * RUN + (RUN - 1))
    each = runs.withColumn("_n", F.explode(F.sequence(F.col("_run") * RUN, last)))
    return each.select("_id", "_source", "_size", draw(F.col("_id"), F.col("_digest"), F.col("_n"), seed).alias("_u"))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Each source's target by water-filling, in closed form over one row per source.

    Sources ordered by cap * size / weight are capped from the front; the level
    (words per unit of weight) after capping the first k rises while sources
    must be capped and falls after, so the answer is its largest value. The
    rows of sources, a name and four numbers each, are sorted in one task.
    """
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    by_need = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    places = F.array(*[F.lit(int(w)) for w in weights])
    return (
        rows.groupBy("_source")
        .agg(F.sum("_size").alias("_source_size"))
        .withColumn("_weight", F.element_at(places, F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))).cast("int") + 1).cast("double"))
        .withColumn("_limit", (F.col("_source_size") * cap).cast("double"))
        .withColumn("_level", (F.sum("_source_size").over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_level", F.max("_level").over(whole))
        .select("_source", "_source_size", F.least("_limit", F.col("_level") * F.col("_weight")).alias("_target"))
    )


def cell_of(u: Column, many: Column) -> Column:
    """The cell of a draw: in a class of many documents one of CELLS equal ones, else the draw itself."""
    return F.when(many, F.floor(u / (2**32 // CELLS))).otherwise(u).cast("long")


def places(rows: DataFrame) -> DataFrame:
    """Per source and size class, where its documents stand: (_x, _bits, _many, _cells: cell of draws -> (documents before, documents in it)).

    A source's documents stand in order of falling size class, within a class
    by their draws; those without words don't count. A class has at most LISTED
    cells here, so a source's running count is bounded work.
    """
    keyed = rows.select("_source", size_class(F.col("_size")).alias("_b"), "_u", (F.col("_size") > 0).cast("long").alias("_one"))
    classes = checkpointed(keyed.groupBy(F.col("_source").alias("_x"), F.col("_b").alias("_bits")).agg((F.count(F.lit(1)) > LISTED).alias("_many")))
    held = F.broadcast(classes) if classes.count() <= BROADCAST_CELLS else classes
    some = keyed.join(held, keyed["_source"].eqNullSafe(held["_x"]) & (keyed["_b"] == held["_bits"])).groupBy("_x", "_bits", "_many", cell_of(F.col("_u"), F.col("_many")).alias("_cell")).agg(F.sum("_one").alias("_n"))
    ahead = Window.partitionBy("_x").orderBy(F.desc("_bits"), "_cell").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).cast("long"))
    entry = F.struct(F.col("_cell"), F.struct(F.col("_before").alias("before"), F.col("_n").alias("n")))
    return some.groupBy("_x", "_bits", "_many").agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))


def start(source: Column, seed: int) -> Column:
    """A source's hash-seeded start, uniform on [0, 1)."""
    key = F.concat(F.lit(f"{seed}:start:"), F.coalesce(source.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per source and size class: the source's size, target, whole copies _base, the extra copy's probability _fraction, its _start, and the class's _cells.

    rate = target / size; every document has floor(rate) copies, and one more
    with probability rate - floor(rate), whatever its size.
    """
    sources = targets(rows, weights, cap)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    sources = sources.withColumn("_base", F.floor(rate)).withColumn("_fraction", rate - F.floor(rate)).withColumn("_start", start(F.col("_source"), seed))
    classes = places(rows)
    return checkpointed(sources.join(classes, sources["_source"].eqNullSafe(classes["_x"])).drop("_x"))


def copies() -> Column:
    """Copies of a row (_size, _u) that carries the plan's columns.

    A document's trial is u = frac(place * fraction + start), place being its
    number in its source. The start is uniform, so u is: it lies below the
    fraction with just that probability. And as places step by one, of any run
    of a source's documents the fraction has a copy, up to one document. In a
    class of many a document's place is drawn within its cell, and the trials
    there spread as independent ones do.
    """
    width = 2**32 // CELLS
    at = F.element_at("_cells", cell_of(F.col("_u"), F.col("_many")))
    place = at["before"] + F.when(F.col("_many"), F.pmod(F.col("_u"), F.lit(width)) / F.lit(float(width)) * at["n"]).otherwise(0.0)
    turn = place * F.col("_fraction") + F.col("_start")
    return (F.col("_base") + F.when((F.col("_size") > 0) & (turn - F.floor(turn) < F.col("_fraction")), 1).otherwise(0)).cast("int")


def with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source and size class; ``sources`` is checkpointed and broadcast if it is counted to be small.

    Beyond that rows are dealt by source, class and cell, so a hot source is many keys.
    """
    keyed = rows.withColumn("_b", size_class(F.col("_size")))
    joined = sources.withColumnRenamed("_source", "_s")
    if (sources.agg(F.sum(F.size("_cells"))).first()[0] or 0) <= BROADCAST_CELLS:
        joined = F.broadcast(joined)
        return keyed.join(joined, keyed["_source"].eqNullSafe(joined["_s"]) & (keyed["_b"] == joined["_bits"])).drop("_s", "_b", "_bits")
    joined = joined.select("*", F.explode(F.map_keys("_cells")).alias("_cell")).withColumn("_cells", F.create_map("_cell", F.element_at("_cells", F.col("_cell"))))
    # A row doesn't know yet how many its class has: it meets the class's cell of either kind.
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), cell_of(F.col("_u"), F.lit(m)).alias("c")) for m in (True, False)]))
    keyed = keyed.withColumn("_at", cells)
    same = keyed["_source"].eqNullSafe(joined["_s"]) & (keyed["_b"] == joined["_bits"]) & (keyed["_at.m"] == joined["_many"]) & (keyed["_at.c"] == joined["_cell"])
    return keyed.join(joined, same).drop("_s", "_b", "_bits", "_at", "_cell")


def mix_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """What a mix takes of each row: id, size, source_size, target, copies, taken.

    Sizes are words. Sources by code point, null last, take the weights in
    turn and share 100 % of all words; a target stops at ``cap`` times its
    source's words and the excess goes to the others by weight. A document is
    emitted floor(rate) times and once more with probability rate - floor(rate).

    Defined cases: null or empty text has size 0; a null source is a source; a
    draw comes from id and text, so rows that share an id have draws of their
    own, and wholly equal rows are numbered and drawn one by one; an empty
    table gives no rows; other columns are ignored.
    """
    rows = checkpointed(drawn(counted(df, id_col, text_col, source_col), seed))
    out = with_plan(rows, plan(rows, weights, cap, seed)).withColumn("_copies", copies())
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def _numbered(keyed: DataFrame, repeats: DataFrame) -> DataFrame:
    """Adds _n, a row's number among the rows of its key; only rows of repeated keys move.

    They are numbered within their key and input partition, and these runs are
    put one behind the other, so one key with a third of all rows isn't one
    task's work. Repeated rows are written once, as a second reading of the
    input needn't deal them to the same partitions.
    """
    keys = ["_key", "_digest"]
    few = repeats.count()
    if not few:
        return keyed.withColumn("_n", F.lit(0).cast("long"))
    repeats = F.broadcast(repeats) if few <= BROADCAST_REPEATS else repeats
    placed = keyed.withColumn("_part", F.spark_partition_id())
    many = checkpointed(placed.join(repeats, keys, "left_semi"))
    runs = many.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_part").orderBy("_size")
    many = many.withColumn("_n", F.row_number().over(here) - 1).join(runs, [*keys, "_part"]).withColumn("_n", F.col("_n") + F.col("_before")).drop("_before")
    single = placed.join(repeats, keys, "left_anti").withColumn("_n", F.lit(0).cast("long"))
    return single.unionByName(many).drop("_part")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mixed rows themselves: all columns of ``df``, each row as often as the mix takes it.

    Cases are those of ``mix_sizes``. Which of the rows that share id, source
    and text is drawn under which number follows the order of the input files.
    """
    groups = checkpointed(counted(df, id_col, text_col, source_col))
    sources = plan(drawn(groups, seed), weights, cap, seed)
    key = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("\0")), F.coalesce(F.col("_source").cast("string"), F.lit("\0")))
    repeats = groups.filter("_m > 1").select(key.alias("_key"), "_digest").distinct()
    packed, unpacked = row_struct(df)
    keyed = df.select(packed.alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), words(text_col).alias("_size"), digest(text_col).alias("_digest"))
    keyed = _numbered(keyed.withColumn("_key", key), repeats).withColumn("_u", draw(F.col("_id"), F.col("_digest"), F.col("_n"), seed))
    out = with_plan(keyed, sources).withColumn("_copies", copies()).filter("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*unpacked)
