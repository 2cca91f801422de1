"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, text_or_empty

#: Samples in a fingerprint, 16 bits (four hex digits) each.
SAMPLES = 52
#: Samples drawn in one row: code for more is longer than the JVM compiles well.
TOGETHER = 4
#: Documents of one partition, about.
TEXTS = 1000
#: Repeated rows are given back in runs of this many.
RUN = 4096
#: The signature of a text without words.
EMPTY = "0000"


def _draws(k: int, base: str) -> list[Column]:
    """A sample's random numbers of a term: gamma r, ln of gamma c (plus 128), uniform b, and 16 bits of a hash; the sample's number is base + k."""
    h1, h2 = f"xxhash64(_term, 2 * ({base} + {k}))", f"xxhash64(_term, 2 * ({base} + {k}) + 1)"
    two_32, two_21 = "4294967295", "2097151"
    gamma = "-ln(({a} + 0.5D) * ({b} + 0.5D) * {scale}D)"
    r = gamma.format(a=f"({h1} & {two_32})", b=f"shiftrightunsigned({h1}, 32)", scale=2.0**-64)
    c = gamma.format(a=f"({h2} & {two_21})", b=f"(shiftrightunsigned({h2}, 21) & {two_21})", scale=2.0**-42)
    b = f"(shiftrightunsigned({h2}, 42) + 0.5D) * {2.0**-22}D"
    return [F.expr(r).alias(f"r{k}"), F.expr(f"ln({c}) + 128.0D").alias(f"c{k}"), F.expr(b).alias(f"b{k}"), F.expr(f"cast({h1} & 65535 as double)").alias(f"h{k}")]


def _sample(weight_ln: str, k: int) -> Column:
    """The term and level whose ln(a) is least in a sample, with 16 bits that name both.

    With t = floor(ln S / r + b) and ln y = r (t - b), ln a = ln c - ln y - r.
    All is done in doubles, which need no casts: ln a + 128, positive, in steps
    of 2^-24, times 2^16, plus the 16 bits, 48 bits together, so a minimum finds
    it. floor is rint of a half less; of x / 2^16 it is exact for whole x. A
    null weight (the term is absent) gives null, which min skips.
    """
    t = f"rint({weight_ln} / r{k} + (b{k} - 0.5D))"
    name = f"(h{k} + {t} * 40503.0D)"
    a = f"rint((c{k} - r{k} * ({t} - b{k} + 1.0D)) * {2.0**24}D)"
    return F.min(F.expr(f"{a} * 65536.0D + ({name} - 65536.0D * rint({name} * {2.0**-16}D - 0.49999D))"))


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES, kept: dict[str, Column] | None = None) -> DataFrame:
    """Fingerprints from rows (keys, _term, weights): one array column ``_fp_<weight>`` per weight column.

    Rows must be unique by keys and term. A term's random numbers come from its
    hash and the sample's number alone, so equal weighted sets agree in every
    sample and the chance of agreement in one is sum(min) / sum(max) of the weights.
    A weight of 0 is absence. ``kept`` adds aggregates over other columns of ``terms``.

    Samples are drawn TOGETHER at a time, each part over a copy of the rows:
    the generated code for more in one row runs slower.
    """
    kept = kept or {}
    others = [c for c in terms.columns if c not in (*keys, *weights)]
    parts = -(-samples // TOGETHER)
    each = -(-samples // parts)
    logs = [F.ln(F.col(w).cast("double")).alias(f"_ln_{w}") for w in weights]
    split = terms.select(*keys, *others, *logs, F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("_part"))
    drawn = split.select(*keys, *others, "_part", *[f"_ln_{w}" for w in weights], *[c for k in range(each) for c in _draws(k, f"_part * {each}")])
    least = [_sample(f"_ln_{w}", k).alias(f"_{w}_{k}") for w in weights for k in range(each)]
    made = drawn.groupBy(*keys, "_part").agg(*least, *[c.alias(n) for n, c in kept.items()])

    def array(w: str) -> Column:
        return F.array(*[F.coalesce(F.pmod(F.col(f"_{w}_{k}"), F.lit(65536.0)), F.lit(-1.0)).cast("int") for k in range(each)])

    made = made.select(*keys, "_part", *kept, *[array(w).alias(f"_fp_{w}") for w in weights])
    whole = [F.slice(F.flatten(F.array(*[F.max(F.when(F.col("_part") == p, F.col(f"_fp_{w}"))) for p in range(parts)])), 1, samples).alias(f"_fp_{w}") for w in weights]
    return made.groupBy(*keys).agg(*[F.max(n).alias(n) for n in kept], *whole)


def likeness(a: str, b: str) -> Column:
    """The share of samples in which two fingerprints agree; 1 for two texts without words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def hex_of(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.when(x < 0, F.lit(EMPTY)).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))), "")


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of each text over its words weighted by their counts: keys, fingerprint.

    Rows that share their keys are taken as one text. Null or empty text has
    the all-zero fingerprint.
    """
    words = df.select(*keys, F.explode(F.split(text_or_empty(text_col), SPACE + "+")).alias("_w"))
    terms = words.groupBy(*keys, F.when(F.col("_w") != "", F.xxhash64("_w")).alias("_term")).agg(F.when(F.col("_term").isNotNull(), F.count(F.lit(1))).alias("w"))
    return signatures(terms, keys, ["w"], samples).select(*keys, hex_of("_fp_w").alias("fingerprint"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Each distinct document with its neighbours in ascending id: (_g, _h, _id, _m, _next_g, _next_h, _prev_g, _prev_h, _prev_n).

    ``rows`` has _g and _h, hashes of id and text, _id and _n, the length; _m
    counts the rows of a document, before the shuffle. Only
    these, never texts, are range-partitioned; windows run within a partition
    and the partitions' ends are joined from a table with one row per
    partition. The last document's next is the first.
    """
    one = rows.groupBy("_id", "_g", "_h").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    ordered = one.repartitionByRange(F.col("_id").asc_nulls_last(), F.col("_h")).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_last(), F.col("_h"))
    me = F.struct("_g", "_h", "_n", "_m")
    placed = checkpointed(ordered.select("_part", "_id", me.alias("_me"), F.lag(me).over(here).alias("_prev"), F.lead(me).over(here).alias("_next")))
    heads = placed.filter("_prev is null").select("_part", F.col("_me").alias("_head"))
    tails = placed.filter("_next is null").select("_part", F.col("_me").alias("_tail"))
    across = Window.orderBy("_part")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = heads.join(tails, "_part").select(
        "_part",
        F.coalesce(F.lag("_tail").over(across), F.last("_tail").over(whole)).alias("_before"),
        F.coalesce(F.lead("_head").over(across), F.first("_head").over(whole)).alias("_after"),
    )
    joined = placed.join(F.broadcast(ends), "_part").withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    sides = [F.col(f"_{side}.{c}").alias(f"_{side}{c}") for side, cs in (("next", ("_g", "_h")), ("prev", ("_g", "_h", "_n"))) for c in cs]
    return joined.select("_me._g", "_me._h", "_id", "_me._m", *sides)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text keeps the first n - floor(n / 2) code points and goes on
    with the first floor(n / 2) of the next document. A text is shuffled once,
    and its prefix once more to the document before it. Words and their counts
    in both texts are made and aggregated within the task that holds the row.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Defined cases: null text is empty; two texts
    without words have likeness 1; a lone document is its own next; null ids
    come last; rows that share an id but not a text follow each other by the
    text's hash; rows that repeat both take one place and each keeps its
    result row; an empty table gives no rows; other columns are ignored.
    """
    keyed = df.select(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))).alias("_g"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    keyed = keyed.withColumn("_h", F.xxhash64("_text"))
    near = checkpointed(neighbours(keyed.select("_g", "_h", "_id", F.length("_text").alias("_n"))))
    # All that follows up to the fingerprints is partitioned by (_g, _h): a text is exchanged once and a prefix once.
    # Partitions hold about TEXTS documents, so that their words' counts fit in memory.
    spread = min(max(near.count() // TEXTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    keys = ["_g", "_h"]
    texts = keyed.select(*keys, "_text")
    if not near.filter("_m > 1").isEmpty():
        # Only where rows repeat id and text: one stays of each input partition, then one of these.
        for by in ([*keys, "_part"], keys):
            texts = texts.withColumn("_part", F.spark_partition_id()) if "_part" in by else texts
            texts = texts.withColumn("_copy", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).filter("_copy = 1")
        texts = texts.select(*keys, "_text")
    links = near.select(*keys, "_prev_g", "_prev_h", "_prev_n")
    full = texts.repartition(spread, *keys).join(links.hint("shuffle_merge"), keys)
    heads = full.select(F.col("_prev_g").alias("_g"), F.col("_prev_h").alias("_h"), F.expr("substring(_text, 1, cast(_prev_n div 2 as int))").alias("_head"))
    both = full.join(heads.hint("shuffle_merge"), keys).withColumn("_n", F.length("_text"))
    both = both.select(*keys, "_n", "_text", F.concat(F.expr("substring(_text, 1, cast(_n - _n div 2 as int))"), "_head").alias("_edited")).withColumn("_sha", F.sha2("_edited", 256))
    # The edited text's digest, as four longs, and the length travel as terms of kinds of their own, so texts are read once.
    facts = [f"conv(substring(_sha, {16 * k + 1}, 16), 16, -10)" for k in range(4)] + ["_n"]
    rows = ", ".join(["0, _text, null", "1, _edited, null"] + [f"{k + 2}, '', cast({x} as bigint)" for k, x in enumerate(facts)])
    words = both.select(*keys, F.expr(f"stack({len(facts) + 2}, {rows}) as (_kind, _t, _fact)")).select(*keys, "_kind", "_fact", F.explode(F.split("_t", SPACE + "+")).alias("_w"))
    word = F.col("_w") != ""
    terms = words.groupBy(*keys, F.when(F.col("_kind") > 1, F.col("_kind")).otherwise(0).alias("_fact_kind"), F.when(word, F.xxhash64("_w")).otherwise(F.col("_fact")).alias("_term")).agg(
        F.sum(F.when(word & (F.col("_kind") == 0), 1).otherwise(0)).alias("own"), F.sum(F.when(word & (F.col("_kind") == 1), 1).otherwise(0)).alias("edit")
    )
    kept = {f"_fact{k}": F.max(F.when(F.col("_fact_kind") == k + 2, F.col("_term"))) for k in range(len(facts))}
    made = checkpointed(signatures(terms, keys, ["own", "edit"], samples, kept))
    after = made.select(F.col("_g").alias("_next_g"), F.col("_h").alias("_next_h"), F.col("_fp_own").alias("_fp_next"))
    out = made.join(near.select(*keys, "_id", "_m", "_next_g", "_next_h"), keys).join(after, ["_next_g", "_next_h"])
    # A result row for each row of the document, run by run, so no array grows with them.
    out = out.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_m - 1) div {RUN})"))).withColumn("_copy", F.explode(F.expr(f"sequence(1L, least({RUN}L, _m - _run * {RUN}))")))
    sha = F.concat(*[F.lpad(F.hex(f"_fact{k}"), 16, "0") for k in range(4)])
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_fact4").alias("n_chars"),
        F.lower(sha).alias("edited_sha256"),
        hex_of("_fp_own").alias("fingerprint"),
        hex_of("_fp_edit").alias("edited_fingerprint"),
        likeness("_fp_own", "_fp_edit").alias("near_edited"),
        likeness("_fp_own", "_fp_next").alias("near_next"),
    )
