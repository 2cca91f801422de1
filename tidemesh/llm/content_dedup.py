"""Exact deduplication by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, row_struct, salt_of, text_or_empty

#: Parts into which the copies of one text are dealt before they are sorted.
SALTS = 64
#: Copies of a text above which ``drop_exact`` deals them to salts; any number keeps the same rows.
HOT = 10_000
#: More hot texts than this aren't broadcast; the rows that stay are the same.
BROADCAST_HOT = 200_000
#: Characters of a text that its place in the sort begins with.
HEAD = 32


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Group equal texts; one row per input row with the row that stays.

    Sampled splitters range-partition the normalised texts (all white space
    removed), the sort within a partition places equal texts next to each
    other, and the window compares each text in full with its neighbour. Texts
    sort by their first HEAD characters, then a hash, then in full, so the
    splitters that the driver samples stay small however long texts are. The
    salt, part of the sort key, lets the splitters cut a group of copies into
    up to ``salts`` runs, so no task receives one hot group; the runs' winners
    (a digest and three numbers, not texts) are then merged.

    Returns id, keep_id, group_size, kept, text_sha256. Defined cases: a null
    text equals an empty one; ties in length go to the smallest id, null ids
    last; of repeated rows (same id, same text) exactly one is kept; an empty
    table gives no rows; other columns of ``df`` are ignored.
    """
    rows = (
        df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"), salt_of(id_col, salts).alias("_salt"))
        .select("_id", "_salt", F.length("_t").alias("_n"), F.regexp_replace("_t", SPACE + "+", "").alias("_norm"))
        .withColumns({"_head": F.substring("_norm", 1, HEAD), "_hash": F.xxhash64("_norm")})
        .repartitionByRange("_head", "_hash", "_salt")
    )
    order = [F.col("_n").desc(), F.col("_id").asc_nulls_last()]
    run = Window.partitionBy("_head", "_hash", "_salt", "_norm").orderBy(*order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = checkpointed(
        rows.select(
            "_id",
            "_salt",
            "_n",
            F.unhex(F.sha2("_norm", 256)).alias("_digest"),
            F.row_number().over(run).alias("_rank"),
            F.count(F.lit(1)).over(whole).alias("_count"),
        )
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_salt").alias("salt")))
    groups = (
        runs.filter("_rank = 1")
        .groupBy("_digest")
        .agg(best.alias("_best"), F.sum("_count").alias("_size"), F.collect_list("_salt").alias("_salts"))
        .select("_digest", "_best", "_size", F.explode("_salts").alias("_salt"))
    )
    return runs.join(groups, ["_digest", "_salt"]).select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        ((F.col("_rank") == 1) & (F.col("_salt") == F.col("_best.salt"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, under the cases of ``exact_groups``.

    A row travels with its text through the sort, so texts are exchanged once.
    Only texts with over HOT copies, counted by hash beforehand, are cut into
    runs by a salt; the runs' winners, up to ``salts`` a text, are the only
    rows to move again. Of wholly repeated rows one remains.
    """
    packed, unpacked = row_struct(df)
    text = text_or_empty(text_col)
    norm = F.regexp_replace(text, SPACE + "+", "")
    hot = checkpointed(df.select(F.xxhash64(norm).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT).select("_hash"))
    many = hot.count()
    rows = df.select(packed.alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.length(text).alias("_n"), F.substring(norm, 1, HEAD).alias("_head"), F.xxhash64(norm).alias("_hash"), salt_of(id_col, salts).alias("_salt"))
    if many:
        marks = hot.withColumn("_hot", F.lit(True))
        rows = rows.join(F.broadcast(marks) if many <= BROADCAST_HOT else marks, "_hash", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    else:
        rows = rows.withColumn("_hot", F.lit(False))
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0)).repartitionByRange("_head", "_hash", "_salt")
    # The normalised text is made again behind the exchange, so only the row crosses it.
    rows = rows.withColumn("_norm", F.regexp_replace(F.coalesce(F.col(f"_row.c{df.columns.index(text_col)}").cast("string"), F.lit("")), SPACE + "+", ""))
    best = [F.col("_n").desc(), F.col("_id").asc_nulls_last()]
    run = Window.partitionBy("_head", "_hash", "_salt", "_norm").orderBy(*best)
    first = rows.withColumn("_rank", F.row_number().over(run)).filter("_rank = 1")
    out = first
    if many:
        again = Window.partitionBy("_hash", "_digest").orderBy(*best)
        won = first.filter("_hot").withColumn("_digest", F.sha2("_norm", 256)).withColumn("_rank", F.row_number().over(again)).filter("_rank = 1")
        out = first.filter("not _hot").select("_row").unionByName(won.select("_row"))
    return out.select(*unpacked)
