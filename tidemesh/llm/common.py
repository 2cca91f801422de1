"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    A temporary one is made only where the session names none and its master
    is this machine, as in tests; on a cluster that raises an error, as
    checkpoints in one machine's folder are lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not on_one_machine(sc.master):
            raise ValueError("spark.checkpoint.dir names no folder, and a temporary one would lie on one machine of the cluster")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemesh-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever file system its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def on_one_machine(master: str) -> bool:
    """Whether a master's executors are threads of the driver."""
    return master == "local" or master.startswith("local[")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_struct(df: DataFrame) -> tuple[Column, list[Column]]:
    """A whole row as one struct, and the columns that unfold it from ``_row``: no name of ``df`` can clash meanwhile."""
    packed = F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)])
    return packed, [F.col(f"_row.c{n}").alias(c) for n, c in enumerate(df.columns)]


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(modulus))


def salt_of(name: str, salts: int) -> Column:
    """A salt by id and input partition, so rows that share an id have several too; it is to be read off the input."""
    return F.pmod(F.xxhash64(F.col(f"`{name}`").cast("string"), F.spark_partition_id()), F.lit(salts)).cast("int")


def id_hash(name: str) -> Column:
    """A never-null hash of an id, for join keys: a null-safe comparison would give up the hash partitioning."""
    return F.xxhash64(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("\0")))


#: Texts of one Arrow batch; at the usual size the texts of a batch alone would fill hundreds of MB.
TEXTS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> None:
    """Keep Arrow batches of whole texts small, on the JVM and in Python; a smaller setting of the session stays.

    The option belongs to the session, as plans read it when they run; it stays lowered.
    """
    if int(spark.conf.get(_BATCH, "10000")) > rows:
        spark.conf.set(_BATCH, str(rows))
