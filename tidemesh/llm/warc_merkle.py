"""WARC records and a Merkle audit of their fixity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

#: Children of a tree node: that many neighbouring offset ranges.
FANOUT = 16
#: Records of one file, about; files are dealt by a hash of id and address, so a replica's record has the file of ours.
RECORDS_PER_FILE = 2048
#: Written files that a Python worker is handed at once.
FILES_PER_BATCH = 4
_END = b"\r\n\r\n"


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Each page as a WARC/1.1 resource record: (_id, _key, record binary).

    The record id derives from the page and the date is fixed, as pages have
    none, so a page always gives the same bytes. _key hashes id and address.
    Null url or body is empty.
    """
    url, body = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(id_text.cast("binary"), F.lit(b"\0"), url.cast("binary"), F.lit(b"\0"), body), 256)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"),
        digest,
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(url, r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return df.select(F.col(id_col).alias("_id"), F.xxhash64(id_text, url).alias("_key"), F.concat(head, body, F.lit(_END)).alias("record"))


def hashed(rows: DataFrame) -> DataFrame:
    """(_id, _key, _length, _hash) of records: all that is shuffled of them."""
    return rows.select("_id", "_key", F.octet_length("record").cast("long").alias("_length"), F.unhex(F.sha2("record", 256)).alias("_hash"))


def file_count(rows: int) -> int:
    return max(1, -(-rows // RECORDS_PER_FILE))


def _order() -> list[Column]:
    return [F.col("_id").asc_nulls_last(), F.col("_hash").asc()]


def laid_out(made: DataFrame, count: int) -> DataFrame:
    """Rows of ``hashed`` in ``count`` files: (_file, _at, _id, _offset, _length, _hash)."""
    dealt = made.withColumn("_file", F.pmod("_key", F.lit(count)).cast("int"))
    order = Window.partitionBy("_file").orderBy(*_order())
    return dealt.select(
        "_file",
        (F.row_number().over(order) - 1).cast("long").alias("_at"),
        "_id",
        (F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_length")).alias("_offset"),
        "_length",
        "_hash",
    )


def files(rows: DataFrame, count: int | None = None) -> DataFrame:
    """Deal records to files and lay them out: (_file, _at, _id, _offset, _length, _hash).

    Within a file records follow by id, null ids last, repeated ids by their
    hash. Only hashes and lengths are shuffled, not records. The number of
    files follows the number of rows unless given. Files that ``write_warc``
    writes have these very offsets.
    """
    made = checkpointed(hashed(rows))
    return laid_out(made, count or file_count(made.count()))


def write_warc(rows: DataFrame, folder: str, count: int | None = None) -> None:
    """Write records (_id, _key, record) as WARC files, one a folder _file=n, in the order of ``files``."""
    count = count or file_count(rows.count())
    text = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    placed = rows.select(F.pmod("_key", F.lit(count)).cast("int").alias("_file"), "_id", F.unhex(F.sha2("record", 256)).alias("_hash"), text.alias("value"))
    placed.repartition(count, "_file").sortWithinPartitions("_file", *_order()).select("_file", "value").write.partitionBy("_file").option("lineSep", _END.decode()).text(folder)


def parsed(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and SHA-256 of each record of a WARC file; a part that can't be read as a record is one to the end of the file."""
    at = 0
    while at < len(content):
        head = content.find(_END, at)
        fields = content[at:head].split(b"\r\n") if head >= 0 and content.startswith(b"WARC/", at) else []
        sizes = [f[15:].strip() for f in fields if f[:15].lower() == b"content-length:"]
        end = len(content)
        if len(sizes) == 1 and sizes[0].isdigit() and head + 8 + int(sizes[0]) <= len(content):
            end = head + 8 + int(sizes[0])
        yield at, end - at, hashlib.sha256(content[at:end]).digest()
        at = end


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of written files, by their real places: (_file, _at, _offset, _length, _hash).

    Files come through Spark's reader, so any shared folder serves; a worker
    holds FILES_PER_BATCH of them. The session's option for the rows of an
    Arrow batch is lowered for that, and stays so.
    """
    bounded_batches(spark, FILES_PER_BATCH)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(parsed(content.as_py()))
                columns = [[file] * len(rows), list(range(len(rows))), *([r[k] for r in rows] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["_file", "_at", "_offset", "_length", "_hash"])

    found = spark.read.format("binaryFile").load(folder).select(F.col("_file").cast("int").alias("_file"), "content")
    return found.mapInArrow(read, "_file int, _at bigint, _offset bigint, _length bigint, _hash binary")


def _up(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next layer: the hash of up to ``fanout`` neighbouring children's hashes, and the range they span."""
    children = F.sort_array(F.collect_list(F.struct("_at", "_hash")))
    joined = F.array_join(F.transform(children, lambda c: F.hex(c["_hash"])), "")
    return (
        nodes.groupBy("_file", F.floor(F.col("_at") / fanout).alias("_up"))
        .agg(F.unhex(F.sha2(F.unhex(joined), 256)).alias("_hash"), F.min("_offset").alias("_offset"), F.max(F.col("_offset") + F.col("_length")).alias("_end"))
        .select("_file", F.col("_up").alias("_at"), "_offset", (F.col("_end") - F.col("_offset")).alias("_length"), "_hash")
    )


def leaf() -> Column:
    """A leaf's hash: of where its range begins, how long it is, and what it holds. Every node above so commits to its range."""
    return F.unhex(F.sha2(F.concat(F.col("_offset").cast("string").cast("binary"), F.lit(b":"), F.col("_length").cast("string").cast("binary"), F.lit(b":"), F.col("_hash")), 256))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All nodes: (_level, _file, _at, _offset, _length, _hash, _levels); level 0 has the records, the top one root a file.

    Each layer is made of the checkpointed one below it.
    """
    top = leaves.agg(F.max("_at")).first()[0]
    layer = leaves.select("_file", "_at", "_offset", "_length", leaf().alias("_hash"))
    layers, level = [], 0
    while True:
        layer = checkpointed(layer)
        layers.append(layer.withColumn("_level", F.lit(level)))
        if not top:
            break
        top, level = top // fanout, level + 1
        layer = _up(layer, fanout)
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.withColumn("_levels", F.lit(level))


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Locate ranges in which two replicas' trees differ, from the roots down.

    Each step joins the children of the nodes that differ, by file and place,
    and keeps those that differ again; a branch whose hashes agree is never
    opened. Ranges that only one replica has come out with nulls on the
    other's side. Returns (_file, _at, _offset, _length, _hash, _other_hash).
    """
    levels = [t.agg(F.max("_levels")).first()[0] for t in (ours, theirs)]
    tops = max([x for x in levels if x is not None], default=None)
    key = ["_file", "_at"]
    found = None
    for level in range(tops if tops is not None else 0, -1, -1):
        a = ours.filter(F.col("_level") == level).select(*key, "_offset", "_length", "_hash")
        b = theirs.filter(F.col("_level") == level).select(*key, F.col("_offset").alias("_other_offset"), F.col("_length").alias("_other_length"), F.col("_hash").alias("_other_hash"))
        if found is not None:
            open_ = found.select("_file", F.col("_at").alias("_parent"))
            a, b = [x.withColumn("_parent", F.floor(F.col("_at") / fanout)).join(open_, ["_file", "_parent"], "left_semi").drop("_parent") for x in (a, b)]
        found = checkpointed(a.join(b, key, "full").filter(~F.col("_hash").eqNullSafe(F.col("_other_hash"))))
    return found.select(*key, F.coalesce("_offset", "_other_offset").alias("_offset"), F.coalesce("_length", "_other_length").alias("_length"), "_hash", "_other_hash")


def audit_files(spark: SparkSession, folder: str, other: str, fanout: int = FANOUT) -> DataFrame:
    """``audit`` over written WARC files: the byte ranges, file by file, in which two folders differ."""
    return audit(*[tree(checkpointed(read_warc(spark, x)), fanout) for x in (folder, other)], fanout)


def _paired(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``a`` and ``b``, each with a struct _row, matched one to one within equal ``by`` (full join: _row, _other)."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_k{n}") for n, c in enumerate(by)]
    order = Window.partitionBy(*[f"_k{n}" for n in range(len(by))]).orderBy("_row._hash", "_row._at")
    a, b = [x.select("_row", *keys).withColumn("_copy", F.row_number().over(order)) for x in (a, b)]
    return a.join(b.withColumnRenamed("_row", "_other"), [*[f"_k{n}" for n in range(len(by))], "_copy"], "full").select("_row", "_other")


def fixity(df: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", fanout: int = FANOUT) -> DataFrame:
    """Audit ``replica`` against ``df``, two copies of a page table, each laid out as WARC files.

    One row per record of ``df``: id, warc_file, record_index, offset, length,
    record_sha256, replica_sha256, intact and replica_offset; and one per
    record that only the replica has, with a null record_sha256 and places in
    the replica. ``intact`` says that the replica holds the very bytes, at
    whatever offset: after a lost or longer record the file's later ones are
    at others. Only where the trees differ are records paired: first equal
    bytes within the file, then what is left by id, in order of hash; a lost
    record has a null replica_sha256.

    Defined cases: null columns are empty strings; null ids come last within
    their file; a repeated id is audited record by record; a page whose
    address changed may change its file, and is then lost in one and added in
    the other; an empty table gives no rows; other columns are ignored.
    """
    made, sent = [checkpointed(hashed(records(x, id_col, url_col, body_col))) for x in (df, replica)]
    count = file_count(made.count())
    ours, theirs = [checkpointed(laid_out(x, count)) for x in (made, sent)]
    bad = audit(tree(ours, fanout), tree(theirs, fanout), fanout).select("_file", "_at")
    row = F.struct("_file", "_at", "_id", "_offset", "_length", "_hash").alias("_row")
    key = ["_file", "_at"]
    same = ours.join(bad, key, "left_anti").select(row, F.col("_hash").alias("_found"), F.col("_offset").alias("_elsewhere"))
    a, b = [x.join(bad, key, "left_semi").select(row, "_file", "_id", "_hash") for x in (ours, theirs)]
    equal = checkpointed(_paired(a, b, ["_file", "_hash"]))
    moved = equal.filter("_row is not null and _other is not null")
    left = [equal.filter(f"{x} is null").select(F.col(y).alias("_row"), f"{y}._file", f"{y}._id") for x, y in (("_other", "_row"), ("_row", "_other"))]
    rest = _paired(*left, ["_file", "_id"])
    odd = moved.unionByName(rest).select("_row", "_other")
    out = same.unionByName(odd.select(F.coalesce("_row", "_other").alias("_row"), F.col("_other._hash").alias("_found"), F.col("_other._offset").alias("_elsewhere"), F.col("_row").isNull().alias("_added")), allowMissingColumns=True)

    def text(c: Column) -> Column:
        return F.lower(F.hex(c))

    hash_ = F.when(~F.coalesce("_added", F.lit(False)), F.col("_row._hash"))
    return out.select(
        F.col("_row._id").alias(id_col),
        F.col("_row._file").alias("warc_file"),
        F.col("_row._at").alias("record_index"),
        F.col("_row._offset").alias("offset"),
        F.col("_row._length").alias("length"),
        text(hash_).alias("record_sha256"),
        text(F.col("_found")).alias("replica_sha256"),
        F.coalesce(hash_ == F.col("_found"), F.lit(False)).alias("intact"),
        F.col("_elsewhere").alias("replica_offset"),
    )
