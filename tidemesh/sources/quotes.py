"""Quote files: fixed-width records, delimited files, archives, and incremental ingest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import append_batch

#: Record fields, fixed by the file format: name, first and one-past-last character, decimals (None: text).
LAYOUT = (
    ("ticker", 12, 24, None),
    ("company", 27, 39, None),
    ("class_text", 39, 49, None),
    ("open", 56, 69, 2),
    ("high", 69, 82, 2),
    ("low", 82, 95, 2),
    ("close", 108, 121, 2),
    ("volume", 170, 188, 0),
)
#: The fields of the longer variant, which divides the volume too.
EXTENDED = (("market", 24, 27, None), *LAYOUT[:-1], ("average", 95, 108, 2), ("trades", 147, 152, 0), ("volume", 170, 188, 2))


def _cut(line: Column, a: int, b: int) -> Column:
    return F.trim(F.substring(line, a + 1, b - a))


def parse_records(lines: DataFrame, layout: tuple = LAYOUT, value: str = "value") -> DataFrame:
    """Quote records (type 01) of fixed-width lines; a line whose date or a number can't be read is dropped."""
    line = F.col(value)
    rows = lines.filter(line.startswith("01"))
    out = [F.try_to_date(_cut(line, 2, 10), "yyyyMMdd").alias("obs_date")]
    for name, a, b, decimals in layout:
        field = _cut(line, a, b)
        out.append((field if decimals is None else field.try_cast("double") / 10**decimals).alias(name))
    parsed = rows.select(*out)
    return parsed.dropna(subset=["obs_date", *[n for n, _, _, d in layout if d is not None]])


def read_records(spark: SparkSession, path: str, layout: tuple = LAYOUT) -> DataFrame:
    """Records of Latin-1 files. The text source reads UTF-8 only, so lines come as the one field of a delimited file."""
    lines = spark.read.options(encoding="ISO-8859-1", sep="\u0001", quote="", escape="").schema("value string").csv(path)
    return parse_records(lines, layout)


def spot_market(records: DataFrame, market: str = "010") -> DataFrame:
    return records.filter(F.col("market") == market)


def format_records(df: DataFrame) -> DataFrame:
    """Panels back to fixed-width lines (value), for export and tests: obs_date, ticker, company, market, prices, volume, trades."""

    def number(c: str, width: int) -> Column:
        return F.lpad(F.round(F.col(c) * 100).cast("bigint").cast("string"), width, "0")

    def text(c: str, width: int) -> Column:
        return F.rpad(c, width, " ")

    line = F.concat(
        F.lit("01"), F.date_format("obs_date", "yyyyMMdd"), F.lit("02"), text("ticker", 12), text("market", 3), text("company", 12), text("class_text", 10), F.lit(" " * 7),
        number("open", 13), number("high", 13), number("low", 13), number("average", 13), number("close", 13), F.lit("0" * 26), F.lpad(F.col("trades").cast("string"), 5, "0"), F.lit("0" * 18), number("volume", 18), F.lit(" " * 57),
    )
    return df.select(line.alias("value"))


#: How a yearly archive is named, and what names its record file where that has no extension: fixed by the publisher.
ARCHIVE_NAME = r"COTAHIST_A(\d{4})\.ZIP$"
MEMBER_NAME = "COTAHIST"


def record_members(names: list[str]) -> list[str]:
    """The members of an archive that hold records: its .TXT files, or, in archives of early years, the first named after the series; else all."""
    texts = [n for n in names if n.upper().endswith(".TXT")]
    return texts or [n for n in names if MEMBER_NAME in n.upper()][:1] or list(names)


def cached_years(paths: DataFrame, path: str = "path") -> DataFrame:
    """The years (year) whose archives are among the paths."""
    year = F.regexp_extract(F.upper(F.col(path)), ARCHIVE_NAME, 1)
    return paths.select(year.alias("_y")).filter("_y <> ''").select(F.col("_y").cast("int").alias("year")).distinct()


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of a folder's archives; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{ZIP,zip}").load(folder).select("path", "length")


def years_to_fetch(cached: DataFrame, first: int, this_year: int) -> DataFrame:
    """The years that an update fetches: past ones that aren't cached, and always the present one, whose archive still grows."""
    years = cached.sparkSession.range(first, this_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(cached.filter(F.col("year") < this_year), "year", "left_anti")


def unpack_delimited(archives: DataFrame, member: str, columns: list[str], sep: str = ";", encoding: str = "latin-1") -> DataFrame:
    """Columns, as text, of the delimited files in ZIP archives (content) whose name holds ``member``; a file is read in pieces by the task that has its archive."""

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in [n for n in z.namelist() if member in n]:
                        with z.open(name) as f:
                            for part in pd.read_csv(f, sep=sep, encoding=encoding, dtype=str, keep_default_na=False, chunksize=10_000):
                                yield pd.DataFrame({c: part[c] if c in part else None for c in columns})

    return archives.select("content").mapInPandas(unpack, ", ".join(f"`{c}` string" for c in columns))


def read_zipped_delimited(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = ";", encoding: str = "latin-1") -> DataFrame:
    return unpack_delimited(spark.read.format("binaryFile").load(path), member, columns, sep, encoding)


def unpack_records(archives: DataFrame) -> DataFrame:
    """Lines (value) of the record files in ZIP archives (content); each archive is unpacked by the task that reads it, member by member."""

    def unpack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in record_members(z.namelist()):
                        with z.open(name) as f:
                            for part in iter(lambda f=f: f.readlines(4 << 20), []):
                                yield pd.DataFrame({"value": [x.decode("latin-1").rstrip("\r\n") for x in part]})

    return archives.select("content").mapInPandas(unpack, "value string")


def read_archives(spark: SparkSession, path: str, layout: tuple = LAYOUT) -> DataFrame:
    """Records of all ZIP archives of a path; ``archives.read_period`` opens only those of a period."""
    return parse_records(unpack_records(spark.read.format("binaryFile").load(path)), layout)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8", rows: int | None = None) -> DataFrame:
    """A typed scan of delimited files with a header; ``rows`` bounds it."""
    out = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).schema(schema).csv(path)
    return out if rows is None else out.limit(rows)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns that a delimited file's header names, as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_returns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """An untyped scan, then casts of the columns named; what can't be cast is null."""
    return read_rows(spark, path).select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows from JSON documents {"windows": [{id, start, end}, ...]}."""
    rows = spark.read.option("multiLine", True).schema("windows array<struct<id int, start string, end string>>").json(path)
    return rows.select(F.explode("windows").alias("w")).select(F.col("w.id").alias("window_id"), F.to_date("w.start").alias("window_start"), F.to_date("w.end").alias("window_end"))


def read_edge_lists(spark: SparkSession, glob: str, number: str = r"(\d+)[^\d/]*$") -> DataFrame:
    """Edge lists, one file or folder a window; the window's number is the last number of the file's name, or what ``number`` finds in its path."""
    rows = read_delimited(spark, glob, "source string, target string, weight double, distance double")
    return rows.withColumn("window_id", F.regexp_extract(F.input_file_name(), number, 1).cast("int"))


def ingest(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = ("obs_date", "ticker")) -> DataFrame:
    """What a table at ``path`` (none yet: an empty one) holds after a batch: the batch's rows win, only later dates are new."""
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  a table that isn't there yet is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return new
    return append_batch(existing, new, list(keys))


def companies_of_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of HTML table rows, one row per <tr>: (page_id, row, cells)."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_tr"))
    cells = F.transform(F.regexp_extract_all("_tr", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return rows.select("page_id", "row", cells.alias("cells"))


def dataset_info(df: DataFrame, asset: str = "ticker", date_col: str = "obs_date") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(asset).alias("assets"), F.countDistinct(date_col).alias("days"), F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"))
